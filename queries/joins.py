"""Joins, concatenation, duplicates."""

from pyspark.sql import functions as F

from queries.base import query, table
from tabprep.operators import joins as J

# Keys hold nulls on both sides, and some orders and customers have no partner.
_O = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey * 2 END AS custkey,
        o_totalprice AS amount FROM orders)"""
_C = """c AS (SELECT CASE WHEN c_custkey = 7 THEN NULL ELSE c_custkey END AS custkey, c_mktsegment,
        c_acctbal AS amount FROM customer)"""


def _sides(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") * 2).alias("custkey"),
        F.col("o_totalprice").alias("amount"),
    )
    customers = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") != 7, F.col("c_custkey")).alias("custkey"),
        "c_mktsegment",
        F.col("c_acctbal").alias("amount"),
    )
    return orders, customers


def _sql(how: str, key: str) -> str:
    return f"""WITH {_O}, {_C} SELECT {key} AS custkey, o_orderkey, o.amount AS amount_x, c_mktsegment,
               c.amount AS amount_y FROM o {how} JOIN c ON o.custkey IS NOT DISTINCT FROM c.custkey"""


@query(_sql("INNER", "o.custkey"))
def merge_inner(spark, d):
    return J.merge(*_sides(spark, d), on="custkey", how="inner")


@query(_sql("LEFT", "o.custkey"))
def merge_left(spark, d):
    return J.merge(*_sides(spark, d), on="custkey", how="left")


@query(_sql("RIGHT", "c.custkey"))
def merge_right(spark, d):
    return J.merge(*_sides(spark, d), on=["custkey"], how="right")


@query(_sql("FULL OUTER", "coalesce(o.custkey, c.custkey)"))
def merge_outer(spark, d):
    return J.merge(*_sides(spark, d), on="custkey", how="outer")


@query("""SELECT l.k AS k, l.f AS f, sum(l.q) AS q, count(p.p) AS n FROM
          (SELECT l_partkey AS k, l_returnflag AS f, l_quantity AS q FROM lineitem) l
          JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'A' ELSE 'R' END AS f, p_retailprice AS p FROM part) p
          ON l.k = p.k AND l.f = p.f GROUP BY ALL""")
def merge_two_keys(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q")
    )
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("k"),
        F.when(F.col("p_size") > 25, "A").otherwise("R").alias("f"),
        F.col("p_retailprice").alias("p"),
    )
    joined = J.merge(lines, parts, on=["k", "f"])
    return joined.groupBy("k", "f").agg(F.sum("q").alias("q"), F.count("p").alias("n"))


@query("""SELECT coalesce(a.pos, b.pos) AS pos, a.name AS name, a.bal AS bal, b.name AS name_2, b.bal AS bal_2
          FROM (SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS pos, c_name AS name, c_acctbal AS bal
                FROM customer) a
          FULL JOIN (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_name AS name, s_acctbal AS bal
                FROM supplier) b ON a.pos = b.pos""")
def concat_columns(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), (-F.col("c_custkey")).alias("o1")
    )
    suppliers = table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("o2")
    )
    return J.concat(customers, suppliers, 1, "o1", "o2").drop("o1", "o2").withColumnRenamed("_pos", "pos")


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, c_mktsegment, NULL AS s_region FROM customer
          UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey % 5 FROM supplier""")
def concat_rows(spark, d):
    customers = table(spark, d, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS bal", "c_mktsegment"
    )
    suppliers = table(spark, d, "supplier").selectExpr(
        "s_suppkey AS key", "s_name AS name", "s_acctbal AS bal", "s_nationkey % 5 AS s_region"
    )
    return J.concat(customers, suppliers, 0)


@query("SELECT event_type, user_id, min(event_id) AS first_row FROM events GROUP BY event_type, user_id")
def drop_duplicates(spark, d):
    events = table(spark, d, "events").select("event_type", "user_id", F.col("event_id").alias("_ord"))
    return J.drop_duplicates(events).withColumnRenamed("_ord", "first_row")


@query("SELECT count(*) - count(DISTINCT (event_type, user_id)) AS duplicates FROM events")
def duplicate_count(spark, d):
    return J.duplicate_count(table(spark, d, "events").select("event_type", "user_id"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, d):
    return J.drop_duplicates(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))
