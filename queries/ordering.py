"""Row numbers, ranks, quantiles, previews, sampling."""

from pyspark.sql import functions as F

from queries.base import LI, holed_lineitem, ordered_events, query, rounded, table
from tabprep.operators import ordering as O
from tabprep.operators import sample as P


@query("""SELECT event_id, ts, row_number() OVER (ORDER BY value, event_id) - 1 AS rn FROM events""")
def row_number(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "value")
    return O.with_row_number(events, ["value", "event_id"], "rn").drop("value")


@query("""SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name) - 1 AS rn FROM customer""")
def row_number_by_text(spark, d):
    return O.with_row_number(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "rn")


@query(f"""WITH {LI}, c AS (SELECT l_linestatus, l_discount, count(*) AS n FROM li WHERE l_discount IS NOT NULL
           GROUP BY 1, 2) SELECT l_linestatus, l_discount, n,
           sum(n) OVER (PARTITION BY l_linestatus ORDER BY l_discount) - n + (n + 1) / 2.0 AS avg_rank,
           (sum(n) OVER (PARTITION BY l_linestatus ORDER BY l_discount) - n)::BIGINT AS before,
           (sum(n) OVER (PARTITION BY l_linestatus))::BIGINT AS total FROM c""")
def average_ranks(spark, d):
    return O.average_ranks(holed_lineitem(spark, d), "l_discount", "l_linestatus")


@query(f"""WITH {LI} SELECT c AS "column", p::DOUBLE AS p, round(q, 6) AS q FROM (
           SELECT 'l_extendedprice' AS c, unnest([0.0, 0.1, 0.5, 0.95, 1.0]) AS p,
                  unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.95, 1.0])) AS q FROM li UNION ALL
           SELECT 'l_tax', unnest([0.0, 0.1, 0.5, 0.95, 1.0]),
                  unnest(quantile_cont(l_tax, [0.0, 0.1, 0.5, 0.95, 1.0])) FROM li)""")
def quantiles(spark, d):
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    found = O.quantiles(holed_lineitem(spark, d), ["l_extendedprice", "l_tax"], probs)
    rows = [(c, p, round(v, 6)) for c, values in found.items() for p, v in zip(probs, values)]
    return spark.createDataFrame(rows, "column string, p double, q double")


@query(f"""WITH {LI} SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS med,
           round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM li GROUP BY l_returnflag""")
def group_quantiles(spark, d):
    out = O.group_quantiles(holed_lineitem(spark, d), "l_extendedprice", "l_returnflag", {"med": 0.5, "p90": 0.9})
    return rounded(out, 6)


@query("SELECT * FROM events ORDER BY event_id LIMIT 10")
def preview(spark, d):
    return O.preview(table(spark, d, "events"), "event_id", 10)


@query("""SELECT p_name, count(*) AS "count" FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 5""")
def top_values(spark, d):
    return P.top_values(table(spark, d, "part"), "p_name", 5)


@query("""WITH t AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 39)
          SELECT CASE WHEN p_name IN (FROM t) THEN p_name ELSE 'Other' END AS label, count(*) AS n FROM part GROUP BY 1""")
def top_categories(spark, d):
    labelled = P.top_categories(table(spark, d, "part"), "p_name", 39, "label")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n
          FROM events) SELECT event_id, value FROM r
          WHERE rn IN (SELECT k * (n - 1) // (1000 - 1) FROM range(1000) t(k), (SELECT count(*) AS n FROM events))""")
def evenly_downsample(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return P.evenly_downsample(events, 1000, "event_id").drop("_pos")


@query("""WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS rn FROM events)
          SELECT event_id, value FROM r
          WHERE rn IN (SELECT k * (n - 1) // (777 - 1) FROM range(777) t(k), (SELECT count(*) AS n FROM events))""")
def evenly_downsample_sorted(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return P.evenly_downsample(events, 777, ["value", "event_id"]).drop("_pos")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
          SELECT event_id AS row_id, value FROM events, q
          WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) ORDER BY event_id LIMIT 50""")
def first_outliers(spark, d):
    return P.first_outliers(ordered_events(spark, d), "value", 50).withColumnRenamed("_ord", "row_id")


def random_split(spark, d):
    """Sizes and overlap of the hashed 80/20 split."""
    train, test = P.random_split(ordered_events(spark, d), 0.2, 42)
    sides = train.select("_ord", F.lit("train").alias("side")).unionByName(test.select("_ord", F.lit("test").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_ord").alias("ids"))


query()(random_split)
