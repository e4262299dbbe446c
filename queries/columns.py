"""Columns and filters."""

from pyspark.sql import functions as F

from queries.base import LI, holed_lineitem, query, table
from tabprep.operators import columns as C
from tabprep.operators import filters as R


@query("""SELECT l_orderkey AS order_key, l_quantity AS qty_units, l_discount AS disc, l_tax AS disc_2,
          l_shipdate AS ship_date FROM lineitem""")
def standardize_columns(spark, d):
    messy = {
        "l_orderkey": " Order  Key ", "l_quantity": "QTY [Units]", "l_discount": "Disc (%)", "l_tax": "disc.",
        "l_shipdate": "Ship/Date",
    }
    raw = table(spark, d, "lineitem").select(*messy).withColumnsRenamed(messy)
    return C.standardize_columns(raw)


@query("SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price FROM orders")
def rename_columns(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return C.rename_columns(orders, "o_orderkey: id\n o_custkey :customer\nabsent:x\no_totalprice:price\nno rule")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def drop_columns(spark, d):
    return C.drop_columns(table(spark, d, "orders"), ["o_orderpriority", "absent"])


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def drop_long_text_columns(spark, d):
    return C.drop_long_text_columns(table(spark, d, "documents"), 50)


@query("SELECT ts, event_type, value, props FROM events")
def drop_unwanted_columns(spark, d):
    return C.drop_unwanted_columns(table(spark, d, "events"))


@query("SELECT page_id, html_length FROM (SELECT page_id, length(html) AS html_length FROM pages)")
def drop_url_columns(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("html_length"))
    return C.drop_url_columns(pages)


@query("SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20.5")
def filter_range(spark, d):
    return R.filter_range(table(spark, d, "lineitem"), "l_quantity", 10, 20.5)


@query(f"WITH {LI} SELECT * FROM li WHERE l_returnflag IN ('A', 'R') OR l_returnflag IS NULL")
def filter_members(spark, d):
    return R.filter_members(holed_lineitem(spark, d), "l_returnflag", ["A", "R", None])


@query(f"""WITH {LI} SELECT l_returnflag, l_shipdate, l_discount, l_tax FROM li
           WHERE NOT (coalesce(l_discount = 0, false) AND coalesce(l_tax = 0, false))""")
def filter_exact_zero_rows(spark, d):
    measures = holed_lineitem(spark, d).select("l_returnflag", "l_shipdate", "l_discount", "l_tax")
    return R.filter_exact_zero_rows(measures)


@query(f"""WITH {LI} SELECT l_returnflag, l_shipdate, l_discount, l_tax, l_linenumber AS date FROM li
           WHERE coalesce(l_discount, 0) <> 0 OR coalesce(l_tax, 0) <> 0""")
def remove_zero_only_rows(spark, d):
    measures = holed_lineitem(spark, d).select(
        "l_returnflag", "l_shipdate", "l_discount", "l_tax", F.col("l_linenumber").alias("date")
    )
    return R.remove_zero_only_rows(measures)


@query(f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_discount, l_tax,
           coalesce(l_discount, 0) = 0 AND coalesce(l_tax, 0) = 0 AS zero_only
           FROM li""")
def mark_zero_only_rows(spark, d):
    source = holed_lineitem(spark, d)
    keys = source.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        "l_discount",
        "l_tax",
    )
    marked = R.mark_zero_only_rows(keys)
    return marked.withColumns({n: F.col(n).cast("long") for n in ("l_orderkey", "l_linenumber")})


@query(f"WITH {LI} SELECT * FROM li WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def drop_null_rows(spark, d):
    return R.drop_null_rows(holed_lineitem(spark, d), ["l_discount", "l_returnflag"])
