"""Bounded tables behind charts."""

from pyspark.sql import functions as F

from queries.base import EV, LI, holed_events, holed_lineitem, ordered_events, query, rounded, table
from tabprep.operators import charts as V


@query("""WITH s AS (SELECT greatest(epoch(max(ts)) - epoch(min(ts)), 1) / 40 AS b FROM events)
    SELECT CASE WHEN b <= 3600 THEN strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') WHEN b <= 86400
    THEN strftime(date_trunc('day', ts), '%Y-%m-%d') WHEN b <= 604800 THEN strftime(date_trunc('week', ts), '%Y-%m-%d')
    ELSE strftime(date_trunc('month', ts), '%Y-%m') END AS label, count(*) AS n FROM events, s GROUP BY 1""")
def bucket_time_axis(spark, d):
    grouped, axis = V.bucket_axis(table(spark, d, "events"), "ts")
    return grouped.groupBy(F.col(axis).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT unnest(quantile_cont(o_totalprice, [i / 40.0 FOR i IN range(41)])) AS e FROM orders),
    e AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i FROM (SELECT DISTINCT e FROM q)),
    b AS (SELECT i, e AS lo, lead(e) OVER (ORDER BY i) AS hi FROM e)
    SELECT i::INT AS bin, count(*) AS n, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high
    FROM orders JOIN b ON (o_totalprice > lo OR (i = 0 AND o_totalprice = lo)) AND o_totalprice <= hi GROUP BY i""")
def bucket_number_axis(spark, d):
    orders = table(spark, d, "orders").select("o_totalprice")
    binned = V.bin_index(orders, "o_totalprice", V.quantile_edges(orders, "o_totalprice"), "bin")
    price = F.col("o_totalprice")
    return rounded(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high")), 4)


@query("""WITH p AS (SELECT CASE WHEN p_size = 7 THEN NULL ELSE p_name END AS x FROM part), t AS (SELECT x FROM p WHERE x IS NOT
    NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 39) SELECT CASE WHEN x IS NULL THEN 'Missing' WHEN x IN (FROM t) THEN x
    ELSE 'Other' END AS label, count(*) AS n FROM p GROUP BY 1""")
def bucket_text_axis(spark, d):
    parts = table(spark, d, "part").select(F.when(F.col("p_size") != 7, F.col("p_name")).alias("x"))
    grouped, axis = V.bucket_axis(parts, "x")
    return grouped.groupBy(F.col(axis).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_THIN = """n AS (SELECT count(*) AS n FROM k), r AS (SELECT k.*, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM k),
  s AS (SELECT r.*, n FROM r, n WHERE n <= {m} OR rn IN (SELECT j * (n - 1) // ({m} - 1) FROM range({m}) t(j), n))"""


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE value IS NOT NULL), {_THIN.format(order='event_id', m=5000)}
    SELECT user_id, value, event_type, event_id, ts, props FROM s""")
def scatter_data(spark, d):
    return V.scatter_data(holed_events(spark, d), "user_id", "value", color="event_type")


@query(f"""WITH k AS (SELECT o_custkey, o_totalprice, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 50 END AS weight,
    o_orderkey FROM orders WHERE o_orderkey % 8 <> 0), {_THIN.format(order='o_orderkey', m=5000)}
    SELECT o_custkey, o_totalprice, weight FROM s""")
def bubble_data(spark, d):
    orders = table(spark, d, "orders").select(
        "o_custkey", "o_totalprice", F.expr("CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 50 END").alias("weight"),
        F.col("o_orderkey").alias("_ord"),
    )
    return V.scatter_data(orders, "o_custkey", "o_totalprice", size="weight")


@query(f"""WITH {EV}, k AS (SELECT * FROM ev WHERE value IS NOT NULL), {_THIN.format(order='value, event_id', m=3000)}
    SELECT rn AS position, value, user_id, event_id, ts, event_type, props FROM s""")
def line_data(spark, d):
    return V.line_data(holed_events(spark, d), "value", "user_id")


@query(f"""WITH {EV}, e AS (SELECT min(value) AS a, max(value) AS b FROM ev), w AS (SELECT a, (b - a) / 40 AS w FROM e),
    k AS (SELECT event_type, least(floor((value - a) / w), 39)::INT AS bin, a, w FROM ev, w WHERE value IS NOT NULL AND
    event_type IS NOT NULL), t AS (SELECT event_type, count(*) AS t FROM k GROUP BY 1)
    SELECT event_type, bin, round(a + bin * w, 6) AS low, round(a + (bin + 1) * w, 6) AS high, count(*) AS "count",
    round(count(*) / (t * w), 6) AS density FROM k JOIN t USING (event_type) GROUP BY event_type, bin, a, w, t""")
def histogram(spark, d):
    return rounded(V.histogram(holed_events(spark, d), "value", color="event_type"), 6)


@query(f"""WITH {EV}, c AS (SELECT event_type AS value, count(*) AS "count" FROM ev WHERE event_type IS NOT NULL GROUP BY 1)
    SELECT value, "count", round("count" / sum("count") OVER (), 6) AS density FROM c""")
def histogram_text(spark, d):
    return rounded(V.histogram(holed_events(spark, d), "event_type"), 6)


@query(f"""WITH {EV}, x AS (SELECT epoch(ts) AS s FROM ev WHERE ts IS NOT NULL), e AS (SELECT min(s) AS a, max(s) AS b FROM x),
    w AS (SELECT a, (b - a) / 40 AS w FROM e), k AS (SELECT least(floor((s - a) / w), 39)::INT AS bin, a, w FROM x, w)
    SELECT bin, round(a + bin * w, 3) AS low, round(a + (bin + 1) * w, 3) AS high, count(*) AS "count" FROM k GROUP BY bin, a, w""")
def histogram_time(spark, d):
    found = V.histogram(holed_events(spark, d), "ts").drop("density")
    return rounded(found.withColumns({n: F.col(n).cast("double") for n in ("low", "high")}), 3)


@query(f"""WITH {EV}, k AS (SELECT event_type, value FROM ev WHERE value IS NOT NULL AND event_type IS NOT NULL),
    q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM k
    GROUP BY 1) SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(q1, 6) AS q1,
    round(md, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
    max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM k JOIN q USING (event_type) GROUP BY event_type, q1, md, q3""")
def box_data(spark, d):
    return rounded(V.box_data(holed_events(spark, d), "event_type", "value"), 6, "q1", "median", "q3")


@query("""WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), w AS (SELECT a, (b - a) / 20 AS w FROM e),
    k AS (SELECT o_orderstatus, least(floor((o_totalprice - a) / w), 19)::INT AS bin, w FROM orders, w),
    t AS (SELECT o_orderstatus, count(*) AS t FROM k GROUP BY 1) SELECT o_orderstatus, bin, count(*) AS "count",
    round(count(*) / (t * w) * 1e6, 6) AS density FROM k JOIN t USING (o_orderstatus) GROUP BY o_orderstatus, bin, w, t""")
def violin_data(spark, d):
    out = V.violin_data(table(spark, d, "orders"), "o_orderstatus", "o_totalprice", bins=20)
    return out.select("o_orderstatus", "bin", "count", F.round(F.col("density") * 1e6, 6).alias("density"))


@query(f"""WITH {EV} SELECT event_type, user_id % 4 AS g, round(coalesce(sum(value), 0), 2) AS value FROM ev GROUP BY 1, 2""")
def bar_data(spark, d):
    events = holed_events(spark, d).withColumn("g", F.col("user_id") % 4)
    return rounded(V.bar_data(events, "event_type", "value", "g"), 2)


@query("""SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1""")
def bar_data_counts(spark, d):
    return V.bar_data(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query(f"""WITH {LI} SELECT l_linenumber, l_returnflag, round(avg(l_discount), 6) AS mean FROM li WHERE l_returnflag IS NOT NULL
    AND l_discount IS NOT NULL GROUP BY 1, 2""")
def heatmap_data(spark, d):
    return rounded(V.heatmap_data(holed_lineitem(spark, d), "l_returnflag", "l_linenumber", "l_discount"), 6)


@query(f"""WITH {LI}, k AS (SELECT * FROM li WHERE l_returnflag IS NOT NULL),
    c AS (SELECT l_linenumber, l_returnflag, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT a.l_linenumber, b.l_returnflag, coalesce(n, 0) AS "count" FROM (SELECT DISTINCT l_linenumber FROM k) a
    CROSS JOIN (SELECT DISTINCT l_returnflag FROM k) b LEFT JOIN c ON c.l_linenumber = a.l_linenumber AND c.l_returnflag = b.l_returnflag""")
def heatmap_counts(spark, d):
    return V.heatmap_data(holed_lineitem(spark, d), "l_returnflag", "l_linenumber")


_NUMS = ("l_quantity", "l_extendedprice", "l_discount")
_MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, " + ("1.0::DOUBLE AS r" if a == b else f"round(corr({a}, {b}), 6) AS r FROM li")
    for a in _NUMS for b in _NUMS)


@query(f"WITH {LI} {_MATRIX}")
def correlation_heatmap(spark, d):
    return rounded(V.correlation_heatmap(holed_lineitem(spark, d), _NUMS), 6)


@query("""WITH k AS (SELECT event_id, value, user_id::DOUBLE AS u, event_id::DOUBLE AS e FROM events), n AS (SELECT count(*) AS n
    FROM k), r AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM k), s AS (SELECT * FROM r WHERE rn IN
    (SELECT j * (n - 1) // 499 FROM range(500) t(j), n)) SELECT 'value' AS var_x, 'user_id' AS var_y, value AS x, u AS y FROM s
    UNION ALL SELECT 'user_id', 'value', u, value FROM s""")
def pair_grid(spark, d):
    return V.pair_grid(ordered_events(spark, d), ["value", "user_id"], 500)


@query("""WITH e AS (SELECT min(value) AS a, (max(value) - min(value)) / 10 AS w, min(user_id)::DOUBLE AS c,
    (max(user_id)::DOUBLE - min(user_id)) / 10 AS v FROM events) SELECT 'value' AS "column",
    least(floor((value - a) / w), 9)::INT AS bin, count(*) AS "count" FROM events, e GROUP BY 2 UNION ALL SELECT 'user_id',
    least(floor((user_id - c) / v), 9)::INT, count(*) FROM events, e GROUP BY 2""")
def pair_grid_histograms(spark, d):
    return V.pair_grid_histograms(table(spark, d, "events"), ["value", "user_id"], 10).drop("low", "high")
