"""Cleaning operators and pipelines."""

from pyspark.sql import functions as F

from queries.base import EV, LI, holed_events, holed_lineitem, ordered_events, query, rounded, table
from tabprep.operators import clean as C
from tabprep.operators import profile as P
from tabprep.plans import cleaning as L

# Text columns: a = numbers with some words, b = mostly words, c = codes such as 10e2, k = a name that blocks conversion.
_TEXTS = (
    "event_id",
    "CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE CAST(user_id AS VARCHAR(10)) END AS a",
    "CASE WHEN event_id % 10 < 8 THEN event_type ELSE CAST(user_id AS VARCHAR(10)) END AS b",
    "CAST(user_id % 20 AS VARCHAR(10)) || 'e2' AS c",
    "CAST(user_id AS VARCHAR(10)) AS month_code",
)


@query(f"""WITH t AS (SELECT {', '.join(_TEXTS)} FROM events) SELECT event_id, TRY_CAST(a AS DOUBLE) AS a, b, c,
           TRY_CAST(month_code AS DOUBLE) AS month_code FROM t""")
def promote_numeric_text(spark, d):
    return C.promote_numeric_text(table(spark, d, "events").selectExpr(*_TEXTS))


@query(f"""WITH t AS (SELECT {', '.join(_TEXTS)} FROM events) SELECT event_id, TRY_CAST(a AS DOUBLE) AS a, b,
           TRY_CAST(c AS DOUBLE) AS c, month_code FROM t""")
def optimize_types(spark, d):
    texts = table(spark, d, "events").selectExpr(*_TEXTS).withColumn("_ord", F.col("event_id"))
    return C.optimize_types(texts, downcast=False).drop("_ord")


@query("""SELECT l_linenumber::INT AS l_linenumber, l_quantity::FLOAT::DOUBLE AS l_quantity,
          (l_linenumber * 1000)::SMALLINT AS k, 'tinyint' AS t1, 'float' AS t2, 'smallint' AS t3 FROM lineitem""")
def narrow_types(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_quantity",
        (F.col("l_linenumber") * 1000).cast("long").alias("k"),
    )
    out = C.optimize_types(lines)
    kinds = dict(out.dtypes)
    return out.select(
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        F.col("l_quantity").cast("double").alias("l_quantity"),
        "k",
        F.lit(kinds["l_linenumber"]).alias("t1"),
        F.lit(kinds["l_quantity"]).alias("t2"),
        F.lit(kinds["k"]).alias("t3"),
    )


@query("""SELECT o_totalprice, o_orderdate::DATE + INTERVAL 1 HOUR * (o_orderkey % 24) +
          INTERVAL 1 MINUTE * (o_orderkey % 60) AS date_time FROM orders""")
def merge_date_and_time(spark, d):
    clock = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit("H"),
                     F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    orders = table(spark, d, "orders").select(
        "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_c"), clock.alias("heure")
    )
    return C.merge_date_and_time(orders)


@query(f"""WITH {LI}, f AS (SELECT avg(l_discount) AS d, avg(l_tax) AS t FROM li), m AS (SELECT l_returnflag AS r FROM li
           WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
           SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, d), 8) AS l_discount,
           round(coalesce(l_tax, t), 8) AS l_tax, coalesce(l_returnflag, r) AS l_returnflag FROM li, f, m""")
def impute_static(spark, d):
    lines = holed_lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    return rounded(C.impute_static(lines), 8)


@query(f"""WITH {EV}, b AS (SELECT event_id // 8 AS b, median(value) AS m FROM ev GROUP BY 1)
           SELECT event_id, ts, coalesce(value, m, 0.0) AS value FROM ev JOIN b ON b.b = event_id // 8""")
def impute_by_block(spark, d):
    out = C.impute_by_block(holed_events(spark, d).select("_ord", "ts", "value"), 8)
    return out.withColumnRenamed("_ord", "event_id")


# Days on which every measure is null or 0 go away as a whole.
_DAYS = (
    "CAST(ts AS DATE) AS day_date",
    "CASE WHEN event_id % 3 = 0 THEN NULL WHEN dayofyear(ts) % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS level",
    "CASE WHEN dayofyear(ts) % 4 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS load_value",
)


@query(f"""WITH t AS (SELECT event_id, {', '.join(_DAYS)} FROM events), g AS (SELECT day_date FROM t WHERE level <> 0 OR load_value <> 0
           GROUP BY 1) SELECT t.* FROM t JOIN g USING (day_date)""")
def drop_empty_date_groups(spark, d):
    days = table(spark, d, "events").selectExpr("event_id", *_DAYS)
    return C.drop_empty_date_groups(days, "day_date", ["level", "load_value"])


@query(f"""WITH {EV}, t AS (SELECT event_id, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS h FROM ev), r AS (
           SELECT event_id, h, event_id - row_number() OVER (PARTITION BY h ORDER BY event_id) AS run FROM t),
           s AS (SELECT run, count(*) AS n FROM r WHERE h = 1 GROUP BY run)
           SELECT 'value' AS "column", sum(n)::BIGINT AS null_count, count(*) AS null_runs, max(n) AS longest_run,
           (SELECT min(event_id) FROM ev WHERE value IS NOT NULL) AS first_valid,
           (SELECT max(event_id) FROM ev WHERE value IS NOT NULL) AS last_valid FROM s""")
def null_runs(spark, d):
    return C.null_runs(holed_events(spark, d), ["value"])


def _fill_sql(expression: str) -> str:
    return f"WITH {EV}, f AS (SELECT {expression} AS x FROM ev) SELECT event_id, round(coalesce(value, x), 6) AS value FROM ev, f"


@query(_fill_sql("avg(value)"))
def fill_mean(spark, d):
    return rounded(C.handle_missing(holed_events(spark, d, False).select("event_id", "value"), "fill_mean", "event_id"), 6)


@query(_fill_sql("median(value)"))
def fill_median(spark, d):
    return rounded(C.handle_missing(holed_events(spark, d, False).select("event_id", "value"), "fill_median", "event_id"), 6)


@query(_fill_sql("max(0.0::DOUBLE)"))
def fill_zero(spark, d):
    return rounded(C.handle_missing(holed_events(spark, d, False).select("event_id", "value"), "fill_zero", "event_id"), 6)


@query(f"""WITH {EV}, f AS (SELECT event_type AS x FROM ev WHERE event_type IS NOT NULL GROUP BY 1
           ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, coalesce(event_type, x) AS event_type FROM ev, f""")
def fill_mode(spark, d):
    return C.handle_missing(holed_events(spark, d, False).select("event_id", "event_type"), "fill_mode", "event_id")


@query(f"WITH {EV} SELECT event_id, event_type, value FROM ev WHERE event_type IS NOT NULL AND value IS NOT NULL")
def drop_rows_with_nulls(spark, d):
    events = holed_events(spark, d, False).select("event_id", "event_type", "value")
    return C.handle_missing(events, "drop_rows", "event_id")


@query(f"WITH {EV} SELECT event_id, ts, user_id FROM ev")
def drop_columns_with_nulls(spark, d):
    events = holed_events(spark, d, False).select("event_id", "ts", "user_id", "event_type", "value")
    return C.handle_missing(events, "drop_columns", "event_id")


@query(f"""WITH {EV}, t AS (SELECT event_id, value,
           last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER lo AS x0,
           last_value(value IGNORE NULLS) OVER lo AS y0,
           first_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER hi AS x1,
           first_value(value IGNORE NULLS) OVER hi AS y1 FROM ev
           WINDOW lo AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  hi AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
           SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN y0 IS NULL THEN NULL WHEN y1 IS NULL THEN y0
           ELSE y0 + (y1 - y0) / (x1 - x0) * (event_id - x0) END, 6) AS value FROM t""")
def interpolate(spark, d):
    events = holed_events(spark, d, False).select("event_id", "value")
    return rounded(C.handle_missing(events, "interpolate", "event_id"), 6)


@query(f"""WITH {EV}, t AS (SELECT user_id, event_type, value FROM ev), u AS (SELECT *, count(*) AS n FROM t GROUP BY ALL)
           SELECT sum(n)::BIGINT AS n_rows, 3 AS n_columns, (sum(n * ((event_type IS NULL)::INT + (value IS NULL)::INT)))
           ::BIGINT AS missing_values, sum(n - 1)::BIGINT AS duplicates, 2 AS numeric_columns, 1 AS categorical_columns
           FROM u""")
def assess_quality(spark, d):
    return P.assess_quality(holed_events(spark, d, False).select("user_id", "event_type", "value"))


@query(f"""WITH {LI} SELECT unnest(['l_linenumber', 'l_discount', 'l_returnflag', 'l_shipdate']) AS "column",
           unnest(['int', 'double', 'string', 'timestamp_ntz']) AS dtype,
           unnest(['numeric', 'numeric', 'categorical', 'datetime']) AS kind,
           unnest([count(*) - count(l_linenumber), count(*) - count(l_discount), count(*) - count(l_returnflag),
           count(*) - count(l_shipdate)]) AS missing_values FROM li""")
def missing_by_column(spark, d):
    lines = holed_lineitem(spark, d).select("l_linenumber", "l_discount", "l_returnflag", "l_shipdate")
    return P.missing_by_column(lines)


@query(f"""WITH {LI}, a AS (SELECT count(*) AS r, sum((l_discount IS NULL)::INT + (l_tax IS NULL)::INT +
           (l_returnflag IS NULL)::INT)::BIGINT AS m FROM li)
           SELECT 'rows' AS metric, r AS original, r AS processed, 0 AS delta FROM a UNION ALL
           SELECT 'columns', 11, 11, 0 UNION ALL SELECT 'missing_values', m, 0, -m FROM a""")
def compare_tables(spark, d):
    raw = holed_lineitem(spark, d)
    return P.compare_tables(raw, C.impute_static(raw))


@query(f"""WITH {EV}, u AS (SELECT value AS level, event_type AS kind, ts AS stampdate,
           CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id::DOUBLE END AS user_no FROM ev),
           f AS (SELECT avg(level) AS a, avg(user_no) AS b FROM u),
           m AS (SELECT kind AS k FROM u WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
           SELECT round(coalesce(level, a), 6) AS level, coalesce(kind, k) AS kind, stampdate,
           round(coalesce(user_no, b), 6) AS user_no FROM u, f, m""")
def clean_static(spark, d):
    """Full static cleaning: the identifier, the links and the long note are dropped by content."""
    raw = holed_events(spark, d, False).selectExpr(
        "event_id AS `Event ID`", "value AS `Level (%)`", "event_type AS `Kind`", "ts AS `Stamp.Date`",
        "'https://example.com/' || user_id AS link",
        "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS `User No`",
        "repeat(event_type, 12) AS note",
    )
    return rounded(L.clean(raw, "statique", downcast=False), 6)


@query(f"""WITH {EV}, t AS (SELECT event_id AS rn, CAST(ts AS DATE) AS day, event_type AS kind,
           CASE WHEN dayofyear(ts) % 4 = 0 THEN NULL ELSE value END AS level,
           CASE WHEN dayofyear(ts) % 4 = 0 THEN 0::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE user_id::DOUBLE END AS load FROM ev),
           u AS (SELECT min(rn) AS rn, day, kind, level, load FROM t GROUP BY day, kind, level, load),
           g AS (SELECT DISTINCT day FROM u WHERE level <> 0 OR load <> 0), k AS (SELECT u.* FROM u JOIN g USING (day)),
           b AS (SELECT rn // 8 AS b, median(level) AS ml, median(load) AS mo FROM k GROUP BY 1)
           SELECT rn, day::TIMESTAMP AS date, coalesce(kind, 'Unknown') AS kind, round(coalesce(level, ml, 0), 6) AS level,
           round(coalesce(load, mo, 0), 6) AS load FROM k JOIN b ON b.b = rn // 8""")
def clean_frequency(spark, d):
    """Full frequency cleaning on row numbers that survive de-duplication."""
    raw = holed_events(spark, d).selectExpr(
        "_ord", "CAST(ts AS DATE) AS Date", "event_type AS Kind",
        "CASE WHEN dayofyear(ts) % 4 = 0 THEN NULL ELSE value END AS Level",
        "CASE WHEN dayofyear(ts) % 4 = 0 THEN 0.0D WHEN event_id % 5 = 0 THEN NULL ELSE user_id * 1.0D END AS Load",
    )
    out = L.clean(raw, "frequence", 8, downcast=False)
    return rounded(out.withColumnRenamed("_ord", "rn"), 6)


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders""")
def clean_static_without_nulls(spark, d):
    """Without missing values static cleaning drops no column, also no identifier."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return L.clean(orders, "statique", downcast=False)


@query(f"""WITH {EV}, f AS (SELECT avg(value) AS a FROM ev), m AS (SELECT event_type AS k FROM ev WHERE event_type IS NOT
           NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT ts, round(coalesce(value, a), 6) AS value,
           coalesce(event_type, k) AS event_type, props FROM ev, f, m""")
def fitted_clean_plan(spark, d):
    """A plan fitted once and applied as a pure projection."""
    events = holed_events(spark, d, False)
    plan = L.fit_cleaning(events)
    return rounded(plan.transform(events), 6)
