"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from queries.base import EV, holed_events, query, table
from tabprep.functions import labels as B
from tabprep.functions import scalars as S

# Time texts in every accepted form, made from the user number.
_TIME_TEXT = """CASE event_id % 8 WHEN 0 THEN lpad(CAST(user_id % 24 AS VARCHAR(10)), 2, '0') || 'H00'
  WHEN 1 THEN CAST(user_id % 24 AS VARCHAR(10)) || 'h' WHEN 2 THEN CAST(user_id % 24 AS VARCHAR(10)) || ':30'
  WHEN 3 THEN CAST(user_id % 25 AS VARCHAR(10)) WHEN 4 THEN CAST(user_id % 10 * 100 + 215 AS VARCHAR(10))
  WHEN 5 THEN CAST(1000 + user_id % 14 * 100 + event_id % 60 AS VARCHAR(10))
  WHEN 6 THEN ' ' || CAST(user_id % 24 AS VARCHAR(10)) || ' h 5 ' ELSE event_type END"""
_PARSED = """CASE WHEN regexp_full_match(x, '(\\d{1,2})\\s*[Hh:]\\s*(\\d{0,2})') THEN
    lpad(regexp_extract(x, '^(\\d{1,2})', 1), 2, '0') || ':' ||
    lpad(regexp_extract(x, '[Hh:]\\s*(\\d{0,2})$', 1), 2, '0') || ':00'
  WHEN regexp_full_match(x, '\\d+') AND x::INT <= 24 THEN lpad(x, 2, '0') || ':00:00'
  WHEN regexp_full_match(x, '\\d+') THEN
    lpad((x::INT // 100)::VARCHAR, 2, '0') || ':' || lpad((x::INT % 100)::VARCHAR, 2, '0') || ':00'
  ELSE x END"""


@query(f"""WITH t AS (SELECT event_id, trim({_TIME_TEXT}) AS x FROM events)
           SELECT event_id, {_PARSED} AS parsed FROM t""")
def parse_time(spark, d):
    texts = table(spark, d, "events").selectExpr("event_id", f"{_TIME_TEXT} AS x")
    return texts.select("event_id", S.parse_time(F.col("x")).alias("parsed"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
          WHEN event_id % 3 = 1 THEN ' ' || CAST(value AS VARCHAR) || ' ' ELSE CAST(user_id AS VARCHAR) || 'e1' END AS x
          FROM events) SELECT event_id, round(TRY_CAST(trim(x) AS DOUBLE), 6) AS number FROM t""")
def to_number(spark, d):
    texts = table(spark, d, "events").selectExpr(
        "event_id",
        """CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' || CAST(value AS STRING) || ' '
           ELSE CAST(user_id AS STRING) || 'e1' END AS x""",
    )
    return texts.select("event_id", F.round(S.to_number(F.col("x")), 6).alias("number"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_orderdate + INTERVAL 90 MINUTE *
          (CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 1 ELSE 0 END) END AS stamp FROM orders""")
def to_timestamp(spark, d):
    ts = F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm"]
    kind = F.col("o_orderkey") % 6
    text = F.lit("24:00:00 unreadable")
    for i, form in enumerate(forms):
        text = F.when(kind == i, F.date_format(ts, form)).otherwise(text)
    texts = table(spark, d, "orders").select("o_orderkey", text.alias("x"))
    return texts.select("o_orderkey", S.to_timestamp(F.col("x")).alias("stamp"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 24 = 0 THEN NULL ELSE o_orderdate::DATE +
          INTERVAL 1 HOUR * (o_orderkey % 24) END AS stamp FROM orders""")
def combine_date_time(spark, d):
    hour = F.when(F.col("o_orderkey") % 24 == 0, F.lit("no time")).otherwise(
        (F.col("o_orderkey") % 24).cast("string")
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", hour.alias("t"))
    stamp = S.combine_date_time(F.col("o_orderdate"), S.parse_time(F.col("t")))
    return orders.select("o_orderkey", stamp.alias("stamp"))


@query("""SELECT doc_id, regexp_matches(text, '(?i)(the|der|que) ') AS has_word,
          regexp_full_match(lang, '(?i)(EN|de)') AS is_match FROM documents""")
def text_matches(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        S.contains_any(F.col("text"), "(the|der|que) ").alias("has_word"),
        S.full_match(F.col("lang"), "(?i)(EN|de)").alias("is_match"),
    )


@query("""SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS by_hour,
          strftime(date_trunc('day', ts), '%Y-%m-%d') AS by_day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS by_week,
          strftime(date_trunc('month', ts), '%Y-%m') AS by_month FROM events""")
def time_label(spark, d):
    units = [S.time_label(F.col("ts"), u).alias(f"by_{u}") for u in ("hour", "day", "week", "month")]
    return table(spark, d, "events").select("event_id", *units)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_discount - 0.05) < 0.02 AS near,
          round(sqrt(l_extendedprice), 6) AS root, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio FROM lineitem""")
def arithmetic(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        (F.abs(F.col("l_discount") - 0.05) < 0.02).alias("near"),
        S.round_to(F.sqrt("l_extendedprice"), 6).alias("root"),
        S.round_to(S.safe_ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"),
    )


@query(f"""WITH {EV}, t AS (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN 'inf'::DOUBLE WHEN user_id % 5 = 1
           THEN '-inf'::DOUBLE WHEN user_id % 5 = 2 THEN 'nan'::DOUBLE ELSE value END AS v FROM ev)
           SELECT event_id, CASE WHEN isfinite(v) THEN v ELSE -1.0 END AS filled, (event_type = 'click')::INT AS is_click
           FROM t""")
def finite_values(spark, d):
    kind = F.col("user_id") % 5
    v = (
        F.when(kind == 0, F.lit(float("inf")))
        .when(kind == 1, F.lit(float("-inf")))
        .when(kind == 2, F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    events = holed_events(spark, d)
    return events.select(
        "event_id",
        S.finite_or(v, -1.0).alias("filled"),
        S.bool_to_int(F.col("event_type") == "click").alias("is_click"),
    )


def _ladder(value: str, steps) -> str:
    out = " ".join(f"WHEN {value} < {b} THEN '{label}'" for b, label in steps if b is not None)
    return f"CASE {out} ELSE '{steps[-1][1]}' END"


@query(f"""WITH t AS (SELECT event_id, (event_id % 400) / 200.0 - 1.0 AS x FROM events) SELECT event_id,
           {_ladder('abs(x)', B.COHENS_D)} AS d, {_ladder('abs(x) / 4', B.ETA_SQUARED)} AS e,
           {_ladder('abs(x)', B.CRAMERS_V)} AS v, {_ladder('(x * 50 + 50)', B.GRADES)} AS grade FROM t""")
def effect_labels(spark, d):
    x = (F.col("event_id") % 400) / 200.0 - 1.0
    return table(spark, d, "events").select(
        "event_id",
        B.cohens_d_label(x).alias("d"),
        B.eta_squared_label(F.abs(x) / 4).alias("e"),
        B.cramers_v_label(F.abs(x)).alias("v"),
        B.quality_grade(x * 50 + 50).alias("grade"),
    )


@query("""WITH t AS (SELECT event_id, (event_id % 400) / 100.0 - 2.0 AS x FROM events) SELECT event_id,
          CASE WHEN abs(x) < 0.5 THEN 'Approximately symmetric' WHEN x > 0 AND x < 1 THEN 'Right-skewed (positive skew)'
          WHEN x > 0 THEN 'Highly right-skewed' WHEN x > -1 THEN 'Left-skewed (negative skew)' ELSE 'Highly left-skewed' END
          AS s, CASE WHEN abs(x) < 0.5 THEN 'Mesokurtic (normal-like tails)' WHEN x > 0 THEN
          'Leptokurtic (heavy tails, more outliers)' ELSE 'Platykurtic (light tails, fewer outliers)' END AS k,
          CASE WHEN abs(x) < 0.5 THEN 'Symmetric' WHEN x > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS shape,
          CASE WHEN event_id <= 5 THEN 'Very Low' WHEN event_id <= 20 THEN 'Low' WHEN abs(x) * 30 < 50 THEN 'Medium'
          ELSE 'High' END AS card FROM t""")
def shape_labels(spark, d):
    x = (F.col("event_id") % 400) / 100.0 - 2.0
    return table(spark, d, "events").select(
        "event_id",
        B.skewness_label(x).alias("s"),
        B.kurtosis_label(x).alias("k"),
        B.distribution_shape(x).alias("shape"),
        B.cardinality_class(F.col("event_id"), F.abs(x) * 30).alias("card"),
    )
