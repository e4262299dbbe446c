"""Quality reports and profiles."""

from pyspark.sql import functions as F

from queries.base import EV, LI, holed_events, holed_lineitem, query, rounded, table
from tabprep.operators import profile as P

_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_REPORTED = ("l_orderkey", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
_TYPES = {"l_orderkey": "bigint", "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string",
          "l_shipdate": "timestamp_ntz"}


def _per_column(template: str, names) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS unique_count, count(*) AS n FROM li""" for c in _REPORTED)


def _reported(spark, d):
    # One constant column and one nearly unique text column are added to trigger every issue.
    return holed_lineitem(spark, d).select(*_REPORTED)


@query(f"WITH {LI}, c AS ({_COUNTS}) SELECT * EXCLUDE (n) FROM c")
def column_info(spark, d):
    return P.column_info(_reported(spark, d))


_CUSTOMER = """cu AS (SELECT c_name, 'X' AS kind, CASE WHEN c_custkey % 10 < 7 THEN NULL ELSE c_acctbal END AS most_null,
  CASE WHEN c_custkey % 10 < 3 THEN NULL ELSE c_mktsegment END AS some_null, c_nationkey FROM customer)"""
_ISSUES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS unique_count, count(*) AS n, {'true' if t == 'string' else 'false'} AS is_text FROM cu"""
    for c, t in (("c_name", "string"), ("kind", "string"), ("most_null", "double"), ("some_null", "string"),
                 ("c_nationkey", "int")))
_REPORT = f"""WITH {_CUSTOMER}, c AS ({_ISSUES}), p AS (SELECT *, round(null_count / n * 100, 2) AS null_percentage,
  round(unique_count / n * 100, 2) AS unique_percentage FROM c), i AS (SELECT *,
  CASE WHEN null_percentage > 50 THEN 'High missing values (>50%)' WHEN null_percentage > 20 THEN
  'Moderate missing values (>20%)' END AS i1, CASE WHEN unique_count = 1 THEN 'Constant column (single value)'
  WHEN unique_percentage < 1 AND n > 100 THEN 'Very low cardinality' END AS i2, CASE WHEN is_text AND
  unique_percentage > 95 THEN 'Potentially unique identifier' END AS i3 FROM p), r AS (SELECT *,
  concat_ws('; ', i1, i2, i3) AS issues FROM i)"""


def _customers(spark, d):
    key = F.col("c_custkey") % 10
    return table(spark, d, "customer").select(
        "c_name",
        F.lit("X").alias("kind"),
        F.when(key >= 7, F.col("c_acctbal")).alias("most_null"),
        F.when(key >= 3, F.col("c_mktsegment")).alias("some_null"),
        "c_nationkey",
    )


@query(f"""{_REPORT} SELECT "column", dtype, non_null_count, null_count, null_percentage, unique_count,
           unique_percentage, issues, issues <> '' AS has_issues FROM r""")
def quality_report(spark, d):
    return P.quality_report(_customers(spark, d)).withColumn("issues", F.array_join("issues", "; "))


@query(f"""{_REPORT}, s AS (SELECT max(n) AS total_rows, count(*) AS total_columns, sum(n)::BIGINT AS total_cells,
           sum(null_count)::BIGINT AS total_missing, count(*) FILTER (unique_count = 1) AS constant_columns,
           count(*) FILTER (issues <> '') AS columns_with_issues,
           count(*) FILTER (null_percentage > 50) AS high_missing_columns FROM r), q AS (SELECT *,
           (1 - total_missing / total_cells) * 100 AS c, (1 - constant_columns / total_columns) * 100 AS u FROM s)
           SELECT total_rows, total_columns, total_cells, total_missing,
           round(total_missing / total_cells * 100, 2) AS missing_percentage, round(c * 0.6 + u * 0.4, 1) AS overall,
           round(c, 1) AS completeness, round(u, 1) AS uniqueness, CASE WHEN c * 0.6 + u * 0.4 >= 90 THEN 'A'
           WHEN c * 0.6 + u * 0.4 >= 80 THEN 'B' WHEN c * 0.6 + u * 0.4 >= 70 THEN 'C'
           WHEN c * 0.6 + u * 0.4 >= 60 THEN 'D' ELSE 'F' END AS grade, 2 AS numeric_columns, 3 AS categorical_columns,
           0 AS datetime_columns, 0 AS boolean_columns, columns_with_issues, high_missing_columns, constant_columns
           FROM q""")
def quality_score(spark, d):
    return P.quality_score(_customers(spark, d))


_Q4 = """round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis"""


@query(f"""WITH {LI}, t AS ({_per_column('''SELECT '{c}' AS "column", typeof(any_value({c})) AS ty, count({c}) AS "count",
    round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min,
    round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3,
    round(max({c}), 4)::DOUBLE AS max, round(max({c}) - min({c}), 4)::DOUBLE AS range,
    round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, ''' + _Q4 + ''',
    count(*) FILTER ({c} = 0) AS zeros_count,
    round(count(*) FILTER ({c} = 0) / count({c}) * 100, 2) AS zeros_percentage, count(*) FILTER ({c} < 0) AS negative_count,
    round(count(*) FILTER ({c} < 0) / count({c}) * 100, 2) AS negative_percentage FROM li''', _NUMBERS)})
    SELECT * EXCLUDE (ty), CASE ty WHEN 'INTEGER' THEN 'int' ELSE 'double' END AS dtype,
    CASE WHEN abs(skewness) < 0.5 THEN 'Symmetric' WHEN skewness > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END
    AS distribution_shape FROM t""")
def numeric_profile(spark, d):
    return P.numeric_profile(holed_lineitem(spark, d), _NUMBERS)


_PART_TEXT = ("p_brand", "p_type", "p_name")
_FREQ = f"""f AS ({_per_column('''SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM part GROUP BY {c}''', _PART_TEXT)}),
  k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM f)"""


@query(f"""WITH {_FREQ} SELECT "column", sum(n)::BIGINT AS "count", count(*) AS unique_count,
    round(count(*) / sum(n) * 100, 2) AS unique_percentage, max(value) FILTER (rank = 1) AS mode,
    max(n) FILTER (rank = 1) AS mode_frequency, round(max(n) FILTER (rank = 1) / sum(n) * 100, 2) AS mode_percentage,
    CASE WHEN count(*) <= 5 THEN 'Very Low' WHEN count(*) <= 20 THEN 'Low' WHEN count(*) / sum(n) * 100 < 50 THEN 'Medium'
    ELSE 'High' END AS cardinality FROM k GROUP BY "column" """)
def categorical_profile(spark, d):
    return P.categorical_profile(table(spark, d, "part"), _PART_TEXT).drop("top_5_values")


@query(f"""WITH {_FREQ} SELECT "column", rank::INT AS rank, value, n FROM k WHERE rank <= 5""")
def top_frequencies(spark, d):
    return P.top_frequencies(table(spark, d, "part"), _PART_TEXT, 5)


@query(f"""WITH {EV}, f AS (SELECT 'event_type' AS "column", event_type AS v, count(*) AS n FROM ev GROUP BY 2 UNION ALL
    SELECT 'props', props, count(*) FROM ev GROUP BY 2), m AS (SELECT "column", v FROM f WHERE v IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) = 1)
    SELECT "column", count(f.v) AS unique_count, max(m.v) AS most_frequent,
    coalesce(sum(n) FILTER (f.v IS NULL), 0)::BIGINT AS missing_values FROM f JOIN m USING ("column") GROUP BY "column" """)
def categorical_summary(spark, d):
    return P.categorical_summary(holed_events(spark, d), ["event_type", "props"])


_PRICE = """pr AS (SELECT p_size, p_retailprice, p_retailprice * 2 + p_size * 0.01 AS twice, p_size * 1.0 - 0.1 * p_partkey
  AS mixed FROM part)"""
_PRICE_NAMES = ("p_size", "p_retailprice", "twice", "mixed")


def _prices(spark, d):
    return table(spark, d, "part").select(
        "p_size",
        "p_retailprice",
        (F.col("p_retailprice") * 2 + F.col("p_size") * 0.01).alias("twice"),
        (F.col("p_size") * 1.0 - 0.1 * F.col("p_partkey")).alias("mixed"),
    )


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM pr"
    for i, a in enumerate(_PRICE_NAMES) for b in _PRICE_NAMES[i + 1 :])


@query(f"""WITH {_PRICE}, c AS ({_CORR}) SELECT a AS feature_1, b AS feature_2, round(r, 4) AS correlation,
    round(abs(r), 4) AS abs_correlation FROM c WHERE abs(r) >= 0.85""")
def multicollinearity(spark, d):
    return P.multicollinearity(_prices(spark, d), 0.85)


@query(f"WITH {_PRICE}, c AS ({_CORR}) SELECT DISTINCT b AS feature FROM c WHERE abs(r) >= 0.85")
def redundant_features(spark, d):
    return P.redundant_features(_prices(spark, d), 0.85)


@query(f"WITH {_PRICE}, c AS ({_CORR}) SELECT a AS var1, b AS var2, round(r, 3) AS r FROM c WHERE abs(r) > 0.3")
def high_correlations(spark, d):
    return P.high_correlations(_prices(spark, d), 0.3)


@query(f"""WITH {LI} {_per_column('''SELECT '{c}' AS "column", round(var_samp({c}), 4) AS variance,
    round(stddev_samp({c}), 4) AS std_dev, round(stddev_samp({c}) / abs(avg({c})) * 100, 2) AS coefficient_of_variation,
    var_samp({c}) < 0.01 AS is_low_variance, var_samp({c}) = 0 AS is_constant FROM li''', _NUMBERS)}""")
def variance_analysis(spark, d):
    return P.variance_analysis(holed_lineitem(spark, d), _NUMBERS)


@query(f"""WITH {LI} {_per_column('''SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 5) AS mean,
    round(stddev_samp({c}), 5) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 5) AS q25,
    round(median({c}), 5) AS q50, round(quantile_cont({c}, 0.75), 5) AS q75, max({c})::DOUBLE AS max FROM li''', _NUMBERS)}""")
def describe(spark, d):
    return rounded(P.describe(holed_lineitem(spark, d), _NUMBERS), 5)


@query(f"""WITH {LI} {_per_column('''SELECT '{c}' AS "column", round(median({c}), 4) AS median,
    (SELECT {c}::DOUBLE FROM li WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
    round(var_samp({c}), 4) AS variance, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
    round(max({c}) - min({c}), 4)::DOUBLE AS range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
    count(*) - count({c}) AS null_count, count(*) FILTER ({c} = 0) AS zero_count FROM li''', _NUMBERS)}""")
def extended_summary(spark, d):
    return rounded(P.extended_summary(holed_lineitem(spark, d), _NUMBERS), 4)


@query(f"""WITH {EV} SELECT 'value' AS "column", 8 AS count_columns, count(*) - count(value) AS missing_values,
    round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max,
    count(DISTINCT value) AS unique_count,
    (SELECT list(value ORDER BY event_id)[1:3] FROM ev WHERE value IS NOT NULL) AS sample_values, 'double' AS dtype
    FROM ev UNION ALL SELECT 'user_id', 8, count(*) - count(user_id), round(avg(user_id), 5),
    round(stddev_samp(user_id), 5), min(user_id), max(user_id), count(DISTINCT user_id),
    (SELECT list(user_id::DOUBLE ORDER BY event_id)[1:3] FROM ev), 'bigint' FROM ev""")
def available_targets(spark, d):
    out = P.available_targets(holed_events(spark, d), columns=["value", "user_id"])
    return rounded(out, 5, "mean", "std").withColumn("count_columns", F.lit(8))


@query(f"""WITH {EV} SELECT 'value' AS "column", count(value) AS "count", round(avg(value), 5) AS mean,
    round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max, NULL::BIGINT AS "unique", NULL AS top,
    count(*) - count(value) AS missing FROM ev UNION ALL SELECT 'event_type', count(event_type), NULL, NULL, NULL, NULL,
    count(DISTINCT event_type), (SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 1), count(*) - count(event_type) FROM ev""")
def basic_stats(spark, d):
    return rounded(P.basic_stats(holed_events(spark, d), ["value", "event_type"]), 5, "mean", "std")


@query(f"""WITH {LI}, q AS (SELECT quantile_cont(l_discount, 0.25) AS a, quantile_cont(l_discount, 0.75) AS b FROM li)
    SELECT count(*) AS n_rows, min(l_discount) AS x_min, max(l_discount) AS x_max, max(l_discount) - min(l_discount)
    AS x_range, count(*) FILTER (l_discount < a - 1.5 * (b - a) OR l_discount > b + 1.5 * (b - a)) AS x_outliers,
    round(corr(l_discount, l_tax), 6) AS r, 'weak' AS strength,
    CASE WHEN corr(l_discount, l_tax) > 0 THEN 'positive' ELSE 'negative' END AS direction,
    count(*) - count(l_discount) AS x_missing, round((count(*) - count(l_discount)) / count(*) * 100, 1) AS x_missing_pct,
    count(*) - count(l_tax) AS y_missing, round((count(*) - count(l_tax)) / count(*) * 100, 1) AS y_missing_pct
    FROM li, q""")
def plot_insights(spark, d):
    return rounded(P.plot_insights(holed_lineitem(spark, d), "l_discount", "l_tax"), 6, "r")


@query(f"""WITH {EV} SELECT count(*) AS n_rows, 6 AS n_columns, 3 AS numeric_columns, round(((count(*) - count(value)) +
    (count(*) - count(event_type))) / (count(*) * 6) * 100, 1) AS missing_pct FROM ev""")
def overview(spark, d):
    return P.overview(holed_events(spark, d, False))
