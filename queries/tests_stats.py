"""Statistical tests; the SQL checks every statistic, p-values are checked by the unit tests."""

from pyspark.sql import functions as F

from queries.base import EV, holed_events, query, rounded, table
from tabprep.operators import stats as T
from tabprep.operators.stats.normality import anderson_darling as anderson
from tabprep.operators.stats.normality import dagostino_pearson as k_squared_test

_P = ("p_value", "reject_null", "error", "levene_p_value", "equal_variances")


def _statistics(df):
    return df.drop(*_P)


def _d(x: str) -> str:
    return f"""CASE WHEN ({x}) IS NULL THEN NULL WHEN abs({x}) < 0.2 THEN 'Negligible effect' WHEN abs({x}) < 0.5 THEN 'Small effect'
    WHEN abs({x}) < 0.8 THEN 'Medium effect' ELSE 'Large effect' END"""


@query(f"""WITH {EV}, s AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM ev
    GROUP BY 1) SELECT event_type, n AS sample_size, round(m, 4) AS sample_mean, 10.0::DOUBLE AS population_mean,
    round(s, 4) AS sample_std, round(s / sqrt(n), 4) AS standard_error, round((m - 10) / (s / sqrt(n)), 4) AS t_statistic,
    round((m - 10) / s, 4) AS cohens_d, {_d('(m - 10) / s')} AS effect_size FROM s""")
def one_sample_ttest(spark, d):
    events = holed_events(spark, d)
    out = T.one_sample_ttest(events, "value", 10.0, by="event_type")
    return _statistics(out)


_TWO = """g AS (SELECT event_type AS k, value AS v FROM ev WHERE event_type IN ('click', 'view')),
  md AS (SELECT k, median(v) AS md FROM g GROUP BY k), z AS (SELECT g.k, abs(v - md) AS z FROM g JOIN md USING (k)
  WHERE v IS NOT NULL), zg AS (SELECT k, count(*) AS n, avg(z) AS m, var_samp(z) AS s2 FROM z GROUP BY k),
  lv AS (SELECT (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - count(*))) AS f
  FROM zg, (SELECT avg(z) AS gm FROM z)), a AS (SELECT count(v) AS n1, avg(v) AS m1, stddev_samp(v) AS s1 FROM g
  WHERE k = 'click'), b AS (SELECT count(v) AS n2, avg(v) AS m2, stddev_samp(v) AS s2 FROM g WHERE k = 'view'),
  s AS (SELECT *, sqrt(((n1 - 1) * s1 ** 2 + (n2 - 1) * s2 ** 2) / (n1 + n2 - 2)) AS sp FROM a, b, lv)"""
_TWO_OUT = """n1 AS group1_size, n2 AS group2_size, round(m1, 4) AS group1_mean, round(m2, 4) AS group2_mean,
  round(s1, 4) AS group1_std, round(s2, 4) AS group2_std, round(m1 - m2, 4) AS mean_difference"""


@query(f"""WITH {EV}, {_TWO} SELECT {_TWO_OUT}, round((m1 - m2) / (sp * sqrt(1 / n1 + 1 / n2)), 4) AS t_statistic,
    (n1 + n2 - 2)::DOUBLE AS dof, round((m1 - m2) / sp, 4) AS cohens_d, {_d('(m1 - m2) / sp')} AS effect_size,
    round(f, 4) AS levene_statistic FROM s""")
def two_sample_ttest(spark, d):
    return _statistics(T.two_sample_ttest(holed_events(spark, d), "value", "event_type", "click", "view"))


@query(f"""WITH {EV}, {_TWO} SELECT {_TWO_OUT}, round((m1 - m2) / sqrt(s1 ** 2 / n1 + s2 ** 2 / n2), 4) AS t_statistic,
    round((s1 ** 2 / n1 + s2 ** 2 / n2) ** 2 / ((s1 ** 2 / n1) ** 2 / (n1 - 1) + (s2 ** 2 / n2) ** 2 / (n2 - 1)), 4) AS dof,
    round((m1 - m2) / sp, 4) AS cohens_d, {_d('(m1 - m2) / sp')} AS effect_size, round(f, 4) AS levene_statistic FROM s""")
def welch_ttest(spark, d):
    return _statistics(
        T.two_sample_ttest(holed_events(spark, d), "value", "event_type", "click", "view", equal_var=False)
    )


@query("""WITH p AS (SELECT l_returnflag, l_discount AS x, l_tax + 0.01 AS y FROM lineitem), s AS (SELECT l_returnflag,
    count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(y - x) AS md, stddev_samp(y - x) AS sd FROM p GROUP BY 1)
    SELECT l_returnflag, n AS n_pairs, round(mx, 4) AS before_mean, round(my, 4) AS after_mean,
    round(md, 4) AS mean_difference, round(sd, 4) AS std_difference, round(-md / (sd / sqrt(n)), 4) AS t_statistic,
    round(md / sd, 4) AS cohens_d, CASE WHEN abs(md / sd) < 0.2 THEN 'Negligible effect' WHEN abs(md / sd) < 0.5
    THEN 'Small effect' WHEN abs(md / sd) < 0.8 THEN 'Medium effect' ELSE 'Large effect' END AS effect_size FROM s""")
def paired_ttest(spark, d):
    lines = table(spark, d, "lineitem").withColumn("y", F.col("l_tax") + 0.01)
    return _statistics(T.paired_ttest(lines, "l_discount", "y", by="l_returnflag"))


_GROUPS = """c AS (SELECT c_mktsegment AS g, c_acctbal + c_nationkey * length(c_mktsegment) AS v FROM customer),
  m AS (SELECT g, count(v) AS n, avg(v) AS m, var_samp(v) AS s2 FROM c GROUP BY g),
  t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * s2) AS ssw FROM m),
  b AS (SELECT sum(m.n * (m.m - t.gm) ** 2) AS ssb FROM m, t),
  md AS (SELECT g, median(v) AS md FROM c GROUP BY g), z AS (SELECT c.g, abs(v - md) AS z FROM c JOIN md USING (g)),
  zm AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS s2 FROM z GROUP BY g),
  lv AS (SELECT (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - count(*))) AS lf
  FROM zm, (SELECT avg(z) AS gm FROM z))"""


def _segments(spark, d):
    v = F.col("c_acctbal") + F.col("c_nationkey") * F.length("c_mktsegment")
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), v.alias("v"))


@query(f"""WITH {_GROUPS} SELECT k AS n_groups, n::BIGINT AS n, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f_statistic,
    round(ssb / (ssb + ssw), 4) AS eta_squared, CASE WHEN ssb / (ssb + ssw) < 0.01 THEN 'Negligible effect'
    WHEN ssb / (ssb + ssw) < 0.06 THEN 'Small effect' WHEN ssb / (ssb + ssw) < 0.14 THEN 'Medium effect'
    ELSE 'Large effect' END AS effect_size, round(lf, 4) AS levene_statistic FROM t, b, lv""")
def one_way_anova(spark, d):
    return _statistics(T.one_way_anova(_segments(spark, d), "v", "g"))


@query(f"WITH {_GROUPS} SELECT g, n, round(m, 4) AS mean, round(sqrt(s2), 4) AS std FROM m")
def group_statistics(spark, d):
    return T.group_statistics(_segments(spark, d), "v", "g")


@query(f"""WITH {_GROUPS} SELECT a.g AS group1, b.g AS group2, round(a.m - b.m, 4) AS mean_difference,
    round(abs(a.m - b.m) / sqrt(ssw / (t.n - k) / 2 * (1 / a.n + 1 / b.n)), 4) AS q_statistic
    FROM m a JOIN m b ON a.g < b.g, t""")
def tukey_pairs(spark, d):
    return _statistics(T.tukey_pairs(_segments(spark, d), "v", "g"))


@query(f"WITH {_GROUPS} SELECT round(lf, 4) AS statistic FROM lv")
def levene(spark, d):
    return _statistics(T.levene(_segments(spark, d), "v", "g"))


def _chi(a: str, b: str, source: str, corrected: bool) -> str:
    gap = "greatest(abs(coalesce(o, 0) - e) - 0.5, 0)" if corrected else "(coalesce(o, 0) - e)"
    return f"""WITH x AS (SELECT {a} AS a, {b} AS b FROM {source}), c AS (SELECT a, b, count(*) AS o FROM x GROUP BY 1, 2),
    r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1),
    t AS (SELECT sum(o)::BIGINT AS n FROM c), f AS (SELECT r.a, k.b, ra * cb / n AS e FROM r, k, t),
    s AS (SELECT sum({gap} ** 2 / e) AS x2, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM f LEFT JOIN c USING (a, b)),
    v AS (SELECT *, sqrt(x2 / (n * least(nr - 1, nc - 1))) AS v FROM s, t)
    SELECT n, nr AS n_rows, nc AS n_columns, round(x2, 4) AS chi_square, (nr - 1) * (nc - 1) AS dof, round(v, 4) AS cramers_v,
    CASE WHEN v < 0.1 THEN 'Negligible association' WHEN v < 0.3 THEN 'Weak association' WHEN v < 0.5 THEN
    'Moderate association' ELSE 'Strong association' END AS effect_size FROM v"""


@query(_chi("p_brand", "p_type", "part", False))
def chi_square_independence(spark, d):
    return _statistics(T.chi_square_independence(table(spark, d, "part"), "p_brand", "p_type"))


@query(_chi("l_linestatus", "(l_quantity > 30)", "lineitem", True))
def chi_square_two_by_two(spark, d):
    lines = table(spark, d, "lineitem").withColumn("large", F.col("l_quantity") > 30)
    return _statistics(T.chi_square_independence(lines, "l_linestatus", "large"))


@query("""WITH c AS (SELECT o_orderpriority AS p, count(*) AS o FROM orders GROUP BY 1), t AS (SELECT count(*) AS k,
    sum(o) AS n FROM c) SELECT k AS n_categories, n::BIGINT AS n, round(sum((o - n / k) ** 2 / (n / k)), 4) AS chi_square,
    k - 1 AS dof FROM c, t GROUP BY k, n""")
def chi_square_goodness_of_fit(spark, d):
    return _statistics(T.chi_square_goodness_of_fit(table(spark, d, "orders"), "o_orderpriority"))


@query(f"""WITH {EV}, g AS (SELECT event_type AS k, value AS v FROM ev WHERE event_type IN ('click', 'view') AND value IS NOT
    NULL), r AS (SELECT k, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM g),
    s AS (SELECT count(*) FILTER (k = 'click') AS n1, count(*) FILTER (k = 'view') AS n2,
    sum(r) FILTER (k = 'click') AS r1, median(v) FILTER (k = 'click') AS m1, median(v) FILTER (k = 'view') AS m2 FROM r)
    SELECT n1 AS group1_size, n2 AS group2_size, round(m1, 4) AS group1_median, round(m2, 4) AS group2_median,
    round((r1 - n1 * (n1 + 1) / 2)::DOUBLE, 4) AS u_statistic,
    round((1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2))::DOUBLE, 4) AS rank_biserial_r FROM s""")
def mann_whitney_u(spark, d):
    return _statistics(T.mann_whitney_u(holed_events(spark, d), "value", "event_type", "click", "view"))


@query("""WITH x AS (SELECT l_linestatus AS k, round(l_tax - l_discount, 2) AS d FROM lineitem),
    r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0 AS r
    FROM x WHERE d <> 0), s AS (SELECT k, count(*) AS n, sum(r) FILTER (d > 0) AS up, median(d) AS m FROM r GROUP BY k)
    SELECT k AS l_linestatus, n AS n_observations, round(m, 4) AS median_difference,
    round(least(up, n * (n + 1) / 2 - up)::DOUBLE, 4) AS w_statistic FROM s""")
def wilcoxon_signed_rank(spark, d):
    lines = table(spark, d, "lineitem").withColumn("gap", F.round(F.col("l_tax") - F.col("l_discount"), 2))
    return _statistics(T.wilcoxon_signed_rank(lines, "gap", by="l_linestatus"))


@query(f"""WITH {EV}, g AS (SELECT event_type AS k, value AS v FROM ev WHERE event_type IS NOT NULL AND value IS NOT NULL),
    r AS (SELECT k, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM g),
    s AS (SELECT k, sum(r) AS r, count(*) AS n FROM r GROUP BY k), t AS (SELECT sum(c * c * c - c) AS t FROM
    (SELECT count(*)::DOUBLE AS c FROM g GROUP BY v)), a AS (SELECT sum(n)::DOUBLE AS n, count(*) AS k,
    sum(r::DOUBLE * r::DOUBLE / n) AS rr FROM s) SELECT k AS n_groups, n::BIGINT AS n,
    round((12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h_statistic FROM a, t""")
def kruskal_wallis(spark, d):
    return _statistics(T.kruskal_wallis(holed_events(spark, d), "value", "event_type"))


_FENCE = """q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY 1), f AS (SELECT *, q1 - 0.3 * (q3 - q1) AS lo, q3 + 0.3 * (q3 - q1) AS hi FROM q)"""


@query(f"""WITH {_FENCE} SELECT l_returnflag, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
    round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
    count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) AS n_outliers,
    round(count(*) FILTER (l_extendedprice < lo OR l_extendedprice > hi) / count(*) * 100, 2) AS outlier_percentage
    FROM lineitem JOIN f USING (l_returnflag) GROUP BY ALL""")
def iqr_report(spark, d):
    return T.iqr_report(table(spark, d, "lineitem"), "l_extendedprice", 0.3, by="l_returnflag")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(spark, d):
    return T.iqr_outliers(table(spark, d, "events").select("event_id", "value"), "value")


@query(f"""WITH {EV}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM ev) SELECT round(any_value(m), 4) AS mean,
    round(any_value(s), 4) AS std, count(*) FILTER (abs((value - m) / s) > 2.5) AS n_outliers,
    round(count(*) FILTER (abs((value - m) / s) > 2.5) / count(value) * 100, 2) AS outlier_percentage FROM ev, s""")
def zscore_report(spark, d):
    return _statistics(T.zscore_report(holed_events(spark, d), "value", 2.5))


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
    SELECT event_id, round((value - m) / s, 6) AS z_score FROM events JOIN s USING (event_type)
    WHERE abs((value - m) / s) > 2.5""")
def zscore_outliers(spark, d):
    out = T.zscore_outliers(table(spark, d, "events").select("event_id", "event_type", "value"), "value", 2.5, "event_type")
    return rounded(out.select("event_id", "z_score"), 6)


@query(f"""WITH {EV}, s AS (SELECT event_type, count(value) AS n, avg(value) AS m FROM ev GROUP BY 1), p AS (
    SELECT s.event_type, any_value(n) AS n, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3,
    avg((value - m) ** 4) AS m4 FROM ev JOIN s ON s.event_type IS NOT DISTINCT FROM ev.event_type GROUP BY 1),
    k AS (SELECT event_type, n, m3 / m2 ** 1.5 AS s, m4 / m2 ** 2 - 3 AS k FROM p)
    SELECT event_type, n, round(s, 4) AS skewness, CASE WHEN s IS NULL THEN NULL WHEN abs(s) < 0.5 THEN 'Approximately symmetric' WHEN s > 0 AND s < 1
    THEN 'Right-skewed (positive skew)' WHEN s > 0 THEN 'Highly right-skewed' WHEN s > -1 THEN 'Left-skewed (negative skew)'
    ELSE 'Highly left-skewed' END AS skewness_label, round(k, 4) AS kurtosis, CASE WHEN k IS NULL THEN NULL WHEN abs(k) < 0.5 THEN
    'Mesokurtic (normal-like tails)' WHEN k > 0 THEN 'Leptokurtic (heavy tails, more outliers)' ELSE
    'Platykurtic (light tails, fewer outliers)' END AS kurtosis_label FROM k""")
def skewness_kurtosis(spark, d):
    return T.skewness_kurtosis(holed_events(spark, d), "value", by="event_type")


def normality(spark, d):
    """Vote of the normality tests per user; one small sample per user."""
    return T.normality(table(spark, d, "events"), "value", by="user_id")


query()(normality)


# Phi(|z|) by its power series; samples of a user hold no z beyond 5, where 1 - Phi would lose digits.
_UPPER = """0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(abs(z), 1e-300))
  - (lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1))) for k in range(0, 150)])"""


@query(f"""WITH e AS (SELECT user_id, value AS x FROM events WHERE value IS NOT NULL), s AS (SELECT user_id, avg(x) AS m, stddev_samp(x) AS sd,
    count(*)::DOUBLE AS n FROM e GROUP BY user_id HAVING count(*) >= 8 AND stddev_samp(x) > 0), r AS (SELECT user_id, n, (x - m) / sd AS z,
    row_number() OVER (PARTITION BY user_id ORDER BY x) AS i FROM e JOIN s USING (user_id)), u AS (SELECT *, {_UPPER} AS up FROM r),
    l AS (SELECT *, CASE WHEN z >= 0 THEN ln(up) ELSE ln(1 - up) END AS low, CASE WHEN z >= 0 THEN ln(1 - up) ELSE ln(up) END AS high FROM u),
    a AS (SELECT user_id, n, -n - sum((2 * i - 1) * low + (2 * (n - i) + 1) * high) / n AS a2, round(0.752 / (1 + 0.75 / n + 2.25 / (n * n)), 3) AS c
    FROM l GROUP BY user_id, n) SELECT user_id, round(a2, 6) AS statistic, c AS critical_value_5pct, a2 < c AS is_normal FROM a""")
def anderson_darling(spark, d):
    """One small sample per user."""
    return anderson(table(spark, d, "events"), "value", by="user_id")


@query("""WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, count(value)::DOUBLE AS n FROM events GROUP BY event_type
    HAVING count(value) >= 20), g AS (SELECT event_type, n, avg(((value - m) / sd) ** 3) AS skew, avg(((value - m) / sd) ** 4) AS kurt FROM events
    JOIN m USING (event_type) WHERE value IS NOT NULL GROUP BY event_type, n),
    b AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) /
    ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2, (kurt - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) *
    (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM g),
    c AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS a FROM b),
    k AS (SELECT event_type, z1 ** 2 + ((1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM c)
    SELECT event_type, round(k2, 4) AS statistic, round(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) > 0.05 AS is_normal FROM k""")
def dagostino_pearson(spark, d):
    """Skewness and kurtosis of each type of event."""
    return rounded(k_squared_test(table(spark, d, "events"), "value", by="event_type"), 4, "statistic")
