"""Normality tests and their vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.normal import first_normal_quantile, log_normal_cdf, polynomial, refined_quantile
from tabprep.functions.pvalues import chi2_pvalue, k_squared_statistic
from tabprep.functions.types import as_list, col
from tabprep.operators.ordering import value_ranks
from tabprep.operators.stats.common import attach, cols, error_when, r6

# Sample sizes at which each test applies.
MIN_SAMPLE = 8
SHAPIRO_MAX = 5000
K2_MIN = 20
# 5 % point and size correction of the Anderson-Darling statistic for a normal with
# estimated mean and variance (D'Agostino & Stephens 1986, table 4.7).
ANDERSON_5PCT = 0.752
ANDERSON_CORRECTION = (0.75, 2.25)
# Weights of the two outermost values by falling power of 1 / sqrt(n), and the transformation of W to a
# normal deviate, mean and log deviation by falling power of n (up to 11 values) or ln n (Royston 1995).
SHAPIRO_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
SHAPIRO_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
SHAPIRO_FEW = 11
SHAPIRO_BOUND = (0.459, -2.273)
SHAPIRO_FEW_NORMAL = ((-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822))
SHAPIRO_NORMAL = ((0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803))


def shapiro(df: DataFrame, value: str, alpha: float = 0.05, by=None) -> DataFrame:
    """Shapiro-Wilk per key with 8 to 5000 values; other keys give no row.

    The weights follow from ranks and group size, so W is one grouped sum: the ends of the sorted values with their own
    weights, the middle with normal quantiles. Only groups that are tested are sorted, and none has more than 5000 rows.
    """
    keys = as_list(by)
    x = df.filter(col(value).isNotNull()).select(*cols(keys), col(value).cast("double").alias("_x"))
    x = x.withColumn("_k", F.lit(1))
    sizes = x.groupBy(*cols(keys), "_k").agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mean"))
    fitting = sizes.filter(F.col("_n").between(MIN_SAMPLE, SHAPIRO_MAX))
    small = attach(x, fitting, [*keys, "_k"])
    order = Window.partitionBy(*cols(keys), "_k").orderBy("_x")
    placed = small.select(
        *cols(keys), "_k", F.col("_n").cast("double").alias("_n"), (F.col("_x") - F.col("_mean")).alias("_x"), F.row_number().over(order).alias("_i")
    )
    placed = placed.withColumn("_p", (F.col("_i") - 0.375) / (F.col("_n") + 0.25))
    placed = placed.withColumn("_q", first_normal_quantile(F.col("_p"))).withColumn("_m", refined_quantile(F.col("_q"), F.col("_p")))
    i, n, m, v = F.col("_i"), F.col("_n"), F.col("_m"), F.col("_x")
    sums = placed.groupBy(*cols(keys), "_k", "_n").agg(
        F.sum(m * m).alias("_ssm"), F.sum(v * v).alias("_total"), F.sum(F.when((i > 2) & (i < n - 1), m * v)).alias("_middle"),
        F.max(F.when(i == n, m)).alias("_m1"), F.max(F.when(i == n - 1, m)).alias("_m2"),
        (F.max(F.when(i == n, v)) - F.max(F.when(i == 1, v))).alias("_ends"),
        (F.max(F.when(i == n - 1, v)) - F.max(F.when(i == 2, v))).alias("_inner"),
    )
    u, root = 1 / F.sqrt(n), F.sqrt("_ssm")
    weighted = sums.withColumns({
        "_a1": polynomial([*SHAPIRO_LAST, F.col("_m1") / root], u), "_a2": polynomial([*SHAPIRO_SECOND, F.col("_m2") / root], u),
    })
    a1, a2 = F.col("_a1"), F.col("_a2")
    scale = (F.col("_ssm") - 2 * F.col("_m1") ** 2 - 2 * F.col("_m2") ** 2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    b = a1 * F.col("_ends") + a2 * F.col("_inner") + F.col("_middle") / F.sqrt(scale)
    tested = weighted.withColumn("_w", F.when(F.col("_total") == 0, 1.0).otherwise(F.least(F.lit(1.0), b * b / F.col("_total"))))
    ln, y = F.log(n), F.log1p(-F.col("_w"))
    few, (mean_few, sd_few), (mean, sd) = n <= SHAPIRO_FEW, SHAPIRO_FEW_NORMAL, SHAPIRO_NORMAL
    bound = polynomial(SHAPIRO_BOUND, n)
    tested = tested.withColumn("_z", -F.when(few, (-F.log(bound - y) - polynomial(mean_few, n)) / F.exp(polynomial(sd_few, n))).otherwise(
        (y - polynomial(mean, ln)) / F.exp(polynomial(sd, ln))
    ))
    p = F.when(F.col("_total") == 0, 1.0).when(few & (y >= bound), 1e-99).when(F.col("_w") == 1, 1.0).otherwise(F.exp(log_normal_cdf(F.col("_z"))))
    return tested.withColumn("_p", p).select(
        *cols(keys),
        r6(F.col("_w")).alias("statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") > alpha).alias("is_normal"),
    )


def dagostino_pearson(df: DataFrame, value: str, alpha: float = 0.05, by=None) -> DataFrame:
    """K squared from skewness and kurtosis for keys with at least 20 values."""
    keys = as_list(by)
    x = col(value).cast("double")
    s = df.groupBy(*cols(keys)).agg(F.count(x).alias("_n"), F.skewness(x).alias("_skew"), F.kurtosis(x).alias("_kurt"))
    s = s.filter(F.col("_n") >= K2_MIN)
    tested = s.withColumn("_s", k_squared_statistic(F.col("_n"), F.col("_skew"), F.col("_kurt")))
    tested = tested.withColumn("_p", chi2_pvalue(F.col("_s"), F.lit(2)))
    return tested.select(
        *cols(keys),
        r6(F.col("_s")).alias("statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") > alpha).alias("is_normal"),
    )


def anderson_darling(df: DataFrame, value: str, by=None) -> DataFrame:
    """Anderson-Darling against the 5 % point, in one pass over ranked distinct values.

    A value with m copies at ranks b+1 .. b+m adds m(2b+m) ln F(z) and ((n-b)^2-(n-b-m)^2) ln(1-F(z)).
    """
    keys = as_list(by)
    x = df.select(*cols(keys), col(value).cast("double").alias("_x"))
    moments = x.groupBy(*cols(keys)).agg(
        F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_std"), F.count("_x").alias("_n")
    )
    ranked = attach(value_ranks(x, "_x", keys), moments, keys).filter((F.col("_std") > 0) & (F.col("_n") >= MIN_SAMPLE))
    ranked = ranked.withColumn("_z", (F.col("_x") - F.col("_mean")) / F.col("_std"))
    z = F.col("_z")
    m, b, n = (F.col(c).cast("double") for c in ("n", "before", "total"))
    term = m * (2 * b + m) * log_normal_cdf(z) + ((n - b) * (n - b) - (n - b - m) * (n - b - m)) * log_normal_cdf(-z)
    s = ranked.groupBy(*cols(keys)).agg(F.sum(term).alias("_t"), F.max("_n").cast("double").alias("_n"))
    a2 = -F.col("_n") - F.col("_t") / F.col("_n")
    c1, c2 = ANDERSON_CORRECTION
    critical = F.lit(ANDERSON_5PCT) / (1 + c1 / F.col("_n") + c2 / (F.col("_n") * F.col("_n")))
    tested = s.withColumn("_a", a2).withColumn("_c", F.round(critical, 3))
    return tested.select(
        *cols(keys),
        r6(F.col("_a")).alias("statistic"),
        F.col("_c").alias("critical_value_5pct"),
        (F.col("_a") < F.col("_c")).alias("is_normal"),
    )


def normality(df: DataFrame, value: str, alpha: float = 0.05, by=None) -> DataFrame:
    """Vote of the applicable tests; more than half must call the data normal."""
    keys = as_list(by)
    keyed = df.withColumn("_all", F.lit(1)) if not keys else df
    group = keys or ["_all"]
    sizes = keyed.groupBy(*cols(group)).agg(F.count(col(value)).alias("sample_size"))
    out = sizes
    for name, test in (
        ("shapiro_wilk", shapiro(keyed, value, alpha, group)),
        ("dagostino_pearson", dagostino_pearson(keyed, value, alpha, group)),
        ("anderson_darling", anderson_darling(keyed, value, group)),
    ):
        part = test.select(
            *[col(k).alias(f"_key{i}") for i, k in enumerate(group)],
            F.col("statistic").alias(f"{name}_statistic"),
            (F.col("p_value") if "p_value" in test.columns else F.lit(None).cast("double")).alias(f"{name}_p_value"),
            F.col("is_normal").alias(f"{name}_is_normal"),
        )
        match = None
        for i, k in enumerate(group):
            same = col(k).eqNullSafe(F.col(f"_key{i}"))
            match = same if match is None else match & same
        out = out.join(part, match, "left").drop(*[f"_key{i}" for i in range(len(group))])
    out = out.drop("anderson_darling_p_value")
    flags = [F.col(f"{t}_is_normal") for t in ("shapiro_wilk", "dagostino_pearson", "anderson_darling")]
    enough = F.col("sample_size") >= MIN_SAMPLE
    votes = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    tests = sum((f.isNotNull().cast("int") for f in flags), F.lit(0))
    out = out.withColumn("normal_tests", votes).withColumn("total_tests", tests)
    verdict = F.when(enough & (F.col("total_tests") > 0), F.col("normal_tests") > F.col("total_tests") / 2)
    out = out.withColumn("is_normal", verdict).withColumn(
        "error", error_when(~enough, "Insufficient data for normality testing (need at least 8 observations)")
    )
    return out if keys else out.drop("_all")
