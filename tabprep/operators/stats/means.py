"""t tests, analysis of variance, Levene and post-hoc comparisons from counts, means and variances."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.labels import cohens_d_label, eta_squared_label
from tabprep.functions.pvalues import f_pvalue, t_pvalue, tukey_pvalue
from tabprep.functions.scalars import safe_ratio
from tabprep.functions.types import as_list, col
from tabprep.operators.aggregates import MAX_LEVELS
from tabprep.operators.ordering import value_ranks
from tabprep.operators.stats.common import attach, cols, error_when, r4, r6


def one_sample_ttest(
    df: DataFrame, value: str, mean: float, alpha: float = 0.05, alternative: str = "two-sided", by=None
) -> DataFrame:
    """One-sample t test and Cohen's d."""
    keys = as_list(by)
    x = col(value).cast("double")
    s = df.groupBy(*cols(keys)).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    n, m, sd = F.col("n"), F.col("m"), F.col("s")
    se = sd / F.sqrt(n)
    t = F.when(n >= 2, safe_ratio(m - F.lit(float(mean)), se))
    d = F.when(n >= 2, safe_ratio(m - F.lit(float(mean)), sd))
    tested = s.withColumn("_t", t).withColumn("_d", d).withColumn("_se", se)
    tested = tested.withColumn("_p", t_pvalue(F.col("_t"), n - 1, alternative))
    return tested.select(
        *cols(keys),
        n.alias("sample_size"),
        r4(m).alias("sample_mean"),
        F.lit(float(mean)).alias("population_mean"),
        r4(sd).alias("sample_std"),
        r4(F.col("_se")).alias("standard_error"),
        r4(F.col("_t")).alias("t_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.col("_d")).alias("cohens_d"),
        cohens_d_label(F.col("_d")).alias("effect_size"),
        error_when(n < 2, "Insufficient data for t-test"),
    )


def two_sample_ttest(
    df: DataFrame,
    value: str,
    group: str,
    first,
    second,
    alpha: float = 0.05,
    equal_var: bool = True,
    alternative: str = "two-sided",
    by=None,
) -> DataFrame:
    """Student's or Welch's t test of two groups, pooled Cohen's d and Levene's test."""
    keys = as_list(by)
    both = df.filter(col(group).isin([first, second]))
    x = col(value).cast("double")
    parts = []
    for i, g in ((1, first), (2, second)):
        v = F.when(col(group) == F.lit(g), x)
        parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    s = both.groupBy(*cols(keys)).agg(*parts)
    n1, n2, m1, m2 = (F.col(k) for k in ("n1", "n2", "m1", "m2"))
    v1, v2 = F.col("s1") * F.col("s1"), F.col("s2") * F.col("s2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    enough = (n1 >= 2) & (n2 >= 2)
    if equal_var:
        se, dof = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        a, b = v1 / n1, v2 / n2
        se, dof = F.sqrt(a + b), F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))
    t = F.when(enough, safe_ratio(m1 - m2, se))
    d = F.when(enough, F.coalesce(safe_ratio(m1 - m2, F.sqrt(pooled)), F.lit(0.0)))
    tested = s.withColumn("_t", t).withColumn("_d", d).withColumn("_dof", F.when(enough, dof))
    tested = tested.withColumn("_p", t_pvalue(F.col("_t"), F.col("_dof"), alternative))
    spread = levene(both, value, group, by=keys).select(
        *cols(keys), F.col("statistic").alias("_ls"), F.col("p_value").alias("_lp")
    )
    joined = attach(tested, spread, keys)
    return joined.select(
        *cols(keys),
        n1.alias("group1_size"),
        n2.alias("group2_size"),
        r4(m1).alias("group1_mean"),
        r4(m2).alias("group2_mean"),
        r4(F.col("s1")).alias("group1_std"),
        r4(F.col("s2")).alias("group2_std"),
        r4(m1 - m2).alias("mean_difference"),
        r4(F.col("_t")).alias("t_statistic"),
        r4(F.col("_dof")).alias("dof"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.col("_d")).alias("cohens_d"),
        cohens_d_label(F.col("_d")).alias("effect_size"),
        F.col("_ls").alias("levene_statistic"),
        F.col("_lp").alias("levene_p_value"),
        (F.col("_lp") > 0.05).alias("equal_variances"),
        error_when(~enough, "Insufficient data in one or both groups"),
    )


def paired_ttest(
    df: DataFrame, before: str, after: str, alpha: float = 0.05, alternative: str = "two-sided", by=None
) -> DataFrame:
    """Paired t test; t is of before - after, the mean difference of after - before."""
    keys = as_list(by)
    pairs = df.filter(col(before).isNotNull() & col(after).isNotNull())
    a, b = col(before).cast("double"), col(after).cast("double")
    s = pairs.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("ma"),
        F.avg(b).alias("mb"),
        F.avg(b - a).alias("md"),
        F.stddev_samp(b - a).alias("sd"),
    )
    n, md, sd = F.col("n"), F.col("md"), F.col("sd")
    t = F.when(n >= 2, safe_ratio(-md, sd / F.sqrt(n)))
    d = F.when(n >= 2, F.coalesce(safe_ratio(md, sd), F.lit(0.0)))
    tested = s.withColumn("_t", t).withColumn("_d", d)
    tested = tested.withColumn("_p", t_pvalue(F.col("_t"), n - 1, alternative))
    return tested.select(
        *cols(keys),
        n.alias("n_pairs"),
        r4(F.col("ma")).alias("before_mean"),
        r4(F.col("mb")).alias("after_mean"),
        r4(md).alias("mean_difference"),
        r4(sd).alias("std_difference"),
        r4(F.col("_t")).alias("t_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.col("_d")).alias("cohens_d"),
        cohens_d_label(F.col("_d")).alias("effect_size"),
        error_when(n < 2, "Insufficient paired observations"),
    )


def _group_moments(df: DataFrame, value: str | Column, group: str, keys: list[str]) -> DataFrame:
    """(keys, group, n, mean, var) of the groups with at least two values."""
    x = (col(value) if isinstance(value, str) else value).cast("double")
    grouped = df.filter(col(group).isNotNull()).groupBy(*cols(keys), col(group))
    moments = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    # Naming all three keeps them in every use of the moments, so Spark runs one aggregation for all uses.
    return moments.filter((F.col("n") >= 2) & F.col("mean").isNotNull() & F.col("var").isNotNull())


def group_statistics(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """(keys, group, n, mean, std) of the tested groups."""
    keys = as_list(by)
    return _group_moments(df, value, group, keys).select(
        *cols(keys), col(group), "n", r4(F.col("mean")).alias("mean"), r4(F.sqrt("var")).alias("std")
    )


def _variance_ratio(moments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, n, ssb, ssw, f) from group moments; sums around the grand mean avoid cancellation."""
    centre = moments.groupBy(*cols(keys)).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    gap = F.col("mean") - F.col("_grand")
    sums = (
        attach(moments, centre, keys)
        .groupBy(*cols(keys))
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * gap * gap).alias("ssb"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
        )
    )
    f = safe_ratio(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return sums.withColumn("f", F.when(F.col("k") >= 2, f))


def _median_sides(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: its median and the sum of the distances to it, from one ranking of the distinct values.

    Values up to the lower middle rank lie at or below the median and the others at or above it, so the distances are
    a difference of the sums of both sides and no row meets its median again.
    """
    own = [f"_g{i}" for i in range(len(by))]  # any column name can be a group key
    inner = df.select(*[col(k).alias(g) for k, g in zip(by, own, strict=True)], col(value).alias("_value"))
    ranks = value_ranks(inner, "_value", own)
    v, n, last = F.col("_value").cast("double"), F.col("n"), F.col("before") + F.col("n")
    middle = (F.col("total") - 1) / 2
    low, high = F.floor(middle), F.ceil(middle)
    below = F.col("before") <= low
    sides = ranks.groupBy(*own).agg(
        F.max(F.when((F.col("before") <= low) & (low < last), v)).alias("_low"),
        F.max(F.when((F.col("before") <= high) & (high < last), v)).alias("_high"),
        F.sum(F.when(below, n).otherwise(-n)).alias("_more"),
        F.sum(F.when(below, -n * v).otherwise(n * v)).alias("_apart"),
    )
    median = F.col("_low") + (F.col("_high") - F.col("_low")) / 2
    return sides.select(
        *[F.col(g).alias(k) for k, g in zip(by, own, strict=True)],
        median.alias("_median"), (F.col("_apart") + F.col("_more") * median).alias("_distance"),
    )


def levene(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """Levene's test around the medians: (keys, statistic, p_value).

    Mean and variance of the distances to the median follow from the group's moments and the two sides of its ranked
    values. Distances whose variance is below 1e-12 of their mean square are all equal but for rounding.
    """
    keys = as_list(by)
    present = df.filter(col(value).isNotNull() & col(group).isNotNull())
    sides = _median_sides(present, value, [*keys, group])
    both = attach(_group_moments(present, value, group, keys), sides, [*keys, group])
    n, gap = F.col("n"), F.col("mean") - F.col("_median")
    squares = (n - 1) * F.col("var") + n * gap * gap
    around = squares - F.col("_distance") * F.col("_distance") / n
    moments = both.select(
        *cols([*keys, group]), "n", (F.col("_distance") / n).alias("mean"),
        F.when(around <= 1e-12 * squares, F.lit(0.0)).otherwise(around / (n - 1)).alias("var"),
    )
    ratio = _variance_ratio(moments, keys)
    p = f_pvalue(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k"))
    return ratio.select(*cols(keys), r4(F.col("f")).alias("statistic"), r6(p).alias("p_value"))


def one_way_anova(df: DataFrame, value: str, group: str, alpha: float = 0.05, by=None) -> DataFrame:
    """One-way ANOVA over the groups with at least two values, eta squared and Levene's test."""
    keys = as_list(by)
    ratio = _variance_ratio(_group_moments(df, value, group, keys), keys)
    eta = F.coalesce(safe_ratio(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0))
    p = f_pvalue(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k"))
    tested = ratio.withColumn("_p", p).withColumn("_eta", F.when(F.col("k") >= 2, eta))
    spread = levene(df, value, group, keys).select(
        *cols(keys), F.col("statistic").alias("_ls"), F.col("p_value").alias("_lp")
    )
    return attach(tested, spread, keys).select(
        *cols(keys),
        F.col("k").alias("n_groups"),
        F.col("n").alias("n"),
        r4(F.col("f")).alias("f_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.col("_eta")).alias("eta_squared"),
        eta_squared_label(F.col("_eta")).alias("effect_size"),
        F.col("_ls").alias("levene_statistic"),
        F.col("_lp").alias("levene_p_value"),
        (F.col("_lp") > 0.05).alias("equal_variances"),
        error_when(F.col("k") < 2, "Need at least 2 groups with sufficient data"),
    )


def tukey_pairs(
    df: DataFrame, value: str, group: str, by: str | Iterable[str] | None = None, max_groups: int = MAX_LEVELS
) -> DataFrame:
    """Post-hoc comparison: mean difference, q and p of each pair of group means.

    Works on group summaries. The output has one row per pair of groups, so a key with more than ``max_groups`` groups
    fails; groups are counted before any list of them is made.
    """
    keys = as_list(by)
    moments = _group_moments(df, value, group, keys)
    sizes = moments.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("n").alias("_n"),
        (F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count(F.lit(1)))).alias("_mse"),
    )
    checked = sizes.filter(
        F.when(F.col("_k") <= max_groups, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"More than {max_groups} groups; pairwise comparison is not possible")).isNull()
        )
    )
    packed = attach(moments.select(*cols(keys), col(group).alias("_g"), F.col("n").alias("_gn"), F.col("mean").alias("_gm")), checked, keys)
    packed = packed.groupBy(*cols(keys), "_k", "_n", "_mse").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_g").alias("g"), F.col("_gn").alias("n"), F.col("_gm").alias("mean")))).alias("_groups")
    )
    pairs = packed.select("*", F.posexplode("_groups").alias("_i", "_a")).select(
        "*", F.explode(F.slice("_groups", F.col("_i") + 2, F.col("_k").cast("int"))).alias("_b")
    )
    gap = F.col("_a.mean") - F.col("_b.mean")
    se = F.sqrt(F.col("_mse") / 2 * (1 / F.col("_a.n") + 1 / F.col("_b.n")))
    q = safe_ratio(F.abs(gap), se)
    tested = pairs.withColumn("_gap", gap).withColumn("_q", q)
    tested = tested.withColumn("_p", tukey_pvalue(F.col("_q"), F.col("_k"), F.col("_n") - F.col("_k")))
    return tested.select(
        *cols(keys),
        F.col("_a.g").alias("group1"),
        F.col("_b.g").alias("group2"),
        r4(F.col("_gap")).alias("mean_difference"),
        r4(F.col("_q")).alias("q_statistic"),
        r6(F.col("_p")).alias("p_value"),
    )
