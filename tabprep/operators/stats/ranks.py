"""Rank tests on distinct values with counts, so ties and large groups cost little."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.pvalues import chi2_pvalue, rank_sum_pvalue, signed_rank_pvalue
from tabprep.functions.types import as_list, col
from tabprep.operators.ordering import group_quantiles, value_ranks
from tabprep.operators.stats.common import attach, cols, error_when, r4, r6


def _average_rank():
    return F.col("before") + (F.col("n") + 1) / 2.0


def _tie_term():
    n = F.col("n").cast("double")
    return F.sum(n * n * n - n)


def mann_whitney_u(
    df: DataFrame,
    value: str,
    group: str,
    first,
    second,
    alpha: float = 0.05,
    alternative: str = "two-sided",
    by=None,
) -> DataFrame:
    """Mann-Whitney U of two groups, rank-biserial correlation and medians."""
    keys = as_list(by)
    both = df.filter(col(group).isin([first, second])).select(*cols(keys), col(group), col(value))
    in_first = F.count_if(col(group) == F.lit(first))
    ranks = value_ranks(both, value, keys, {"_n1": in_first})
    s = ranks.groupBy(*cols(keys)).agg(
        F.sum(_average_rank() * F.col("_n1")).alias("_r1"),
        F.sum("_n1").alias("n1"),
        F.sum("n").alias("_all"),
        _tie_term().alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), (F.col("_all") - F.col("n1")).cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    enough = (n1 >= 2) & (n2 >= 2)
    tested = s.withColumn("_u", F.when(enough, u))
    tested = tested.withColumn("_p", rank_sum_pvalue(F.col("_u"), n1, n2, F.col("_ties"), alternative))
    medians = group_quantiles(both, value, [*keys, group], {"_m": 0.5})
    medians = medians.groupBy(*cols(keys)).agg(
        F.max(F.when(col(group) == F.lit(first), F.col("_m"))).alias("_m1"),
        F.max(F.when(col(group) == F.lit(second), F.col("_m"))).alias("_m2"),
    )
    return attach(tested, medians, keys).select(
        *cols(keys),
        F.col("n1").alias("group1_size"),
        (F.col("_all") - F.col("n1")).alias("group2_size"),
        r4(F.col("_m1")).alias("group1_median"),
        r4(F.col("_m2")).alias("group2_median"),
        r4(F.col("_u")).alias("u_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.when(enough, 1 - 2 * F.col("_u") / (n1 * n2))).alias("rank_biserial_r"),
        error_when(~enough, "Insufficient data in one or both groups"),
    )


def wilcoxon_signed_rank(
    df: DataFrame, x: str, y: str | None = None, alpha: float = 0.05, alternative: str = "two-sided", by=None
) -> DataFrame:
    """Wilcoxon signed-rank test of y - x, or of x against zero; zero differences are left out."""
    keys = as_list(by)
    d = col(x).cast("double") if y is None else col(y).cast("double") - col(x).cast("double")
    gaps = df.select(*cols(keys), d.alias("_d")).filter(F.col("_d").isNotNull() & (F.col("_d") != 0))
    gaps = gaps.withColumn("_abs", F.abs("_d"))
    ranks = value_ranks(gaps, "_abs", keys, {"_up": F.count_if(F.col("_d") > 0)})
    s = ranks.groupBy(*cols(keys)).agg(
        F.sum(_average_rank() * F.col("_up")).alias("_plus"), F.sum("n").alias("_n"), _tie_term().alias("_ties")
    )
    n = F.col("_n").cast("double")
    whole = n * (n + 1) / 2
    w = F.least(F.col("_plus"), whole - F.col("_plus")) if alternative == "two-sided" else F.col("_plus")
    tested = s.withColumn("_w", F.when(n >= 2, w))
    p = signed_rank_pvalue(F.when(n >= 2, F.col("_plus")), n, F.col("_ties"), alternative)
    tested = tested.withColumn("_p", p)
    medians = group_quantiles(gaps.withColumn("_k", F.lit(1)), "_d", [*keys, "_k"], {"_m": 0.5}).drop("_k")
    return attach(tested, medians, keys).select(
        *cols(keys),
        F.col("_n").alias("n_observations"),
        r4(F.col("_m")).alias("median_difference"),
        r4(F.col("_w")).alias("w_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        error_when(n < 2, "Insufficient non-zero differences"),
    )


def kruskal_wallis(df: DataFrame, value: str, group: str, alpha: float = 0.05, by=None) -> DataFrame:
    """Kruskal-Wallis H with tie correction over the groups with at least two values."""
    keys = as_list(by)
    present = df.filter(col(value).isNotNull() & col(group).isNotNull())
    present = present.select(*cols(keys), col(group).alias("_g"), col(value).alias("_v"))
    large = present.groupBy(*cols(keys), "_g").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= 2)
    kept = attach(present, large, [*keys, "_g"]).drop("_size")
    ranks = value_ranks(kept, "_v", keys)
    ties = ranks.groupBy(*cols(keys)).agg(_tie_term().alias("_ties"), F.sum("n").alias("_n"))
    shares = kept.groupBy(*cols(keys), "_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = attach(shares, ranks.withColumn("_rank", _average_rank()).select(*cols(keys), "_v", "_rank"), [*keys, "_v"])
    sums = ranked.groupBy(*cols(keys), "_g").agg(
        F.sum(F.col("_rank") * F.col("_c")).alias("_r"), F.sum("_c").alias("_size")
    )
    per_key = sums.groupBy(*cols(keys)).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_size")).alias("_rr"), F.count(F.lit(1)).alias("_k")
    )
    n = F.col("_n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    enough = F.col("_k") >= 2
    tested = attach(per_key, ties, keys).withColumn("_h", F.when(enough & (F.col("_ties") < n * n * n - n), h))
    tested = tested.withColumn("_p", chi2_pvalue(F.col("_h"), F.col("_k") - 1))
    return tested.select(
        *cols(keys),
        F.col("_k").alias("n_groups"),
        F.col("_n").alias("n"),
        r4(F.col("_h")).alias("h_statistic"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        error_when(~enough, "Need at least 2 groups with sufficient data"),
    )
