"""Chi-square tests from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.labels import cramers_v_label
from tabprep.functions.pvalues import chi2_pvalue
from tabprep.functions.scalars import safe_ratio
from tabprep.functions.types import as_list, col
from tabprep.operators.aggregates import value_counts
from tabprep.operators.stats.common import attach, cols, error_when, r4, r6


def chi_square_independence(df: DataFrame, first: str, second: str, alpha: float = 0.05, by=None) -> DataFrame:
    """Chi-square test of independence and Cramer's V; 2 x 2 tables get the continuity correction.

    Only cells with rows are counted. A cell without rows adds its expected count, so the empty cells
    together add the total minus the expected counts of the filled ones.
    """
    keys = as_list(by)
    cells = (
        df.filter(col(first).isNotNull() & col(second).isNotNull())
        .groupBy(*cols(keys), col(first).alias("_a"), col(second).alias("_b"))
        .agg(F.count(F.lit(1)).alias("_o"))
    )
    rows = cells.groupBy(*cols(keys), "_a").agg(F.sum("_o").alias("_ra"))
    columns = cells.groupBy(*cols(keys), "_b").agg(F.sum("_o").alias("_cb"))
    row_side = rows.groupBy(*cols(keys)).agg(
        F.sum("_ra").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.sum(1 / F.col("_ra")).alias("_ira")
    )
    column_side = columns.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("_cols"), F.sum(1 / F.col("_cb")).alias("_icb")
    )
    totals = attach(row_side, column_side, keys)
    full = attach(attach(attach(cells, rows, [*keys, "_a"]), columns, [*keys, "_b"]), totals, keys)
    e = F.col("_ra") * F.col("_cb") / F.col("_n")
    gap = F.abs(F.col("_o") - e)
    sums = full.groupBy(*cols(keys)).agg(
        F.sum(gap * gap / e).alias("_filled"),
        F.sum(e).alias("_expected"),
        F.max(gap).alias("_gap"),
        F.count(F.lit(1)).alias("_cells"),
        *[F.max(c).alias(c) for c in ("_n", "_rows", "_cols", "_ira", "_icb")],
    )
    n, r, c = F.col("_n"), F.col("_rows"), F.col("_cols")
    empty = F.when(F.col("_cells") == r * c, F.lit(0.0)).otherwise(n - F.col("_expected"))
    # All four gaps of a 2 x 2 table are equal.
    shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    corrected = shrunk * shrunk * n * F.col("_ira") * F.col("_icb")
    dof = (r - 1) * (c - 1)
    enough = (r >= 2) & (c >= 2)
    chi2 = F.when(enough, F.when(dof == 1, corrected).otherwise(F.col("_filled") + empty))
    v = F.sqrt(safe_ratio(F.col("_x"), n * F.least(r - 1, c - 1)))
    tested = sums.withColumn("_x", chi2).withColumn("_dof", dof)
    tested = tested.withColumn("_v", v).withColumn("_p", chi2_pvalue(F.col("_x"), F.col("_dof")))
    return tested.select(
        *cols(keys),
        n.alias("n"),
        r.alias("n_rows"),
        c.alias("n_columns"),
        r4(F.col("_x")).alias("chi_square"),
        F.col("_dof").alias("dof"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
        r4(F.col("_v")).alias("cramers_v"),
        cramers_v_label(F.col("_v")).alias("effect_size"),
        error_when(~enough, "Need at least 2 categories in each variable"),
    )


def chi_square_goodness_of_fit(
    df: DataFrame, column: str, expected: Sequence[float] | None = None, alpha: float = 0.05
) -> DataFrame:
    """Goodness of fit to a uniform distribution, or to ``expected`` matched to the counts in
    descending order (ties in value order)."""
    counts = value_counts(df, column)
    if expected is None:
        sums = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("count").alias("n"))
        e = F.col("n") / F.col("k")
        gap = F.col("count") - e
        placed = attach(counts, sums, [])
    else:
        wanted = list(expected)
        # A few rows: one more than the expected list at most.
        top = counts.orderBy(F.col("count").desc(), col(column)).limit(len(wanted) + 1).collect()
        if len(top) != len(wanted):
            raise ValueError("Observed and expected frequencies must have same length")
        e = F.element_at(F.create_map(*[x for r, v in zip(top, wanted) for x in (F.lit(r[0]), F.lit(float(v)))]), col(column))
        gap = F.col("count") - e
        placed = counts
    stat = placed.agg(F.count(F.lit(1)).alias("k"), F.sum("count").alias("n"), F.sum(gap * gap / e).alias("x"))
    tested = stat.withColumn("_p", chi2_pvalue(F.col("x"), F.col("k") - 1))
    return tested.select(
        F.col("k").alias("n_categories"),
        F.col("n").alias("n"),
        r4(F.col("x")).alias("chi_square"),
        (F.col("k") - 1).alias("dof"),
        r6(F.col("_p")).alias("p_value"),
        (F.col("_p") < alpha).alias("reject_null"),
    )
