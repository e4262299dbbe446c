"""Quality reports, profiles and summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.labels import (
    cardinality_class,
    correlation_direction,
    correlation_strength,
    distribution_shape,
    quality_grade,
)
from tabprep.functions.types import (
    ORD,
    categorical_columns,
    col,
    columns_by_type,
    is_numeric,
    numeric_columns,
)
from tabprep.operators.aggregates import correlation_pairs, counted_columns, distinct_counts, modes_from, value_frequencies, value_keys
from tabprep.operators.ordering import quantiles

# Texts and thresholds of the column issues.
ISSUE_HIGH_MISSING = "High missing values (>50%)"
ISSUE_SOME_MISSING = "Moderate missing values (>20%)"
ISSUE_CONSTANT = "Constant column (single value)"
ISSUE_LOW_CARDINALITY = "Very low cardinality"
ISSUE_IDENTIFIER = "Potentially unique identifier"
LOW_VARIANCE = 0.01
MULTICOLLINEARITY = 0.85
HIGH_CORRELATION = 0.7


def _data_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n != ORD]


def unfold(row: DataFrame, names: Iterable[str], fields: dict[str, callable]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per column; ``fields`` maps output name to an
    expression of the column's index and name."""
    entries = [
        F.struct(F.lit(n).alias("column"), *[make(i, n).alias(f) for f, make in fields.items()])
        for i, n in enumerate(names)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def column_means(df: DataFrame, names: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def _powers(i: int, n: str, means: dict[str, float]) -> list[Column]:
    """Count and central power sums around the known mean; plain sums keep the aggregation compiled."""
    gap = col(n).cast("double") - F.lit(means[n]).cast("double")
    return [
        F.count(col(n)).cast("double").alias(f"n{i}"),
        F.sum(gap * gap).alias(f"p2_{i}"),
        F.sum(gap * gap * gap).alias(f"p3_{i}"),
        F.sum(gap * gap * gap * gap).alias(f"p4_{i}"),
    ]


def _variance(i: int) -> Column:
    return F.when(F.col(f"n{i}") >= 2, F.col(f"p2_{i}") / (F.col(f"n{i}") - 1))


def adjusted_skewness(i: int) -> Column:
    """Bias-corrected skewness; NULL below three values, 0 for a constant column."""
    n, m2, m3 = F.col(f"n{i}"), F.col(f"p2_{i}") / F.col(f"n{i}"), F.col(f"p3_{i}") / F.col(f"n{i}")
    value = F.try_divide(m3, m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(m2 == 0, F.lit(0.0)).otherwise(value))


def adjusted_kurtosis(i: int) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values, 0 for a constant column."""
    n, m2, m4 = F.col(f"n{i}"), F.col(f"p2_{i}") / F.col(f"n{i}"), F.col(f"p4_{i}") / F.col(f"n{i}")
    k = F.try_divide(m4, m2 * m2) - 3
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)
    return F.when(n >= 4, F.when(m2 == 0, F.lit(0.0)).otherwise(value))


def _quantile_literal(values: dict[str, list], n: str, i: int) -> Column:
    return F.lit(values[n][i]).cast("double")


def _type_name(df: DataFrame, n: str) -> str:
    return df.schema[n].dataType.simpleString()


# --- quality -----------------------------------------------------------------------------------


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, dtype, kind, missing_values) in one aggregation."""
    names = _data_columns(df)
    kinds = {n: kind for kind, members in columns_by_type(df).items() for n in members}
    row = df.agg(*[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)])
    return unfold(
        row,
        names,
        {
            "dtype": lambda i, n: F.lit(_type_name(df, n)),
            "kind": lambda i, n: F.lit(kinds.get(n, "other")),
            "missing_values": lambda i, n: F.col(f"m{i}"),
        },
    )


def assess_quality(df: DataFrame) -> DataFrame:
    """One row: shape, missing cells, duplicate rows and column counts by type.

    Counting equal rows once gives the row count, the duplicates and, weighted by copies, the
    missing cells, so one shuffle serves all of them.
    """
    names = _data_columns(df)
    kinds = columns_by_type(df)
    rows = df.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))
    nulls = sum((col(n).isNull().cast("long") for n in names), F.lit(0).cast("long"))
    return rows.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
        F.coalesce(F.sum(nulls * F.col("_copies")), F.lit(0)).cast("long").alias("missing_values"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("duplicates"),
        F.lit(len(kinds["numeric"])).alias("numeric_columns"),
        F.lit(len(kinds["categorical"])).alias("categorical_columns"),
    )


def column_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null_count, null_count, unique_count) from one count of all values."""
    names = _data_columns(df)
    freq = value_keys(df, names)
    dtypes = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(_type_name(df, n)))])
    total = F.coalesce(F.sum("n"), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0))
    return freq.groupBy("column").agg(
        (total - nulls).cast("long").alias("non_null_count"),
        nulls.cast("long").alias("null_count"),
        F.count("key").alias("unique_count"),
    ).select("column", dtypes[F.col("column")].alias("dtype"), "non_null_count", "null_count", "unique_count")


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: counts, percentages and a list of issues."""
    text = F.array(*[F.lit(n) for n in ["", *categorical_columns(df)]])
    base = column_info(df).withColumn("n", F.col("non_null_count") + F.col("null_count"))
    pct = base.withColumn("null_percentage", F.round(F.col("null_count") / F.col("n") * 100, 2)).withColumn(
        "unique_percentage", F.round(F.col("unique_count") / F.col("n") * 100, 2)
    )
    missing = F.when(F.col("null_percentage") > 50, F.lit(ISSUE_HIGH_MISSING)).when(
        F.col("null_percentage") > 20, F.lit(ISSUE_SOME_MISSING)
    )
    spread = F.when(F.col("unique_count") == 1, F.lit(ISSUE_CONSTANT)).when(
        (F.col("unique_percentage") < 1) & (F.col("n") > 100), F.lit(ISSUE_LOW_CARDINALITY)
    )
    identifier = F.when(
        F.array_contains(text, F.col("column")) & (F.col("unique_percentage") > 95), F.lit(ISSUE_IDENTIFIER)
    )
    issues = F.array_compact(F.array(missing, spread, identifier))
    return pct.select(
        "column",
        "dtype",
        "non_null_count",
        "null_count",
        "null_percentage",
        "unique_count",
        "unique_percentage",
        issues.alias("issues"),
        (F.size(issues) > 0).alias("has_issues"),
    )


def quality_score(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row: completeness, share of non-constant columns, overall score, grade, type and issue counts."""
    report = quality_report(df) if report is None else report
    kinds = columns_by_type(df)
    cells = F.sum(F.col("non_null_count") + F.col("null_count"))
    missing = F.sum("null_count")
    constant = F.count_if(F.col("unique_count") == 1)
    base = report.agg(
        F.max(F.col("non_null_count") + F.col("null_count")).alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        cells.alias("total_cells"),
        missing.alias("total_missing"),
        constant.alias("constant_columns"),
        F.count_if("has_issues").alias("columns_with_issues"),
        F.count_if(F.col("null_percentage") > 50).alias("high_missing_columns"),
    )
    complete = (1 - F.col("total_missing") / F.col("total_cells")) * 100
    unique = (1 - F.col("constant_columns") / F.col("total_columns")) * 100
    scored = base.withColumn("_c", complete).withColumn("_u", unique)
    scored = scored.withColumn("_s", F.col("_c") * 0.6 + F.col("_u") * 0.4)
    return scored.select(
        "total_rows",
        "total_columns",
        "total_cells",
        "total_missing",
        F.round(F.col("total_missing") / F.col("total_cells") * 100, 2).alias("missing_percentage"),
        F.round("_s", 1).alias("overall"),
        F.round("_c", 1).alias("completeness"),
        F.round("_u", 1).alias("uniqueness"),
        quality_grade(F.col("_s")).alias("grade"),
        *[F.lit(len(kinds[k])).alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime", "boolean")],
        "columns_with_issues",
        "high_missing_columns",
        "constant_columns",
    )


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric columns and the share of missing cells."""
    names = _data_columns(df)
    missing = sum((F.count_if(col(n).isNull()) for n in names), F.lit(0))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.round(missing / (n * len(names)) * 100, 1).alias("missing_pct"),
    )


def compare_tables(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """(metric, original, processed, delta) for rows, columns and missing values."""

    def figures(df: DataFrame) -> DataFrame:
        names = _data_columns(df)
        missing = sum((F.count_if(col(n).isNull()) for n in names), F.lit(0))
        row = df.agg(F.count(F.lit(1)).alias("r"), missing.cast("long").alias("m"))
        entries = [("rows", F.col("r")), ("columns", F.lit(len(names)).cast("long")), ("missing_values", F.col("m"))]
        pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in entries])
        return row.select(F.explode(pairs).alias("p")).select("p.metric", "p.v")

    a = figures(raw).withColumnRenamed("v", "original")
    b = figures(processed).withColumnRenamed("v", "processed")
    return a.join(b, "metric").withColumn("delta", F.col("processed") - F.col("original"))


# --- numeric profiles --------------------------------------------------------------------------


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Per numeric column: 18 measures and the shape of the distribution, rounded to 4 digits."""
    names = list(columns) if columns is not None else numeric_columns(df)
    q = quantiles(df, names, [0.25, 0.5, 0.75])
    means = column_means(df, names)
    aggs = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [
            *_powers(i, n, means),
            F.min(c).cast("double").alias(f"min{i}"),
            F.max(c).cast("double").alias(f"max{i}"),
            F.count_if(c == 0).alias(f"zero{i}"),
            F.count_if(c < 0).alias(f"neg{i}"),
        ]
    row = df.agg(*aggs)

    def r4(c: Column) -> Column:
        return F.round(c, 4)

    fields = {
        "dtype": lambda i, n: F.lit(_type_name(df, n)),
        "count": lambda i, n: F.col(f"n{i}").cast("long"),
        "mean": lambda i, n: r4(F.lit(means[n]).cast("double")),
        "std": lambda i, n: r4(F.sqrt(_variance(i))),
        "min": lambda i, n: r4(F.col(f"min{i}")),
        "q1": lambda i, n: r4(_quantile_literal(q, n, 0)),
        "median": lambda i, n: r4(_quantile_literal(q, n, 1)),
        "q3": lambda i, n: r4(_quantile_literal(q, n, 2)),
        "max": lambda i, n: r4(F.col(f"max{i}")),
        "range": lambda i, n: r4(F.col(f"max{i}") - F.col(f"min{i}")),
        "iqr": lambda i, n: r4(_quantile_literal(q, n, 2) - _quantile_literal(q, n, 0)),
        "skewness": lambda i, n: r4(adjusted_skewness(i)),
        "kurtosis": lambda i, n: r4(adjusted_kurtosis(i)),
        "zeros_count": lambda i, n: F.col(f"zero{i}"),
        "zeros_percentage": lambda i, n: F.round(F.try_divide(F.col(f"zero{i}"), F.col(f"n{i}")) * 100, 2),
        "negative_count": lambda i, n: F.col(f"neg{i}"),
        "negative_percentage": lambda i, n: F.round(F.try_divide(F.col(f"neg{i}"), F.col(f"n{i}")) * 100, 2),
        "distribution_shape": lambda i, n: distribution_shape(r4(adjusted_skewness(i))),
    }
    return unfold(row, names, fields).filter(F.col("count") > 0)


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per numeric column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    q = quantiles(df, names, [0.25, 0.5, 0.75])
    aggs = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).cast("double").alias(f"min{i}"),
            F.max(c).cast("double").alias(f"max{i}"),
        ]
    fields = {
        "count": lambda i, n: F.col(f"n{i}"),
        "mean": lambda i, n: F.col(f"mean{i}"),
        "std": lambda i, n: F.col(f"std{i}"),
        "min": lambda i, n: F.col(f"min{i}"),
        "q25": lambda i, n: _quantile_literal(q, n, 0),
        "q50": lambda i, n: _quantile_literal(q, n, 1),
        "q75": lambda i, n: _quantile_literal(q, n, 2),
        "max": lambda i, n: F.col(f"max{i}"),
    }
    return unfold(df.agg(*aggs), names, fields)


def extended_summary(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Median, mode, variance, skewness, kurtosis, range, IQR, null and zero counts per column."""
    names = list(columns) if columns is not None else numeric_columns(df)
    q = quantiles(df, names, [0.25, 0.5, 0.75])
    means = column_means(df, names)
    aggs = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggs += [
            *_powers(i, n, means),
            (F.max(c) - F.min(c)).alias(f"range{i}"),
            F.count_if(c.isNull()).alias(f"null{i}"),
            F.count_if(c == 0).alias(f"zero{i}"),
        ]
    fields = {
        "median": lambda i, n: _quantile_literal(q, n, 1),
        "variance": lambda i, n: _variance(i),
        "skewness": lambda i, n: adjusted_skewness(i),
        "kurtosis": lambda i, n: adjusted_kurtosis(i),
        "range": lambda i, n: F.col(f"range{i}"),
        "iqr": lambda i, n: _quantile_literal(q, n, 2) - _quantile_literal(q, n, 0),
        "null_count": lambda i, n: F.col(f"null{i}"),
        "zero_count": lambda i, n: F.col(f"zero{i}"),
    }
    freq = value_frequencies(df, names, as_numbers=True).filter(F.col("value").isNotNull())
    modes = modes_from(freq).drop("frequency")
    return unfold(df.agg(*aggs), names, fields).join(modes, "column", "left")


def variance_analysis(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Variance, std and coefficient of variation per column, lowest variance first."""
    names = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggs += [F.var_samp(c).alias(f"v{i}"), F.stddev_samp(c).alias(f"s{i}"), F.avg(c).alias(f"m{i}"), F.count(c).alias(f"n{i}")]

    def cv(i, n):
        value = F.when(F.col(f"m{i}") != 0, F.col(f"s{i}") / F.abs(F.col(f"m{i}")) * 100)
        return F.when(value != 0, F.round(value, 2))

    fields = {
        "variance": lambda i, n: F.round(F.col(f"v{i}"), 4),
        "std_dev": lambda i, n: F.round(F.col(f"s{i}"), 4),
        "coefficient_of_variation": cv,
        "is_low_variance": lambda i, n: F.col(f"v{i}") < LOW_VARIANCE,
        "is_constant": lambda i, n: F.col(f"v{i}") == 0,
        "_n": lambda i, n: F.col(f"n{i}"),
    }
    out = unfold(df.agg(*aggs), names, fields).filter(F.col("_n") > 0).drop("_n")
    return out.orderBy(F.col("variance").asc_nulls_last(), "column")


def available_targets(df: DataFrame, order_by: str = ORD, columns: Iterable[str] | None = None) -> DataFrame:
    """Numeric columns as regression targets: distinct, missing, moments and three sample values."""
    names = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [
            F.count_if(c.isNull()).alias(f"null{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).cast("double").alias(f"min{i}"),
            F.max(c).cast("double").alias(f"max{i}"),
        ]
    fields = {
        "dtype": lambda i, n: F.lit(_type_name(df, n)),
        "missing_values": lambda i, n: F.col(f"null{i}"),
        "mean": lambda i, n: F.col(f"mean{i}"),
        "std": lambda i, n: F.col(f"std{i}"),
        "min": lambda i, n: F.col(f"min{i}"),
        "max": lambda i, n: F.col(f"max{i}"),
    }
    firsts = _first_values(df, names, order_by, 3)
    stats = unfold(df.agg(*aggs), names, fields)
    return stats.join(distinct_counts(df, names), "column").join(firsts, "column", "left")


def _first_values(df: DataFrame, names: list[str], order_by: str, rows: int) -> DataFrame:
    """(column, sample_values): the first non-null values of each column in row order.

    One aggregation over all columns finds the first value of each, the next one the second, and so on. ``order_by``
    identifies rows.
    """
    found: dict[str, list] = {n: [] for n in names}
    todo = names
    for _ in range(rows):
        later = [col(n).isNotNull() & (col(order_by) > F.lit(found[n][-1][0]) if found[n] else F.lit(True)) for n in todo]
        first = [F.struct(col(order_by).alias("o"), col(n).cast("double").alias("v")) for n in todo]
        row = df.agg(*[F.min(F.when(a, b)).alias(f"s{i}") for i, (a, b) in enumerate(zip(later, first, strict=True))]).first() if todo else ()
        for n, s in zip(todo, row, strict=True):
            found[n] += [] if s is None else [s]
        todo = [n for n, s in zip(todo, row, strict=True) if s is not None]
    rows_found = [(n, [s["v"] for s in at]) for n, at in found.items()]
    return df.sparkSession.createDataFrame(rows_found, "column string, sample_values array<double>")


# --- categorical profiles ----------------------------------------------------------------------


def top_frequencies(df: DataFrame, columns: Iterable[str] | None = None, rows: int = 5) -> DataFrame:
    """(column, rank, value, n): most frequent values of each text column."""
    names = list(columns) if columns is not None else categorical_columns(df)
    return counted_columns(df, names, rows)[1]


def categorical_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Per text column: counts, mode, top five values and a cardinality class."""
    names = list(columns) if columns is not None else categorical_columns(df)
    totals, best = counted_columns(df, names, 5)
    tops = best.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_t")
    )
    pct = F.round(F.col("unique_count") / F.col("count") * 100, 2)
    joined = totals.join(tops, "column").filter(F.col("count") > 0).withColumn("unique_percentage", pct)
    return joined.select(
        "column",
        F.col("count").cast("long").alias("count"),
        "unique_count",
        "unique_percentage",
        F.col("_t")[0]["value"].alias("mode"),
        F.col("_t")[0]["n"].alias("mode_frequency"),
        F.round(F.col("_t")[0]["n"] / F.col("count") * 100, 2).alias("mode_percentage"),
        F.transform("_t", lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))).alias("top_5_values"),
        cardinality_class(F.col("unique_count"), F.col("unique_percentage")).alias("cardinality"),
    )


def categorical_summary(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, unique_count, most_frequent, missing_values)."""
    names = list(columns) if columns is not None else categorical_columns(df)
    totals, best = counted_columns(df, names, 1)
    mode = best.select("column", F.col("value").alias("most_frequent"))
    return totals.join(mode, "column", "left").select(
        "column", "unique_count", "most_frequent", F.col("missing_values").cast("long").alias("missing_values")
    )


# --- correlation findings ----------------------------------------------------------------------


def multicollinearity(df: DataFrame, threshold: float = MULTICOLLINEARITY, columns=None) -> DataFrame:
    """Pairs with |r| at or above the threshold; ``feature_2`` is the redundant one."""
    r = F.col("r")
    return (
        correlation_pairs(df, columns)
        .filter(F.abs(r) >= threshold)
        .select(
            F.col("var1").alias("feature_1"),
            F.col("var2").alias("feature_2"),
            F.round(r, 4).alias("correlation"),
            F.round(F.abs(r), 4).alias("abs_correlation"),
        )
        .orderBy(F.col("abs_correlation").desc(), "feature_1", "feature_2")
    )


def redundant_features(df: DataFrame, threshold: float = MULTICOLLINEARITY, columns=None) -> DataFrame:
    return multicollinearity(df, threshold, columns).select(F.col("feature_2").alias("feature")).distinct()


def high_correlations(df: DataFrame, threshold: float = HIGH_CORRELATION, columns=None) -> DataFrame:
    """Pairs with |r| above the threshold."""
    r = F.col("r")
    return correlation_pairs(df, columns).filter(F.abs(r) > threshold).select("var1", "var2", F.round(r, 3).alias("r"))


# --- one or two columns ------------------------------------------------------------------------


def basic_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Numeric columns: count, mean, std, min, max, missing; others: count, unique, top, missing."""
    names = list(columns)
    numbers = [n for n in names if is_numeric(df, n)]
    others = [n for n in names if n not in numbers]
    parts = []
    shape = "column string, count long, mean double, std double, min double, max double, unique long, top string, missing long"
    order = [f.split()[0] for f in shape.split(", ")]
    if numbers:
        aggs = []
        for i, n in enumerate(numbers):
            c = col(n)
            aggs += [
                F.count(c).alias(f"n{i}"),
                F.avg(c).alias(f"mean{i}"),
                F.stddev_samp(c).alias(f"std{i}"),
                F.min(c).cast("double").alias(f"min{i}"),
                F.max(c).cast("double").alias(f"max{i}"),
                F.count_if(c.isNull()).alias(f"null{i}"),
            ]
        fields = {
            "count": lambda i, n: F.col(f"n{i}"),
            "mean": lambda i, n: F.col(f"mean{i}"),
            "std": lambda i, n: F.col(f"std{i}"),
            "min": lambda i, n: F.col(f"min{i}"),
            "max": lambda i, n: F.col(f"max{i}"),
            "unique": lambda i, n: F.lit(None).cast("long"),
            "top": lambda i, n: F.lit(None).cast("string"),
            "missing": lambda i, n: F.col(f"null{i}"),
        }
        parts.append(unfold(df.agg(*aggs), numbers, fields))
    if others:
        totals, best = counted_columns(df, others, 1)
        mode = best.select("column", F.col("value").alias("top"))
        blank = [F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "max")]
        parts.append(
            totals.join(mode, "column", "left").select(
                "column",
                F.col("count").cast("long").alias("count"),
                *blank,
                F.col("unique_count").alias("unique"),
                "top",
                F.col("missing_values").cast("long").alias("missing"),
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*order)


def plot_insights(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """One row of findings for a chart: range, outliers, correlation, missing shares."""
    n = F.count(F.lit(1))
    out = [n.alias("n_rows")]
    if is_numeric(df, x):
        q1, q3 = quantiles(df, [x], [0.25, 0.75])[x]
        c = col(x).cast("double")
        out += [F.min(c).alias("x_min"), F.max(c).alias("x_max"), (F.max(c) - F.min(c)).alias("x_range")]
        if q1 is not None:
            fence = 1.5 * (q3 - q1)
            out.append(F.count_if((c < q1 - fence) | (c > q3 + fence)).alias("x_outliers"))
        if y is not None and is_numeric(df, y):
            both = col(x).isNotNull() & col(y).isNotNull()
            r = F.corr(F.when(both, c), F.when(both, col(y).cast("double")))
            out += [r.alias("r"), correlation_strength(r).alias("strength"), correlation_direction(r).alias("direction")]
    else:
        out.append(F.count_distinct(col(x)).alias("x_unique"))
    for label, name in (("x", x), ("y", y)):
        if name is not None:
            nulls = F.count_if(col(name).isNull())
            out += [nulls.alias(f"{label}_missing"), F.round(nulls / n * 100, 1).alias(f"{label}_missing_pct")]
    return df.agg(*out)
