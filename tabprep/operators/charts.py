"""The bounded table behind each chart, computed over all rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.scalars import time_label
from tabprep.functions.types import ORD, as_list, col, is_datetime, is_numeric
from tabprep.operators.aggregates import (
    contingency,
    correlation_matrix,
    grouped_mean,
    grouped_total,
    top_values,
    value_counts,
)
from tabprep.operators.filters import drop_null_rows
from tabprep.operators.ordering import evenly_downsample, group_quantiles, quantiles
from tabprep.operators.stats.common import attach

# Point and group limits of the charts.
MAX_SCATTER_POINTS = 5000
MAX_LINE_POINTS = 3000
MAX_GROUPS = 40
MAX_COLUMNS = 6
# Label width by seconds per bucket.
TIME_UNITS = ((3600, "hour"), (86400, "day"), (604800, "week"))
OTHER, MISSING = "Other", "Missing"


def priority_columns(df: DataFrame, *wanted: str | None) -> list[str]:
    """The wanted columns first, then others, at most six."""
    first = [n for n in dict.fromkeys(wanted) if n and n in df.columns]
    rest = [n for n in df.columns if n not in first and n != ORD]
    return first + rest[: max(0, MAX_COLUMNS - len(first))]


# --- axis buckets ------------------------------------------------------------------------------


def has_more_levels(df: DataFrame, column: str, limit: int = MAX_GROUPS) -> bool:
    return df.select(col(column)).filter(col(column).isNotNull()).distinct().limit(limit + 1).count() > limit


def time_unit(df: DataFrame, column: str, groups: int = MAX_GROUPS) -> str:
    """Unit whose length fits the time span cut into ``groups`` buckets."""
    ends = df.agg(F.min(col(column)).alias("a"), F.max(col(column)).alias("b")).first()
    if ends.a is None:
        return "hour"
    per_bucket = max((ends.b - ends.a).total_seconds(), 1) / groups
    return next((unit for limit, unit in TIME_UNITS if per_bucket <= limit), "month")


def quantile_edges(df: DataFrame, column: str, bins: int = MAX_GROUPS) -> list[float]:
    """Distinct quantile cut points, lowest and highest value included."""
    points = quantiles(df, column, [i / bins for i in range(bins + 1)])[column]
    return sorted({p for p in points if p is not None})


def bin_index(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Number of the interval (edge, next edge] that holds the value; the first one is closed.

    The mirrored axis turns half-open [a, b) buckets into (a, b].
    """
    inner = list(edges[1:-1])
    if not inner:
        return df.withColumn(name, F.when(col(column).isNotNull(), F.lit(0)))
    splits = [float("-inf"), *[-e for e in reversed(inner)], float("inf")]
    mirrored = df.withColumn("_mirror", -col(column).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_mirror", outputCol="_cut", handleInvalid="keep")
    last = len(inner)
    return cut.transform(mirrored).withColumn(name, (F.lit(last) - F.col("_cut")).cast("int")).drop("_mirror", "_cut")


def interval_labels(edges: Sequence[float]) -> list[str]:
    """Labels of the intervals between distinct edges: six digits, or as many as keep the edges apart."""
    for digits in range(6, 18):
        shown = [f"{e:.{digits}g}" for e in edges]
        if len(set(shown)) == len(shown):
            break
    return [f"{'(' if i else '['}{a}, {b}]" for i, (a, b) in enumerate(zip(shown, shown[1:], strict=False))]


def top_categories(df: DataFrame, column: str, keep: int = MAX_GROUPS - 1, name: str | None = None) -> DataFrame:
    """Text label: the ``keep`` most frequent values, ``Other`` for the rest, ``Missing`` for nulls."""
    name = name or f"{column}_grouped"
    top = [r[0] for r in top_values(df, column, keep).collect()]
    text = col(column).cast("string")
    return df.withColumn(
        name,
        F.when(col(column).isNull(), F.lit(MISSING)).when(col(column).isin(top), text).otherwise(F.lit(OTHER)),
    )


def bucket_axis(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """Group an axis with more than 40 levels; returns the table and the name of the axis column."""
    if not has_more_levels(df, column):
        return df, column
    name = f"{column}_grouped"
    if is_datetime(df, column):
        label = time_label(col(column), time_unit(df, column))
        return df.withColumn(name, F.coalesce(label, F.lit(MISSING))), name
    if is_numeric(df, column):
        edges = quantile_edges(df, column)
        binned = bin_index(df, column, edges, "_bin")
        labels = F.array(*[F.lit(label) for label in interval_labels(edges)])
        return binned.withColumn(name, F.coalesce(F.get(labels, F.col("_bin")), F.lit(MISSING))).drop("_bin"), name
    return top_categories(df, column, name=name), name


# --- points ------------------------------------------------------------------------------------


def scatter_data(
    df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
    max_points: int = MAX_SCATTER_POINTS, order_by: str = ORD,
) -> DataFrame:
    """Null-free points, evenly thinned in row order."""
    needed = [x, y] + ([size] if size else [])
    names = priority_columns(df, x, y, color, size)
    points = drop_null_rows(df, needed).select(*[col(n) for n in dict.fromkeys([*names, order_by])])
    return evenly_downsample(points, max_points, order_by).select(*[col(n) for n in names])


def line_data(
    df: DataFrame, x: str, y: str, color: str | None = None,
    max_points: int = MAX_LINE_POINTS, order_by: str = ORD,
) -> DataFrame:
    """Null-free points sorted by x (ties in row order), evenly thinned; ``position`` keeps the order."""
    names = priority_columns(df, x, y, color)
    points = drop_null_rows(df, [x, y]).select(*[col(n) for n in dict.fromkeys([*names, order_by])])
    thinned = evenly_downsample(points, max_points, list(dict.fromkeys([x, order_by])))
    return thinned.select(F.col("_pos").alias("position"), *[col(n) for n in names])


# --- distributions -----------------------------------------------------------------------------


def histogram(
    df: DataFrame, x: str, bins: int = MAX_GROUPS, color: str | None = None
) -> DataFrame:
    """(color, bin, low, high, count, density) over equal-width bins of the whole range.

    Bins of a date or time column have timestamps as ends and a density per second. Any other column that is not
    numeric has a row per value instead: (color, value, count, density), the density being the share of all values.
    """
    timed = is_datetime(df, x)
    if not timed and not is_numeric(df, x):
        return _value_histogram(df, x, color)
    number = (col(x).cast("timestamp") if timed else col(x)).cast("double")
    ends = df.agg(F.min(number).alias("a"), F.max(number).alias("b")).first()
    if ends.a is None:
        raise ValueError(f"Column '{x}' has no values.")
    width = (ends.b - ends.a) / bins or 1.0
    index = F.least(F.floor((number - F.lit(ends.a)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [color] if color else []
    kept = drop_null_rows(df, [x, *keys])
    counted = kept.groupBy(*[col(k) for k in keys], index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.groupBy(*[col(k) for k in keys]).agg(F.sum("count").alias("_total"))

    def edge(seconds):
        return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")) if timed else seconds

    return attach(counted, total, keys).select(
        *[col(k) for k in keys],
        "bin",
        edge(F.lit(ends.a) + F.col("bin") * F.lit(width)).alias("low"),
        edge(F.lit(ends.a) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        "count",
        (F.col("count") / (F.col("_total") * F.lit(width))).alias("density"),
    )


def _value_histogram(df: DataFrame, x: str, color: str | None) -> DataFrame:
    keys = [color] if color else []
    kept = drop_null_rows(df, [x, *keys])
    counted = kept.groupBy(*[col(k) for k in keys], col(x).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.groupBy(*[col(k) for k in keys]).agg(F.sum("count").alias("_total"))
    return attach(counted, total, keys).select(
        *[col(k) for k in keys], "value", "count", (F.col("count") / F.col("_total")).alias("density")
    )


def box_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Five-number summary per group of a bucketed axis: quartiles, whiskers within 1.5 IQR, outliers."""
    kept = drop_null_rows(df, [x, y]).select(*[col(n) for n in dict.fromkeys([x, y, *as_list(color)])])
    grouped, axis = bucket_axis(kept, x)
    keys = list(dict.fromkeys([axis, *as_list(color)]))
    quartiles = group_quantiles(grouped, y, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    placed = attach(grouped.select(*[col(k) for k in keys], col(y).cast("double").alias("_y")), quartiles, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return placed.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_y").alias("min"),
        F.min(F.when(F.col("_y") >= low, F.col("_y"))).alias("whisker_low"),
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")],
        F.max(F.when(F.col("_y") <= high, F.col("_y"))).alias("whisker_high"),
        F.max("_y").alias("max"),
        F.count_if((F.col("_y") < low) | (F.col("_y") > high)).alias("n_outliers"),
    )


def violin_data(df: DataFrame, x: str, y: str, bins: int = MAX_GROUPS) -> DataFrame:
    """Density of y per group of a bucketed axis."""
    kept = drop_null_rows(df, [x, y]).select(col(x), col(y))
    grouped, axis = bucket_axis(kept, x)
    return histogram(grouped, y, bins, color=axis)


# --- bars and heat maps ------------------------------------------------------------------------


def bar_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Sum of a numeric y per x (null keys kept), or the count of each x."""
    if is_numeric(df, y):
        return grouped_total(df, list(dict.fromkeys([x, *as_list(color)])), y)
    return value_counts(df, x)


def heatmap_data(df: DataFrame, x: str, y: str, value: str | None = None, zeros: bool = True) -> DataFrame:
    """Long form (y, x, mean) with a value column, else (y, x, count), with zero cells unless ``zeros`` is off."""
    return grouped_mean(df, y, x, value) if value else contingency(df, y, x, zeros)


def correlation_heatmap(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return correlation_matrix(df, columns)


def pair_grid(
    df: DataFrame, columns: Sequence[str], max_points: int = MAX_SCATTER_POINTS, order_by: str = ORD
) -> DataFrame:
    """(var_x, var_y, x, y) for every ordered pair of different columns, from one thinned table."""
    names = list(columns)
    thinned = evenly_downsample(df.select(*[col(n) for n in dict.fromkeys([*names, order_by])]), max_points, order_by)
    cells = [
        F.struct(
            F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
            col(a).cast("double").alias("x"), col(b).cast("double").alias("y"),
        )
        for b in names for a in names if a != b
    ]
    return thinned.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def pair_grid_histograms(df: DataFrame, columns: Sequence[str], bins: int = MAX_GROUPS) -> DataFrame:
    """Diagonal of the pair grid: one histogram per column over all rows; two passes for all numeric columns."""
    if columns and all(is_numeric(df, n) for n in columns):
        return _numeric_histograms(df, list(columns), bins)
    out = None
    for n in columns:
        part = histogram(df, n, bins).select(F.lit(n).alias("column"), "bin", "low", "high", "count")
        out = part if out is None else out.unionByName(part)
    return out


def _numeric_histograms(df: DataFrame, names: list[str], bins: int) -> DataFrame:
    numbers = [col(n).cast("double") for n in names]
    row = df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(numbers) for k, f in (("a", F.min), ("b", F.max))]).first()
    empty = [n for i, n in enumerate(names) if row[f"a{i}"] is None]
    if empty:
        raise ValueError(f"Columns {empty} have no values.")
    starts = [row[f"a{i}"] for i in range(len(names))]
    widths = [(row[f"b{i}"] - a) / bins or 1.0 for i, a in enumerate(starts)]
    cells = [
        F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.least(F.floor((v - F.lit(a)) / F.lit(w)), F.lit(bins - 1)).cast("int").alias("bin")))
        for i, (v, a, w) in enumerate(zip(numbers, starts, widths, strict=True))
    ]
    counted = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.bin").agg(F.count(F.lit(1)).alias("count"))

    def of_column(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))

    return counted.select(
        of_column(names).alias("column"), "bin", (of_column(starts) + F.col("bin") * of_column(widths)).alias("low"),
        (of_column(starts) + (F.col("bin") + 1) * of_column(widths)).alias("high"), "count",
    )


def prediction_points(
    predictions: DataFrame, actual: str, predicted: str, max_points: int = MAX_SCATTER_POINTS, order_by: str = ORD
) -> DataFrame:
    """(actual, predicted, residual), evenly thinned."""
    base = predictions.select(
        col(order_by).alias("_o"),
        col(actual).cast("double").alias("actual"),
        col(predicted).cast("double").alias("predicted"),
    )
    thinned = evenly_downsample(base, max_points, "_o")
    return thinned.select("actual", "predicted", (F.col("actual") - F.col("predicted")).alias("residual"))
