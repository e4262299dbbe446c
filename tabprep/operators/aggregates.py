"""Grouping, counting, cross tables and correlation."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.types import (
    ORD,
    as_list,
    col,
    datetime_columns,
    is_datetime,
    numeric_columns,
    require_columns,
)
from tabprep.storage import compiled, materialize

# The aggregation functions a user can choose.
AGGREGATIONS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0).cast("double")),
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "std": F.stddev_samp,
}
#: Leading bytes of a text that go into the key it is counted by, and how many tied values may be sent back for their texts.
KEY_BYTES, TIED_VALUES = 16, 10_000
# A pivot or one-hot encoding makes one column per level, so the number of levels is checked.
MAX_LEVELS = 1000


def _total(df: DataFrame, name: str) -> Column:
    """Sum in which an all-null group counts as 0, in the type of the plain sum."""
    return F.coalesce(F.sum(col(name)), F.lit(0).cast("double" if df.schema[name].dataType.simpleString() in ("double", "float") else "bigint"))


def _keys_present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])


def _measures(df: DataFrame, keys: list[str]) -> list[str]:
    return numeric_columns(df, exclude=set(keys) | set(datetime_columns(df)))


def first_values(df: DataFrame, keys: str | Iterable[str], order_by: str = ORD) -> DataFrame:
    """First non-null value of every other column per group, in row order."""
    ks = as_list(keys)
    rest = [n for n in df.columns if n not in ks and n != order_by]
    firsts = [F.min_by(col(n), F.when(col(n).isNotNull(), col(order_by))).alias(n) for n in rest]
    grouped = df.filter(_keys_present(ks)).groupBy(*[col(k) for k in ks])
    return grouped.agg(*firsts) if firsts else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def group_auto(df: DataFrame, keys: str | Iterable[str], order_by: str = ORD) -> DataFrame:
    """Aggregate all numeric columns: sum, mean, max; with a time key mean, max, std.

    Rows with a null key are left out. Without numeric columns the first values are returned.
    """
    ks = as_list(keys)
    require_columns(df, ks, "Grouping columns")
    names = _measures(df, ks)
    if not names:
        return first_values(df, ks, order_by)
    over_time = any(is_datetime(df, k) for k in ks)
    out = []
    for n in names:
        if over_time:
            out += [F.avg(col(n)).alias(f"{n}_mean"), F.max(col(n)).alias(f"{n}_max"), F.stddev_samp(col(n)).alias(f"{n}_std")]
        else:
            out += [_total(df, n).alias(f"{n}_sum"), F.avg(col(n)).alias(f"{n}_mean"), F.max(col(n)).alias(f"{n}_max")]
    return df.filter(_keys_present(ks)).groupBy(*[col(k) for k in ks]).agg(*out)


def group_by_functions(
    df: DataFrame, keys: str | Iterable[str] | None, functions: Iterable[str] | None = None, order_by: str = ORD
) -> DataFrame:
    """Aggregate all numeric columns with the chosen functions (default: sum)."""
    ks = as_list(keys)
    if not ks:
        return df
    require_columns(df, ks, "Grouping columns")
    chosen = list(functions or ["sum"])
    unknown = [f for f in chosen if f not in AGGREGATIONS]
    if unknown:
        raise ValueError(f"Unknown aggregation functions: {unknown}")
    names = _measures(df, ks)
    if not names:
        return first_values(df, ks, order_by)
    out = [
        (_total(df, n) if f == "sum" else AGGREGATIONS[f](col(n))).alias(f"{n}_{f}") for n in names for f in chosen
    ]
    return df.filter(_keys_present(ks)).groupBy(*[col(k) for k in ks]).agg(*out)


def group_sizes(df: DataFrame, keys: str | Iterable[str], rows: int | None = 5) -> DataFrame:
    """Group sizes in key order; the first ``rows`` of them."""
    ks = as_list(keys)
    sizes = df.filter(_keys_present(ks)).groupBy(*[col(k) for k in ks]).agg(F.count(F.lit(1)).alias("count"))
    ordered = sizes.orderBy(*[col(k) for k in ks])
    return ordered if rows is None else ordered.limit(rows)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count of each non-null value."""
    return df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, column: str, rows: int = 5) -> DataFrame:
    """Most frequent values; ties in value order."""
    return value_counts(df, column).orderBy(F.col("count").desc(), col(column)).limit(rows)


def grouped_total(df: DataFrame, keys: str | Iterable[str], value: str) -> DataFrame:
    """Sum per group in which null keys form their own group."""
    return df.groupBy(*[col(k) for k in as_list(keys)]).agg(_total(df, value).alias(value))


def value_frequencies(
    df: DataFrame, columns: Iterable[str] | None = None, as_numbers: bool = False
) -> DataFrame:
    """(column, value, n) for many columns in one shuffle; values in text form, nulls included.

    ``as_numbers`` keeps numeric columns as DOUBLE values.

    Counting text forms of all columns in one grouped job avoids one expanded row set per distinct
    count. Equal values are combined before the shuffle.
    """
    names = list(columns) if columns is not None else [n for n in df.columns if n != ORD]
    values = [col(n).cast("double") + F.lit(0.0) if as_numbers else _text_form(df, n) for n in names]
    return _counted(df, names, values, "value")


def _text_form(df: DataFrame, name: str) -> Column:
    # Adding 0.0 folds -0.0 into 0.0, which compare equal.
    kind = df.schema[name].dataType.simpleString()
    return ((col(name) + F.lit(0.0)) if kind == "double" else col(name)).cast("string")


def _counted(df: DataFrame, names: list[str], values: list[Column], label: str) -> DataFrame:
    """(column, ``label``, n) of one value per column."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])
    counted = df.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("column"), F.col("v").alias(label), F.col("n"))


def _has_long_texts(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _key_of(df: DataFrame, name: str) -> Column:
    """The text form as bytes; of a longer text the first ``KEY_BYTES`` bytes and a digest of 16 bytes.

    Keys sort like their texts, but for longer texts that start alike. Two different texts among k of a column share a
    key with a chance below k * k / 2 ** 129.
    """
    raw = _text_form(df, name).cast("binary")
    if not _has_long_texts(df, name):
        return raw
    return F.when(F.octet_length(raw) <= KEY_BYTES, raw).otherwise(F.concat(F.substring(raw, 1, KEY_BYTES), F.unhex(F.md5(raw))))


def value_keys(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, key, n) like :func:`value_frequencies`, but no text goes through the shuffle beyond its first bytes."""
    names = list(columns) if columns is not None else [n for n in df.columns if n != ORD]
    return _counted(df, names, [_key_of(df, n) for n in names], "key")


def counted_columns(df: DataFrame, columns: Iterable[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Totals (column, count, unique_count, missing_values) and the ``rows`` most frequent values (column, rank, value, n).

    Ties are in value order. Values are counted by their keys in one job. Only values that can be among the wanted ones
    get their texts back, by one more scan that joins their keys, and only where a long text is among them. Where more
    than ``TIED_VALUES`` of them are tied on their first bytes, whole texts are counted instead.
    """
    names = list(columns)
    spark, long = df.sparkSession, [n for n in names if _has_long_texts(df, n)]
    keys = value_keys(df, names)
    totals = keys.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.count("key").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing_values"),
    )
    start = F.when(F.col("column").isin(long), F.substring("key", 1, KEY_BYTES)).otherwise(F.col("key"))
    rank = F.rank().over(Window.partitionBy("column").orderBy(F.col("n").desc(), start))
    tied = keys.filter(F.col("key").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= rows).limit(TIED_VALUES + 1)
    found = totals.withColumn("t", F.lit(True)).unionByName(tied.drop("rank"), allowMissingColumns=True).collect()
    sums = [(r["column"], r["count"], r["unique_count"], r["missing_values"]) for r in found if r["t"]]
    best = [(r["column"], r["key"], r["n"]) for r in found if not r["t"]]
    totals = spark.createDataFrame(sums, "column string, count long, unique_count long, missing_values long")
    cut, whole = [], []
    for r in best:
        (cut if r[0] in long and len(r[1]) > KEY_BYTES else whole).append(r)
    if len(best) > TIED_VALUES:
        values = value_frequencies(df, names).filter(F.col("value").isNotNull())
    else:
        values = spark.createDataFrame(whole, "column string, key binary, n long")
        values = values.select("column", F.col("key").cast("string").alias("value"), "n")
    if cut and len(best) <= TIED_VALUES:
        wanted = F.broadcast(spark.createDataFrame(cut, "column string, key binary, n long"))
        cells = [F.struct(F.lit(n).alias("column"), _key_of(df, n).alias("key"), _text_form(df, n).alias("value")) for n in sorted({r[0] for r in cut})]
        texts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").join(wanted, ["column", "key"])
        # A set of one text per key, so that a text on many rows is held once.
        texts = texts.groupBy("column", "key", "n").agg(F.array_min(F.collect_set("value")).alias("value"))
        values = values.unionByName(texts.drop("key"))
    order = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return totals, values.withColumn("rank", order).filter(F.col("rank") <= rows).select("column", "rank", "value", "n")


def distinct_counts(df: DataFrame, columns: Iterable[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, unique_count) of non-null values; exact unless ``approximate`` is set."""
    names = list(columns) if columns is not None else [n for n in df.columns if n != ORD]
    if approximate:
        row = df.agg(*[F.approx_count_distinct(col(n)).alias(f"u{i}") for i, n in enumerate(names)])
        pairs = [F.struct(F.lit(n).alias("column"), F.col(f"u{i}").alias("unique_count")) for i, n in enumerate(names)]
        return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return value_keys(df, names).groupBy("column").agg(F.count("key").alias("unique_count"))


def column_modes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, mode, frequency): most frequent value, ties to the smallest text form."""
    return counted_columns(df, columns, 1)[1].select("column", F.col("value").alias("mode"), F.col("n").alias("frequency"))


def modes_from(freq: DataFrame) -> DataFrame:
    """(column, mode, frequency) of counted values: the smallest pair (-count, value) per column."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
    return freq.groupBy("column").agg(best.alias("b")).select(
        "column", F.col("b.v").alias("mode"), (-F.col("b.k")).alias("frequency")
    )


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value of one column, ties to the smallest, as a one-row table."""
    counts = value_counts(df, column)
    return counts.orderBy(F.col("count").desc(), col(column)).limit(1).select(col(column).alias("mode"), "count")


def levels_of(df: DataFrame, column: str, cap: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values; raises when there are more than ``cap``."""
    found = df.select(col(column)).filter(col(column).isNotNull()).distinct().limit(cap + 1).collect()
    if len(found) > cap:
        raise ValueError(f"Column '{column}' has more than {cap} levels; one output column per level is not possible.")
    return sorted(r[0] for r in found)


def contingency(df: DataFrame, row: str, column: str, zeros: bool = True, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(row, column, count) of the pairs of levels; null values are left out.

    With ``zeros`` every pair of levels is a row: each row level becomes a map over the column levels, so the table is
    built from level lists and not from a product of rows. More than ``max_levels`` column levels are dealt to blocks
    of about that many, which each row level meets one by one. Without ``zeros`` only pairs that occur are rows.
    """
    counts = (
        df.filter(col(row).isNotNull() & col(column).isNotNull())
        .groupBy(col(row).alias("r"), col(column).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not zeros:
        return counts.select(F.col("r").alias(row), F.col("c").alias(column), F.col("n").alias("count"))
    levels = [r[0] for r in counts.select("c").distinct().limit(max_levels + 1).collect()]
    count = F.coalesce(F.try_element_at("m", F.col("c")), F.lit(0)).cast("long").alias("count")
    if len(levels) > max_levels:
        return _in_blocks(materialize(counts), max_levels).select(F.col("r").alias(row), F.col("c").alias(column), count)
    per_row = counts.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    wide = per_row.select("r", "m", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])).alias("c"))
    return wide.select(F.col("r").alias(row), F.col("c").alias(column), count)


def _in_blocks(counts: DataFrame, levels: int) -> DataFrame:
    """(r, m, c): every row level with every column level, and the counts of the row level in the block of c."""
    names = counts.select("c").distinct()
    blocks = -(-names.count() // levels)
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).alias("b")
    lists = names.groupBy(block).agg(F.collect_list("c").alias("cs"))
    maps = counts.groupBy("r", block).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    cells = counts.select("r").distinct().select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    return cells.join(maps, ["r", "b"], "left").join(lists, "b").select("r", "m", F.explode("cs").alias("c"))


def crosstab(df: DataFrame, row: str, column: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Wide cross table: one column per level (more than ``max_levels`` fail), zeros where no row falls."""
    levels = levels_of(df, column, max_levels)
    wide = (
        df.filter(col(row).isNotNull() & col(column).isNotNull())
        .groupBy(col(row))
        .pivot(column, levels)
        .agg(F.count(F.lit(1)))
    )
    return wide.na.fill(0)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Wide table of means of ``value`` by row level and column level (more than ``max_levels`` fail)."""
    kept = df.filter(col(row).isNotNull() & col(column).isNotNull() & col(value).isNotNull())
    return kept.groupBy(col(row)).pivot(column, levels_of(kept, column, max_levels)).agg(F.avg(col(value)))


def grouped_mean(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Long form of :func:`pivot_mean`, without a limit on levels."""
    kept = df.filter(col(row).isNotNull() & col(column).isNotNull() & col(value).isNotNull())
    return kept.groupBy(col(row), col(column)).agg(F.avg(col(value)).alias("mean"))


# --- correlation -------------------------------------------------------------------------------

#: Columns whose products with as many others one task adds up at once.
CORRELATION_BLOCK = 256
_CROSS = "i int, j int, n long, odd long, sx double, sy double, sxx double, syy double, sxy double"


def _column_ranges(df: DataFrame, names: list[str]) -> dict[int, tuple[int, int, float, float, float]]:
    """(values, non-finite values, mean, min, max) of each column by its place, from one pass; absent without values."""

    def run(batches):
        held = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                v = column.drop_null().to_numpy(zero_copy_only=False)
                fine = v[np.isfinite(v)]
                n, odd, total, low, high = held.get(i, (0, 0, 0.0, math.inf, -math.inf))
                held[i] = (
                    n + len(v), odd + len(v) - len(fine), total + float(fine.sum()),
                    min(low, float(fine.min(initial=math.inf))), max(high, float(fine.max(initial=-math.inf))),
                )
        rows = [(i, *r) for i, r in held.items() if r[0]]
        yield pa.RecordBatch.from_pydict({
            c: pa.array([r[k] for r in rows], t)
            for k, (c, t) in enumerate((("i", pa.int32()), ("n", pa.int64()), ("odd", pa.int64()), ("total", pa.float64()), ("low", pa.float64()), ("high", pa.float64())))
        })

    parts = _as_doubles(df, names).mapInArrow(run, "i int, n long, odd long, total double, low double, high double")
    with compiled(df.sparkSession):
        rows = parts.groupBy("i").agg(F.sum("n"), F.sum("odd"), F.sum("total"), F.min("low"), F.max("high")).collect()
    return {i: (n, odd, total / (n - odd) if n > odd else 0.0, low, high) for i, n, odd, total, low, high in rows}


def _as_doubles(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])


def _cross_products(df: DataFrame, names: list[str], left: list[int], right: list[int], centre: list[float]) -> DataFrame:
    """Sums over the rows where both columns of a pair are present, by the places of the columns; i < j only.

    A task multiplies the matrices of its values and of their presence, and sends one row per pair. ``odd`` counts rows
    in which either value is NaN or infinite.
    """
    own = sorted({*left, *right})
    at_left, at_right = [own.index(i) for i in left], [own.index(j) for j in right]
    wanted = np.array(left)[:, None] < np.array(right)[None, :]
    shift = np.array([centre[i] for i in own])

    def run(batches):
        total = np.zeros((7, len(left), len(right)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            fine = there & np.isfinite(x)
            x = np.where(fine, x - shift, 0.0)
            a, b, ma, mb = x[:, at_left], x[:, at_right], fine[:, at_left].astype(float), fine[:, at_right].astype(float)
            pairs = ma.T @ mb
            total[0] += pairs
            if not np.array_equal(fine, there):
                total[1] += there[:, at_left].T.astype(float) @ there[:, at_right].astype(float) - pairs
            for k, product in enumerate((a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b), 2):
                total[k] += product
        i, j = np.nonzero(wanted)
        counts = total[:2, i, j].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(left, np.int32)[i]), pa.array(np.array(right, np.int32)[j]), *map(pa.array, counts), *map(pa.array, total[2:, i, j])],
            names=["i", "j", "n", "odd", "sx", "sy", "sxx", "syy", "sxy"],
        )

    return _as_doubles(df, [names[i] for i in own]).mapInArrow(run, _CROSS)


def _correlations(
    df: DataFrame, names: list[str], blocks: list[tuple[list[int], list[int]]], ranges: dict[int, tuple] | None = None
) -> DataFrame:
    """(i, j, r) of the pairs of columns i < j in the blocks, pairwise complete.

    r is null for fewer than two complete rows, for a column that does not vary among them, and where a complete row
    holds NaN or infinity. Sums are taken around the columns' means; a column whose spread among the complete rows is
    below a millionth of its distance to that mean counts as constant there.
    """
    ranges = _column_ranges(df, names) if ranges is None else ranges
    if not ranges:  # no value anywhere, so perhaps no task either
        place = [F.expr(f"CAST(id DIV {len(names)} AS INT)").alias("i"), F.expr(f"CAST(id % {len(names)} AS INT)").alias("j")]
        every = df.sparkSession.range(len(names) ** 2).select(*place).filter("i < j")
        asked = reduce(lambda a, b: a | b, [F.col("i").isin(left) & F.col("j").isin(right) for left, right in blocks])
        return every.filter(asked).select("i", "j", F.lit(None).cast("double").alias("r"))
    centre = [ranges[i][2] if i in ranges else 0.0 for i in range(len(names))]
    constant = [i for i, r in ranges.items() if r[3] == r[4]]
    parts = [_cross_products(df, names, left, right, centre) for left, right in blocks]
    sums = reduce(DataFrame.unionAll, parts).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "odd", "sx", "sy", "sxx", "syy", "sxy")])
    with compiled(df.sparkSession):
        sums = materialize(sums)
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    varies = (vx > 1e-12 * n * F.col("sxx")) & (vy > 1e-12 * n * F.col("syy")) & (n > 1) & (F.col("odd") == 0)
    if constant:
        varies &= ~F.col("i").isin(constant) & ~F.col("j").isin(constant)
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))
    return sums.select("i", "j", F.when(varies, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))


def _block_pairs(width: int) -> list[tuple[list[int], list[int]]]:
    parts = [list(range(at, min(at + CORRELATION_BLOCK, width))) for at in range(0, width, CORRELATION_BLOCK)]
    return [(parts[a], parts[b]) for a in range(len(parts)) for b in range(a, len(parts))]


def correlation_pairs(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(var1, var2, r) for each pair of numeric columns, pairwise complete.

    Columns are taken in blocks, so a task holds the products of two blocks at a time, however wide the table is.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns")
    found = _correlations(df, names, _block_pairs(len(names)))
    label = F.array(*[F.lit(n) for n in names])
    return found.select(F.get(label, F.col("i")).alias("var1"), F.get(label, F.col("j")).alias("var2"), "r")


def correlation_matrix(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Full matrix in long form: both directions and the diagonal (null for a column that does not vary)."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns")
    ranges = _column_ranges(df, names)
    half = _correlations(df, names, _block_pairs(len(names)), ranges)
    both = half.select(F.explode(F.array(F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"))).alias("p")).select("p.*")
    varies = [i for i, (n, odd, _, low, high) in ranges.items() if n > 1 and (odd or low < high)]
    ones = df.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.when(F.col("id").isin(varies), 1.0).alias("r")
    )
    label = F.array(*[F.lit(n) for n in names])
    return both.unionByName(ones).select(F.get(label, F.col("i")).alias("var1"), F.get(label, F.col("j")).alias("var2"), "r")


def target_correlations(df: DataFrame, target: str, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, r) of each numeric column with the target, highest first."""
    names = [n for n in (numeric_columns(df) if columns is None else columns) if n != target]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, r double")
    last = len(names)
    blocks = [(list(range(at, min(at + CORRELATION_BLOCK, last))), [last]) for at in range(0, last, CORRELATION_BLOCK)]
    found = _correlations(df, [*names, target], blocks)
    label = F.array(*[F.lit(n) for n in names])
    return found.select(F.get(label, F.col("i")).alias("column"), "r").orderBy(F.col("r").desc_nulls_last(), "column")
