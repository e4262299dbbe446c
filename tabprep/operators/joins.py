"""Joins, concatenation and duplicate removal."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import ORD, as_list, col, numeric_columns, require_columns
from tabprep.operators.columns import unique_names
from tabprep.operators.ordering import with_row_number

# The accepted join methods.
JOIN_METHODS = ("left", "right", "inner", "outer")


def merge(left: DataFrame, right: DataFrame, on: str | Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join on common columns; null keys match null keys.

    Columns that exist on both sides outside the key get the suffixes ``_x`` and ``_y``.
    Spark picks broadcast, shuffled-hash or sort-merge from the table sizes, and splits skewed
    partitions at run time.
    """
    keys = as_list(on)
    if how not in JOIN_METHODS:
        raise ValueError(f"Unsupported merge method '{how}'. Expected one of {sorted(JOIN_METHODS)}.")
    require_columns(left, keys, "Merge columns of the first table")
    require_columns(right, keys, "Merge columns of the second table")

    shared = (set(left.columns) & set(right.columns)) - set(keys)
    a, b = left.alias("a"), right.alias("b")

    def ref(side: str, name: str):
        return F.col(f"{side}.`{name}`")

    condition = reduce(lambda x, y: x & y, [ref("a", k).eqNullSafe(ref("b", k)) for k in keys])
    key_side = "b" if how == "right" else "a"
    out = []
    for n in left.columns:
        out.append(ref(key_side, n).alias(n) if n in keys else ref("a", n).alias(n + "_x" if n in shared else n))
    for n in right.columns:
        if n not in keys:
            out.append(ref("b", n).alias(n + "_y" if n in shared else n))
    if how != "outer":
        return a.join(b, condition, how).select(*out)
    # Spark splits skewed partitions of left and anti joins but not of full outer joins, so the outer
    # result is the left join plus the right rows without a partner.
    seen = left.select(*[col(k) for k in keys]).distinct().alias("a")
    lonely = b.join(seen, condition, "left_anti")
    types = {f.name: f.dataType for f in left.schema.fields}
    rest = []
    for n in left.columns:
        name = n + "_x" if n in shared else n
        rest.append((ref("b", n) if n in keys else F.lit(None).cast(types[n])).alias(name))
    rest += [ref("b", n).alias(n + "_y" if n in shared else n) for n in right.columns if n not in keys]
    return a.join(b, condition, "left").select(*out).unionByName(lonely.select(*rest))


def concat_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack two tables; columns match by name, missing ones are null."""
    return first.unionByName(second, allowMissingColumns=True)


def concat_columns(
    first: DataFrame, second: DataFrame, order_first: str | Iterable[str], order_second: str | Iterable[str]
) -> DataFrame:
    """Put two tables side by side by row position; the shorter one is filled with nulls.

    Row positions come from each table's order columns. Repeated names get ``_2``.
    """
    a = with_row_number(first, as_list(order_first), "_pos")
    b = with_row_number(second, as_list(order_second), "_pos")
    names = unique_names(first.columns + second.columns)
    a = a.toDF(*names[: len(first.columns)], "_pos")
    b = b.toDF(*names[len(first.columns) :], "_pos")
    return a.join(b, "_pos", "full_outer").select("_pos", *names)


def concat(first: DataFrame, second: DataFrame, axis: int = 0, order_first=None, order_second=None) -> DataFrame:
    if axis not in (0, 1):
        raise ValueError("axis must be 0 or 1")
    if axis == 0:
        return concat_rows(first, second)
    return concat_columns(first, second, order_first or [ORD], order_second or [ORD])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Remove repeated rows; with a row identity column the first copy's identity is kept.

    A grouped ``min`` combines copies on the map side, so many copies of one row cost little.
    """
    if ORD not in df.columns:
        return df.dropDuplicates()
    names = [n for n in df.columns if n != ORD]
    return df.groupBy(*[col(n) for n in names]).agg(F.min(ORD).alias(ORD)).select(*[col(n) for n in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row, as a one-row table."""
    names = [col(n) for n in df.columns if n != ORD]
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def common_columns(tables: Iterable[DataFrame]) -> list[str]:
    sets = [set(t.columns) for t in tables]
    return sorted(set.intersection(*sets)) if sets else []


def common_numeric_columns(tables: Iterable[DataFrame]) -> list[str]:
    sets = [set(numeric_columns(t)) for t in tables]
    return sorted(set.intersection(*sets)) if sets else []
