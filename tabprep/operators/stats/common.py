"""Shared pieces of the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import col


def r4(c: Column) -> Column:
    return F.round(c, 4)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of a per-key table to each row; without keys ``small`` is one row."""
    if not keys:
        one = F.lit(1)
        return df.withColumn("_one", one).join(F.broadcast(small.withColumn("_one", one)), "_one").drop("_one")
    a, b = df.alias("a"), small.alias("b")
    match = None
    for k in keys:
        same = F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        match = same if match is None else match & same
    extra = [F.col(f"b.`{n}`").alias(n) for n in small.columns if n not in keys]
    return a.join(b, match).select(*[F.col(f"a.`{n}`").alias(n) for n in df.columns], *extra)


def cols(names: list[str]) -> list[Column]:
    return [col(n) for n in names]


def error_when(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text)).alias("error")
