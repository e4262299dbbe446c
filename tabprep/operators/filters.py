"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import as_list, col, datetime_columns, numeric_columns

# Names that hold a time even when their type is text or a number.
TIME_NAMES = frozenset({"datetime", "date", "time", "timestamp", "date_time", "created_at", "updated_at"})


def filter_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Keep rows with low <= value <= high; nulls are dropped."""
    return df.filter(col(column).between(low, high))


def filter_members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Keep rows whose value is selected; ``None`` selects nulls; no selection keeps all rows."""
    chosen = list(values)
    if not chosen:
        return df
    known = [v for v in chosen if v is not None]
    keep = col(column).isin(known) if known else F.lit(False)
    if len(known) < len(chosen):
        keep = keep | col(column).isNull()
    return df.filter(keep)


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filter_exact_zero_rows(df: DataFrame) -> DataFrame:
    """Remove rows whose numeric columns are all exactly 0; a null counts as not 0."""
    names = numeric_columns(df)
    if not names:
        return df
    return df.filter(_any_of([~F.coalesce(col(n) == 0, F.lit(False)) for n in names]))


def measure_columns(df: DataFrame, datetime_col: str | None = None) -> list[str]:
    """Numeric columns that are not a time by type, by name or by choice."""
    skip = set(datetime_columns(df)) | {n for n in df.columns if n.lower() in TIME_NAMES}
    if datetime_col:
        skip.add(datetime_col)
    return numeric_columns(df, exclude=skip)


def has_measurement(names: list[str]) -> Column:
    """True when some column is non-null and not 0; never NULL."""
    return _any_of([F.coalesce(col(n) != 0, F.lit(False)) for n in names])


def remove_zero_only_rows(df: DataFrame, datetime_col: str | None = None) -> DataFrame:
    """Remove rows whose measures are all 0 or null."""
    names = measure_columns(df, datetime_col)
    return df.filter(has_measurement(names)) if names else df


def mark_zero_only_rows(df: DataFrame, datetime_col: str | None = None, flag: str = "zero_only") -> DataFrame:
    names = measure_columns(df, datetime_col)
    return df.withColumn(flag, ~has_measurement(names) if names else F.lit(False))


def drop_null_rows(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    return df.na.drop(subset=as_list(columns))
