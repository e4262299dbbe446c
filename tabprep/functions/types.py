"""Column selection by type class and name rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name of the row identity column: a LONG that keeps the original row order.
ORD = "_ord"

_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _names(df: DataFrame, kinds, exclude: Iterable[str]) -> list[str]:
    skip = set(exclude) | {ORD}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integer, floating and decimal columns; booleans are not numeric."""
    return _names(df, T.NumericType, exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _names(df, (T.StringType, T.CharType, T.VarcharType), exclude)


def datetime_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _names(df, _DATETIME, exclude)


def boolean_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _names(df, T.BooleanType, exclude)


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """The four type classes of a table, in column order."""
    return {
        "numeric": numeric_columns(df),
        "categorical": categorical_columns(df),
        "datetime": datetime_columns(df),
        "boolean": boolean_columns(df),
    }


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _DATETIME)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def col(name: str) -> Column:
    """A column by its literal name, even when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str], what: str = "Columns") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found in dataframe: {missing}")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def name_contains(name: str, words: Iterable[str]) -> bool:
    """Raw substring rule: ``humidity`` contains ``id``."""
    lowered = name.lower()
    return any(w in lowered for w in words)


def name_has_token(name: str, words: Iterable[str]) -> bool:
    """Token rule: ``sample_id`` has the token ``id``, ``humidity`` has not."""
    lowered = name.lower()
    wanted = set(words)
    return lowered in wanted or not wanted.isdisjoint(re.findall(r"[a-z0-9]+", lowered))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (one projection)."""
    floats = {n for n in df.columns if is_floating(df, n)}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns])
