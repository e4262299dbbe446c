"""Previews, top lists and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import ORD, col
from tabprep.operators.aggregates import top_values
from tabprep.operators.charts import top_categories
from tabprep.operators.ordering import evenly_downsample, preview
from tabprep.operators.stats.outliers import iqr_outliers, zscore_outliers

__all__ = ["evenly_downsample", "first_outliers", "preview", "random_split", "top_categories", "top_values"]


def first_outliers(
    df: DataFrame, value: str, rows: int = 50, method: str = "iqr", order_by: str = ORD, **options
) -> DataFrame:
    """(row id, value) of the first outliers in row order."""
    find = {"iqr": iqr_outliers, "zscore": zscore_outliers}[method]
    found = find(df.select(col(order_by), col(value)), value, **options)
    return found.select(col(order_by), col(value)).orderBy(col(order_by)).limit(rows)


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = ORD) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a hash of the row identity: a row always lands on the same side."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    bucket = F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(10_000))
    in_test = bucket < int(round(test_size * 10_000))
    return df.filter(~in_test), df.filter(in_test)
