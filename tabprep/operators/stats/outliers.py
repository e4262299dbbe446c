"""Outlier fences, z-scores, skewness and kurtosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.labels import kurtosis_label, skewness_label
from tabprep.functions.types import as_list, col
from tabprep.operators.ordering import group_quantiles, quantiles
from tabprep.operators.stats.common import attach, cols, error_when, r4


def iqr_bounds(df: DataFrame, value: str, multiplier: float = 1.5, by=None) -> DataFrame:
    """(keys, q1, q3, iqr, lower_bound, upper_bound), not rounded."""
    keys = as_list(by)
    if keys:
        base = group_quantiles(df, value, keys, {"q1": 0.25, "q3": 0.75})
    else:
        q1, q3 = quantiles(df, [value], [0.25, 0.75])[value]
        base = df.sparkSession.range(1).select(
            F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3")
        )
    iqr = F.col("q3") - F.col("q1")
    return base.select(
        *cols(keys),
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - multiplier * iqr).alias("lower_bound"),
        (F.col("q3") + multiplier * iqr).alias("upper_bound"),
    )


def iqr_outliers(df: DataFrame, value: str, multiplier: float = 1.5, by=None) -> DataFrame:
    """The rows outside the fence."""
    x = col(value).cast("double")
    fenced = attach(df, iqr_bounds(df, value, multiplier, by), as_list(by))
    return fenced.filter((x < F.col("lower_bound")) | (x > F.col("upper_bound"))).select(*cols(df.columns))


def iqr_report(df: DataFrame, value: str, multiplier: float = 1.5, by=None) -> DataFrame:
    """Bounds, count and share of outliers."""
    keys = as_list(by)
    x = col(value).cast("double")
    bounds = iqr_bounds(df, value, multiplier, by)
    outside = (x < F.col("lower_bound")) | (x > F.col("upper_bound"))
    counted = attach(df.select(*cols(keys), col(value)), bounds, keys).groupBy(*cols(keys)).agg(
        *[F.max(c).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
        F.count_if(outside).alias("n_outliers"),
        F.count(x).alias("_n"),
    )
    return counted.select(
        *cols(keys),
        *[r4(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
        "n_outliers",
        F.round(F.try_divide(F.col("n_outliers"), F.col("_n")) * 100, 2).alias("outlier_percentage"),
    )


def _moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    x = col(value).cast("double")
    return df.groupBy(*cols(keys)).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))


def zscore_outliers(df: DataFrame, value: str, threshold: float = 3.0, by=None) -> DataFrame:
    """The rows whose z-score is beyond the threshold, with the score; none when all values are equal."""
    keys = as_list(by)
    z = F.try_divide(col(value).cast("double") - F.col("_mean"), F.col("_std"))
    scored = attach(df, _moments(df, value, keys), keys).withColumn("z_score", z)
    return scored.filter(F.abs("z_score") > threshold).drop("_mean", "_std")


def zscore_report(df: DataFrame, value: str, threshold: float = 3.0, by=None) -> DataFrame:
    keys = as_list(by)
    x = col(value).cast("double")
    z = F.try_divide(x - F.col("_mean"), F.col("_std"))
    placed = attach(df.select(*cols(keys), col(value)), _moments(df, value, keys), keys)
    counted = placed.groupBy(*cols(keys)).agg(
        F.max("_mean").alias("_mean"),
        F.max("_std").alias("_std"),
        F.count_if(F.abs(z) > threshold).alias("_k"),
        F.count(x).alias("_n"),
    )
    usable = F.col("_std") > 0
    return counted.select(
        *cols(keys),
        r4(F.col("_mean")).alias("mean"),
        r4(F.col("_std")).alias("std"),
        F.when(usable, F.col("_k")).alias("n_outliers"),
        F.when(usable, F.round(F.col("_k") / F.col("_n") * 100, 2)).alias("outlier_percentage"),
        error_when(F.col("_std") == 0, "Standard deviation is zero, cannot compute z-scores"),
    )


def skewness_kurtosis(df: DataFrame, value: str, by=None) -> DataFrame:
    """Population skewness and excess kurtosis with labels."""
    keys = as_list(by)
    x = col(value).cast("double")
    s = df.groupBy(*cols(keys)).agg(F.count(x).alias("n"), F.skewness(x).alias("_g"), F.kurtosis(x).alias("_k"))
    return s.select(
        *cols(keys),
        "n",
        r4(F.col("_g")).alias("skewness"),
        skewness_label(F.col("_g")).alias("skewness_label"),
        r4(F.col("_k")).alias("kurtosis"),
        kurtosis_label(F.col("_k")).alias("kurtosis_label"),
    )
