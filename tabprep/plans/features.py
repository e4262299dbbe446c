"""Fitted preparation of regression features."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.functions.scalars import finite, finite_or
from tabprep.functions.types import ORD, boolean_columns, col, numeric_columns, require_columns
from tabprep.operators.encode import MISSING_LEVEL, level_tables, lookup
from tabprep.operators.filters import remove_zero_only_rows
from tabprep.operators.ordering import quantiles

# Defaults of the preparation.
CORRELATION_THRESHOLD = 0.01
MIN_TARGET_VALUES = 3


def feature_kinds(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """(numeric incl. boolean, other) feature columns in column order."""
    numbers = set(numeric_columns(df)) | set(boolean_columns(df))
    names = [n for n in df.columns if n not in (ORD, target)]
    return [n for n in names if n in numbers], [n for n in names if n not in numbers]


@dataclass
class Scaling:
    """Median for missing values, mean and population deviation per numeric column."""

    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    sigma: dict[str, float] = field(default_factory=dict)
    correlation: dict[str, float] = field(default_factory=dict)

    def filled(self, n: str) -> Column:
        return F.coalesce(finite(col(n)), F.lit(self.median[n]))

    def scaled(self, n: str) -> Column:
        return (self.filled(n) - F.lit(self.mean[n])) / F.lit(self.sigma[n])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: self.scaled(n) for n in self.mean if n in df.columns})


def fit_scaling(df: DataFrame, columns: Iterable[str], target: str | None = None) -> Scaling:
    """Medians of the columns with holes, then moments and target correlations in one aggregation."""
    names = list(columns)
    out = Scaling()
    if not names:
        return out
    clean = df.select(*[finite(col(n)).alias(n) for n in names])
    holes = clean.agg(*[F.count_if(col(n).isNull()).alias(f"h{i}") for i, n in enumerate(names)]).first()
    holed = [n for i, n in enumerate(names) if holes[i] > 0]
    medians = {n: v[0] for n, v in quantiles(clean, holed, [0.5]).items()}
    out.median = {n: medians.get(n) if medians.get(n) is not None else 0.0 for n in names}
    aggs = []
    for i, n in enumerate(names):
        v = out.filled(n)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        if target is not None:
            aggs.append(F.corr(v, col(target).cast("double")).alias(f"r{i}"))
    row = df.agg(*aggs).first()
    for i, n in enumerate(names):
        out.mean[n] = row[f"m{i}"] or 0.0
        out.sigma[n] = row[f"s{i}"] or 1.0
        if target is not None:
            r = row[f"r{i}"]
            out.correlation[n] = 0.0 if r is None or r != r else r
    return out


@dataclass
class FeaturePlan:
    """Fitted features: scaled numbers, label codes of the other columns, fixed order."""

    target: str | None
    scaling: Scaling
    removed: list[str]
    levels: dict[str, DataFrame]
    sizes: dict[str, int]
    features: list[str]

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """The feature columns as DOUBLE, with the kept columns in front.

        Unseen levels get the first code, absent features 0, and nothing is null or infinite. Only stored
        training values are used, so the result of a row does not depend on the rows around it.
        """
        out = df
        made: dict[str, Column] = {}
        for i, n in enumerate(self.features):
            if n in self.levels:
                value = F.coalesce(col(n).cast("string"), F.lit(MISSING_LEVEL)) if n in df.columns else F.lit(MISSING_LEVEL)
                table = self.levels[n].select(F.col("level").alias(f"_l{i}"), F.col("code").alias(f"_c{i}"))
                out = lookup(out.withColumn(f"_l{i}", value), table, f"_l{i}", self.sizes[n])
                made[n] = F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("double")
            elif n in df.columns:
                made[n] = finite_or(self.scaling.scaled(n), 0.0)
            else:
                made[n] = F.lit(0.0)
        return out.select(*[col(k) for k in keep], *[made[n].alias(n) for n in self.features])

    def with_vector(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """The table with one vector column added."""
        keep = [F.struct(*[col(n) for n in df.columns]).alias("_row")]
        staged = self.transform(df.withColumn("_row", keep[0]), keep=["_row"])
        plain = staged.toDF("_row", *[f"_x{i}" for i in range(len(self.features))])
        joined = VectorAssembler(inputCols=plain.columns[1:], outputCol=vector).transform(plain)
        return joined.select("_row.*", vector)

    def save(self, path: str, spark: SparkSession) -> None:
        state = {
            "target": self.target,
            "median": self.scaling.median,
            "mean": self.scaling.mean,
            "sigma": self.scaling.sigma,
            "correlation": self.scaling.correlation,
            "removed": self.removed,
            "sizes": self.sizes,
            "features": self.features,
        }
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")
        for i, n in enumerate(self.levels):
            self.levels[n].write.parquet(f"{path}/levels/{i}")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FeaturePlan:
        s = json.loads(spark.read.text(f"{path}/state").first()[0])
        levels = {n: spark.read.parquet(f"{path}/levels/{i}") for i, n in enumerate(s["sizes"])}
        scaling = Scaling(s["median"], s["mean"], s["sigma"], s["correlation"])
        return cls(s["target"], scaling, s["removed"], levels, s["sizes"], s["features"])


def low_correlation_features(scaling: Scaling, threshold: float = CORRELATION_THRESHOLD) -> list[str]:
    return [n for n, r in scaling.correlation.items() if abs(r) <= threshold]


def fit_features(df: DataFrame, target: str, threshold: float = CORRELATION_THRESHOLD) -> FeaturePlan:
    """Scale numbers, drop numbers that do not correlate with the target, number the levels of the rest."""
    known = df.filter(col(target).isNotNull())
    numbers, others = feature_kinds(df, target)
    scaling = fit_scaling(known, numbers, target)
    removed = low_correlation_features(scaling, threshold)
    levels, sizes = level_tables(known, others, MISSING_LEVEL)
    features = [n for n in df.columns if n in set(numbers) | set(others) and n not in removed]
    if not features:
        raise ValueError("No features remaining after preprocessing")
    return FeaturePlan(target, scaling, removed, levels, sizes, features)


def usable_rows(df: DataFrame, target: str, drop_zero_rows: bool = False) -> DataFrame:
    """Rows with a target, after checking that the target can be regressed on."""
    require_columns(df, [target], "Target column")
    kept = remove_zero_only_rows(df) if drop_zero_rows else df
    kept = kept.filter(col(target).isNotNull())
    y = col(target).cast("double")
    few = kept.select(y).distinct().limit(MIN_TARGET_VALUES).count()
    if few == 0:
        raise ValueError("No valid target values found after removing missing values")
    if few < MIN_TARGET_VALUES:
        raise ValueError(f"Target has only {few} unique values. Not suitable for regression.")
    return kept


def prepare(
    df: DataFrame, target: str, threshold: float = CORRELATION_THRESHOLD, drop_zero_rows: bool = False
) -> tuple[DataFrame, FeaturePlan]:
    """(features with target, fitted plan) of the rows that can be used."""
    kept = usable_rows(df, target, drop_zero_rows)
    plan = fit_features(kept, target, threshold)
    keep = [n for n in (ORD, target) if n in kept.columns]
    return plan.transform(kept, keep=keep), plan
