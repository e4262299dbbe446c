"""Regression features of tables whose text columns have too many levels for a column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import col
from tabprep.operators.sparse import SparseEncoding, _coded, _level_sums
from tabprep.plans.features import CORRELATION_THRESHOLD, feature_kinds, fit_scaling, low_correlation_features


def fit_sparse_features(df: DataFrame, target: str, threshold: float = CORRELATION_THRESHOLD) -> SparseEncoding:
    """Scaled numbers and one scaled 0/1 entry per level, less those that hardly correlate with the target.

    A level's entry is divided by its deviation but not centred: the vector stays sparse, and the intercept of a linear
    model takes up the difference. Share, deviation and correlation of a level follow from its rows and its sum of the
    target, so one grouped job covers all levels of all columns. Where none correlates, the plan has no features.
    """
    known = df.filter(col(target).isNotNull())
    numbers, text = feature_kinds(df, target)
    scaling = fit_scaling(known, numbers, target)
    dropped = low_correlation_features(scaling, threshold)
    kept = {n: (scaling.median[n], scaling.mean[n], scaling.sigma[n]) for n in numbers if n not in dropped}
    y = col(target).cast("double")
    total = known.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sigma")).first()
    rows, spread = total["n"], total["sigma"] or 0.0
    counted, tried = None, 0
    if text:
        sums = _level_sums(known, text, y - F.lit(total["mean"]))
        share = F.col("n") / F.lit(rows)
        deviation = F.sqrt(share * (1 - share))
        r = F.when((deviation > 0) & F.lit(spread > 0), F.col("d") / F.lit(rows) / (deviation * F.lit(spread or 1.0)))
        counted = sums.withColumns({"weight": F.when(deviation > 0, 1 / deviation).otherwise(0.0), "r": F.coalesce(r, F.lit(0.0))})
        tried = counted.count()
        counted = counted.filter(F.abs("r") > threshold)
    levels, size, sizes = _coded(known, counted, len(kept), text)
    return SparseEncoding(kept, text, levels, size, sizes, target, len(dropped) + tried - (size - len(kept)), dropped)
