"""Training and prediction from end to end."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.functions.types import ORD, col
from tabprep.operators.charts import histogram
from tabprep.operators.aggregates import MAX_LEVELS
from tabprep.operators.encode import OneHotEncoding, level_statistics
from tabprep.operators.sample import random_split
from tabprep.operators.sparse import SparseEncoding
from tabprep.plans import models as M
from tabprep.plans.features import CORRELATION_THRESHOLD, FeaturePlan, feature_kinds, fit_features, usable_rows
from tabprep.plans.sparse_features import fit_sparse_features
from tabprep.plans.trees import GrownForest

_MODEL_CLASSES = {c.__name__: c for c in (LinearRegressionModel, RandomForestRegressionModel, GBTRegressionModel)}
# A grown forest is written as Spark's.
_MODEL_CLASSES[GrownForest.__name__] = RandomForestRegressionModel


@dataclass
class Predictor:
    """A model with its fitted features; with an encoder or sparse features it takes raw rows."""

    plan: FeaturePlan | SparseEncoding
    model: Model
    name: str
    score: float
    encoder: OneHotEncoding | None = None

    @property
    def output(self) -> str:
        return f"Predicted_{self.plan.target}"

    def transform(self, df: DataFrame) -> DataFrame:
        """Append the prediction; works on batch and streaming tables."""
        source = df
        if self.encoder is not None:
            source = self.encoder.transform(df.withColumn("_input", F.struct(*[col(n) for n in df.columns])), keep=["_input"])
        else:
            source = df.withColumn("_input", F.struct(*[col(n) for n in df.columns]))
        scored = self.model.transform(self.plan.with_vector(source, "_features"), {self.model.featuresCol: "_features"})
        return scored.select("_input.*", F.col(self.model.getPredictionCol()).alias(self.output))

    def save(self, path: str) -> None:
        """Write model, features and metadata as a folder of Spark files."""
        spark = SparkSession.getActiveSession()
        self.model.write().save(f"{path}/model")
        self.plan.save(f"{path}/features", spark)
        encoder = None if self.encoder is None else vars(self.encoder)
        meta = {
            "model_class": type(self.model).__name__, "name": self.name, "score": self.score, "encoder": encoder,
            "sparse": isinstance(self.plan, SparseEncoding),
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Predictor:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        model = _MODEL_CLASSES[meta["model_class"]].load(f"{path}/model")
        encoder = None if meta["encoder"] is None else OneHotEncoding(**meta["encoder"])
        plan = (SparseEncoding if meta.get("sparse") else FeaturePlan).load(f"{path}/features", spark)
        return cls(plan, model, meta["name"], meta["score"], encoder)


@dataclass
class TrainingResult:
    predictor: Predictor
    trained: dict[str, M.Trained]
    test_metrics: DataFrame
    all_metrics: DataFrame
    importance: DataFrame
    test_predictions: DataFrame
    summary: dict

    def use(self, name: str) -> Predictor:
        """The predictor with another of the trained models."""
        if name not in self.trained:
            raise ValueError(f"Model '{name}' is not available in the trained results.")
        chosen = self.trained[name]
        base = self.predictor
        return Predictor(base.plan, chosen.model, name, chosen.mean_score, base.encoder)


def labelled(df: DataFrame, plan: FeaturePlan | SparseEncoding, order_by: str = ORD) -> DataFrame:
    """(row order, label, features) ready for training."""
    vector = plan.with_vector(df)
    return vector.select(col(order_by), col(plan.target).cast("double").alias("label"), "features")


def train_regression(
    df: DataFrame,
    target: str,
    *,
    threshold: float = CORRELATION_THRESHOLD,
    test_size: float = 0.2,
    folds: int = M.CV_FOLDS,
    models: Iterable[str] | None = None,
    strategy: str | None = None,
    iterations: int = 10,
    grids: dict[str, dict] | None = None,
    encode_raw: bool = False,
    drop_zero_rows: bool = False,
    save_to: str | None = None,
    order_by: str = ORD,
    max_levels: int = MAX_LEVELS,
) -> TrainingResult:
    """Split, fit features on the training rows, tune the models, evaluate on the held-out rows.

    ``order_by`` is the row identity column. ``encode_raw`` puts a fitted one-hot encoder in front, so the
    predictor takes raw category columns; with more than ``max_levels`` levels in a column the features are one sparse
    vector instead of a column per level.
    """
    kept = usable_rows(df if order_by == ORD else df.withColumnRenamed(order_by, ORD), target, drop_zero_rows)
    train, test = random_split(kept, test_size, M.SEED)
    encoder = None
    wide = encode_raw and any(u > max_levels for u, _ in level_statistics(train, feature_kinds(train, target)[1]).values())
    if encode_raw and not wide:
        encoder = OneHotEncoding.fit(train.drop(target), max_levels)
        train = encoder.transform(train, keep=[ORD, target])
        test = encoder.transform(test, keep=[ORD, target])
    plan = fit_sparse_features(train, target, threshold) if wide else fit_features(train, target, threshold)
    if wide and not plan.size:
        raise ValueError("No feature correlates with the target.")
    train_set, test_set = labelled(train, plan), labelled(test, plan)
    trained = M.train_models(train_set, models, folds, strategy, iterations, grids)
    best = M.best_of(trained)
    predictor = Predictor(plan, trained[best].model, best, trained[best].mean_score, encoder)
    predictions = trained[best].model.transform(test_set)
    spark = df.sparkSession
    if save_to is not None:
        predictor.save(save_to)
    return TrainingResult(
        predictor=predictor,
        trained=trained,
        test_metrics=M.regression_metrics(predictions),
        all_metrics=M.evaluate_models(trained, test_set),
        importance=plan.importance(trained[best].model) if wide else M.feature_importance(spark, trained[best].model, plan.features),
        test_predictions=predictions.select(ORD, "label", "prediction"),
        summary={
            "target": target,
            "original_features": plan.size + plan.removed if wide else len(plan.features) + len(plan.removed),
            "final_features": plan.size if wide else len(plan.features),
            # The levels left out of sparse features are counted, not listed.
            "removed_features": plan.removed_numbers if wide else plan.removed,
            "best_model": best,
            "best_score": trained[best].mean_score,
            "models": list(trained),
        },
    )


def prediction_summary(predictions: DataFrame, column: str) -> DataFrame:
    """Count, mean, min and max of the predictions."""
    p = col(column)
    return predictions.agg(
        F.count(p).alias("count"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max")
    )


def prediction_histogram(predictions: DataFrame, column: str, bins: int = 40) -> DataFrame:
    return histogram(predictions, column, bins)
