"""Regression models, their search grids, cross-validation and diagnostics."""

from __future__ import annotations

import logging
import random
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import keyword_only
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.types import ORD, col
from tabprep.operators.ordering import with_row_number
from tabprep.plans import gram, trees
from tabprep.storage import discard, materialize

logger = logging.getLogger(__name__)

# Model names, search grids and defaults.
LINEAR, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "Lasso Regression"
FOREST, BOOSTING = "Random Forest", "Gradient Boosting"
ALPHAS = (0.1, 1.0, 10.0)
GRIDS = {
    LINEAR: {"fitIntercept": [True, False]},
    RIDGE: {"alpha": list(ALPHAS)},
    LASSO: {"regParam": list(ALPHAS)},
    # 30 is the deepest tree Spark builds; it stands for an unlimited depth.
    FOREST: {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]},
    BOOSTING: {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 7]},
}
DIAGNOSED = {RIDGE: "alpha", LASSO: "regParam", FOREST: "maxDepth", BOOSTING: "stepSize"}
CV_FOLDS = 5
SEED = 42
LEARNING_SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)
# The normal-equation solver takes this many features at most.
NORMAL_SOLVER_FEATURES = 4096


class RidgeRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Least squares plus ``alpha`` times the squared coefficients.

    Spark divides the loss by the row count and the label by its deviation, so its penalty is
    alpha / n * deviation; both are taken from the rows of each fit.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty of the squared coefficients", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        y = F.col(self.getLabelCol())
        row = dataset.agg(
            F.count(y).alias("n"), F.stddev_pop(y).alias("pop"), F.stddev_samp(y).alias("samp")
        ).first()
        width = dataset.select(self.getFeaturesCol()).first()[0].size
        normal = width <= NORMAL_SOLVER_FEATURES
        sigma = row["pop"] if normal else row["samp"]
        return LinearRegression(
            featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
            elasticNetParam=0.0, standardization=False, solver="normal" if normal else "l-bfgs",
            regParam=self.getOrDefault(self.alpha) / row["n"] * (sigma or 1.0),
        ).fit(dataset)


def estimator(name: str, features: str = "features", label: str = "label", **params) -> Estimator:
    base = {"featuresCol": features, "labelCol": label}
    if name == LINEAR:
        made = LinearRegression(regParam=0.0, **base)
    elif name == RIDGE:
        made = RidgeRegression(**base)
    elif name == LASSO:
        made = LinearRegression(elasticNetParam=1.0, standardization=False, regParam=1.0, maxIter=2000, tol=1e-9, **base)
    elif name == FOREST:
        # How Spark does the work where it grows the forest itself: rows keep the node they are in.
        work = {"cacheNodeIds": True, "maxMemoryInMB": 512}
        made = trees.Forest(featureSubsetStrategy="all", seed=SEED, numTrees=100, maxDepth=30, **work, **base)
    elif name == BOOSTING:
        made = GBTRegressor(seed=SEED, maxIter=100, stepSize=0.1, maxDepth=3, **base)
    else:
        raise ValueError(f"Unknown model '{name}'. Expected one of {list(GRIDS)}.")
    return made.copy({made.getParam(k): v for k, v in params.items()})


def param_grid(made: Estimator, grid: dict[str, list]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(made.getParam(name), values)
    return builder.build()


def resolve_folds(rows: int, folds: int) -> int:
    """Fewer folds when there are fewer rows than folds."""
    return max(2, rows // 2) if rows < folds else folds


def with_folds(df: DataFrame, folds: int, order_by: str = ORD) -> tuple[DataFrame, int]:
    """Contiguous folds by row order; the first ones hold one row more when the rows do not divide."""
    n = df.count()
    k = resolve_folds(n, folds)
    base, extra = divmod(n, k)
    numbered = with_row_number(df, order_by, "_pos")
    large = extra * (base + 1)
    fold = F.when(F.col("_pos") < large, F.expr(f"_pos div {base + 1}")).otherwise(
        F.expr(f"(_pos - {large}) div {max(base, 1)} + {extra}")
    )
    return numbered.withColumn("fold", fold.cast("int")), k


def default_strategy(names: Iterable[str] | None) -> str:
    """Grid search for one or two models, random search for more."""
    return "grid" if names is not None and len(list(names)) <= 2 else "random"


@dataclass
class Trained:
    """One tuned model."""

    name: str
    model: Model
    mean_score: float
    std_score: float
    params: dict = field(default_factory=dict)


def choices_of(name: str, strategy: str, iterations: int, grid: dict[str, list] | None) -> list[dict]:
    """Parameter settings to try, by parameter name."""
    found = [{p.name: v for p, v in c.items()} for c in param_grid(estimator(name), grid or GRIDS[name])]
    if strategy == "random" and iterations < len(found):
        found = random.Random(SEED).sample(found, iterations)
    return found


def _width(data: DataFrame) -> int:
    row = data.select("features").first()
    return row[0].size if row else 0


def linear_kind(made: Estimator) -> tuple[str, dict] | None:
    """(model name, parameters) of an estimator that sums of products can fit; None for others."""
    if isinstance(made, RidgeRegression):
        return RIDGE, {"alpha": made.getOrDefault(made.alpha)}
    if isinstance(made, LinearRegression) and not made.isDefined("weightCol"):
        if made.getRegParam() == 0:
            return LINEAR, {"fitIntercept": made.getFitIntercept()}
        if made.getElasticNetParam() == 1 and not made.getStandardization() and made.getFitIntercept():
            return LASSO, {"regParam": made.getRegParam()}
    return None


def fit_from_sums(moments: gram.Moments, m, name: str, params: dict) -> gram.Fitted:
    """A linear model fitted from the sums of its training rows; absent parameters have their defaults."""
    if name == RIDGE:
        return moments.ridge(m, params.get("alpha", 1.0))
    if name == LASSO:
        return moments.lasso(m, params.get("regParam", 1.0))
    return moments.least_squares(m, params.get("fitIntercept", True))


def from_sums(name: str, choices: list[dict]) -> bool:
    """Whether every setting of the model can be fitted from sums of products."""
    return name in (LINEAR, RIDGE, LASSO) and all(set(c) <= set(GRIDS[name]) for c in choices)


def fold_moments(data: DataFrame, folds: int) -> gram.Moments | None:
    """Sums per fold of a table with features, label and fold columns; None when it has too many features for them."""
    if _width(data) > gram.GRAM_FEATURES:
        return None
    return gram.segment_moments(data, F.col("fold"), folds)


def linear_scores(moments: gram.Moments, name: str, choices: list[dict]) -> np.ndarray:
    """R2 of each (fold, setting): fitted on all other folds, scored on the fold, without another pass over the rows."""
    folds = np.arange(len(moments.sums))
    out = np.empty((len(folds), len(choices)))
    for f in folds:
        train, held = moments.over(folds != f), moments.over(folds == f)
        for c, params in enumerate(choices):
            out[f, c] = gram.r2(held, fit_from_sums(moments, train, name, params))
    return out


def staged_scores(data: DataFrame, folds: int, choices: list[dict], parallelism: int = 2) -> np.ndarray:
    """R2 of each (fold, setting) of boosting: settings that differ in ``maxIter`` are prefixes of one ensemble.

    Each tree is grown on the errors of those before it, so the longest ensemble holds the shorter ones, and one pass
    over the fold gives the error after every tree.
    """
    default = estimator(BOOSTING).getMaxIter()
    groups: dict[tuple, list[int]] = {}
    for c, params in enumerate(choices):
        groups.setdefault(tuple(sorted((k, v) for k, v in params.items() if k != "maxIter")), []).append(c)
    spread = {
        r["fold"]: (r["n"], r["sst"])
        for r in data.groupBy("fold").agg(F.count("label").alias("n"), (F.var_pop("label") * F.count("label")).alias("sst")).collect()
    }
    out = np.full((folds, len(choices)), np.nan)

    def score(task):
        f, fixed, members = task
        longest = max(choices[c].get("maxIter", default) for c in members)
        model = estimator(BOOSTING, **dict(fixed), maxIter=longest).fit(data.filter(F.col("fold") != f))
        errors = model.evaluateEachIteration(data.filter(F.col("fold") == f), "squared")
        n, sst = spread[f]
        for c in members:
            if sst:
                out[f, c] = 1 - errors[choices[c].get("maxIter", default) - 1] * n / sst

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(score, [(f, fixed, members) for f in sorted(spread) for fixed, members in groups.items()]))
    return out


def tune(
    data: DataFrame, name: str, folds: int, strategy: str = "grid", iterations: int = 10,
    grid: dict[str, list] | None = None, parallelism: int = 2, moments: gram.Moments | None = None,
) -> Trained:
    """Cross-validated search by mean R2 on a table with features, label and fold columns.

    Linear models are searched on the folds' sums (``moments``, made here when absent), boosting by staged ensembles.
    """
    choices = choices_of(name, strategy, iterations, grid)
    if from_sums(name, choices) and moments is None:
        moments = fold_moments(data, folds)
    if from_sums(name, choices) and moments is not None:
        scores = linear_scores(moments, name, choices)
    elif name == BOOSTING:
        scores = staged_scores(data, folds, choices, parallelism)
    else:
        made = estimator(name)
        search = CrossValidator(
            estimator=made, estimatorParamMaps=[{made.getParam(k): v for k, v in c.items()} for c in choices],
            evaluator=RegressionEvaluator(metricName="r2"), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=SEED,
        ).fit(data)
        best = int(np.argmax(search.avgMetrics))
        return Trained(name, search.bestModel, float(search.avgMetrics[best]), float(search.stdMetrics[best]), choices[best])
    means = scores.mean(0)
    best = int(np.nanargmax(means)) if not np.isnan(means).all() else 0
    model = estimator(name, **choices[best]).fit(data)
    return Trained(name, model, float(means[best]), float(scores[:, best].std()), choices[best])


def train_models(
    data: DataFrame, names: Iterable[str] | None = None, folds: int = CV_FOLDS, strategy: str | None = None,
    iterations: int = 10, grids: dict[str, dict] | None = None, order_by: str = ORD, parallelism: int = 2,
) -> dict[str, Trained]:
    """Tune the chosen models; one that cannot be fitted to these rows is skipped, a failed job is an error.

    ``data`` has columns features, label and the row order. It is written once to the shared folder,
    since every fold and parameter reads it again; the linear models share one pass of sums.
    """
    chosen = list(names) if names is not None else list(GRIDS)
    unknown = [n for n in chosen if n not in GRIDS]
    if unknown or not chosen:
        raise ValueError("No regression models selected for training." if not chosen else f"Unknown models: {unknown}")
    strategy = strategy or default_strategy(names)
    folded, k = with_folds(data, folds, order_by)
    stage = materialize(folded)
    linear = any(n in (LINEAR, RIDGE, LASSO) for n in chosen)
    moments = fold_moments(stage, k) if linear else None
    out: dict[str, Trained] = {}
    for name in chosen:
        try:
            found = tune(stage, name, k, strategy, iterations, (grids or {}).get(name), parallelism, moments)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException) as exc:
            logger.warning("Training of %s failed: %s", name, exc)
            continue
        if found.mean_score == found.mean_score:
            out[name] = found
    discard(stage)
    if not out:
        raise ValueError("None of the chosen models could be fitted.")
    return out


def best_of(trained: dict[str, Trained]) -> str:
    return max(trained, key=lambda n: trained[n].mean_score)


def score_table(spark, trained: dict[str, Trained]) -> DataFrame:
    """(model, r2, cv_std, is_best), best first."""
    best = best_of(trained)
    rows = [(n, round(t.mean_score, 4), round(t.std_score, 4), n == best) for n, t in trained.items()]
    return spark.createDataFrame(rows, "model string, r2 double, cv_std double, is_best boolean").orderBy(
        F.col("r2").desc(), "model"
    )


# --- evaluation --------------------------------------------------------------------------------


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: R2, MSE, MAE, RMSE and MAPE (a zero label counts as 1 in the denominator)."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    e = y - p
    base = F.when(y != 0, y).otherwise(F.lit(1.0))
    row = predictions.agg(
        F.count(y).alias("n"),
        F.sum(e * e).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e / base)) * 100).alias("mape"),
        F.max((y != 0).cast("int")).alias("some"),
    )
    mse = F.col("sse") / F.col("n")
    return row.select(
        (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2_score"),
        mse.alias("mse"),
        F.col("mae"),
        F.sqrt(mse).alias("rmse"),
        F.when(F.col("some") == 1, F.col("mape")).otherwise(F.lit(0.0)).alias("mape"),
    )


def evaluate_models(trained: dict[str, Trained], test: DataFrame) -> DataFrame:
    """Metrics of every model on the held-out rows, best R2 first."""
    out = None
    for name, t in trained.items():
        part = regression_metrics(t.model.transform(test)).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.col("r2_score").desc(), "model")


def feature_importance(spark, model: Model, features: list[str], top: int | None = 15) -> DataFrame:
    """(feature, importance): tree importances or absolute coefficients, highest first."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, values.toArray())]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
    return out if top is None else out.limit(top)


def _rmse(model: Model, data: DataFrame) -> float:
    return RegressionEvaluator(metricName="rmse").evaluate(model.transform(data))


def _root_mean(values: list[float]) -> float:
    return (sum(v * v for v in values) / len(values)) ** 0.5


def _fold_bounds(stage: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """First position and number of rows of each fold."""
    sizes = {r["fold"]: r["n"] for r in stage.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {f: sum(sizes[g] for g in sizes if g < f) for f in sizes}, sizes


def learning_curve(data: DataFrame, made: Estimator, folds: int = CV_FOLDS, order_by: str = ORD) -> DataFrame:
    """(train_size, train_rmse, validation_rmse) for five shares of each fold's training rows.

    Linear models need one pass: the first m rows outside a fold are segments between a few cuts of the row order.
    """
    folded, k = with_folds(data, folds, order_by)
    stage = materialize(folded)
    starts, sizes = _fold_bounds(stage)
    smallest = sum(sizes.values()) - max(sizes.values())
    shares = [int(share * smallest) for share in LEARNING_SHARES]
    kind = linear_kind(made)
    rows = []
    if kind is not None and _width(stage) <= gram.GRAM_FEATURES:
        # The first m rows outside fold f lie before m, or before m and the fold's size where the fold comes first.
        ends = {(f, m): m if m <= starts[f] else m + sizes[f] for f in sizes for m in shares}
        cuts = sorted({*ends.values(), *starts.values(), *(starts[f] + sizes[f] for f in sizes)} - {0})
        moments = gram.segment_moments(stage, gram.cut_segment(F.col("_pos"), cuts), len(cuts) + 1)
        first = np.array([0, *cuts])
        for m in shares:
            fits = []
            for f in sizes:
                own = (first >= starts[f]) & (first < starts[f] + sizes[f])
                train, held = moments.over((first < ends[f, m]) & ~own), moments.over(own)
                fitted = fit_from_sums(moments, train, *kind)
                fits.append((gram.rmse(train, fitted), gram.rmse(held, fitted)))
            rows.append((m, _root_mean([a for a, _ in fits]), _root_mean([b for _, b in fits])))
    else:
        for m in shares:
            fits = []
            for f in range(k):
                inside = F.when(F.col("_pos") < starts[f], F.col("_pos")).otherwise(F.col("_pos") - sizes[f])
                train = stage.filter((F.col("fold") != f) & (inside < m))
                model = made.fit(train)
                fits.append((_rmse(model, train), _rmse(model, stage.filter(F.col("fold") == f))))
            rows.append((m, _root_mean([a for a, _ in fits]), _root_mean([b for _, b in fits])))
    discard(stage)
    return data.sparkSession.createDataFrame(rows, "train_size long, train_rmse double, validation_rmse double")


def validation_curve(
    data: DataFrame, name: str, params: dict | None = None, values: list | None = None, folds: int = CV_FOLDS,
    order_by: str = ORD,
) -> DataFrame | None:
    """(param, value, train_rmse, validation_rmse) over the main parameter of a model; None without one."""
    param = DIAGNOSED.get(name)
    if param is None:
        return None
    fixed = {k: v for k, v in (params or {}).items() if k != param}
    folded, k = with_folds(data, folds, order_by)
    stage = materialize(folded)
    tried = values or GRIDS[name][param]
    moments = fold_moments(stage, k) if from_sums(name, [{**fixed, param: None}]) else None
    rows = []
    for value in tried:
        fits = []
        for f in range(k):
            if moments is not None:
                of = np.arange(k) == f
                train, held = moments.over(~of), moments.over(of)
                fitted = fit_from_sums(moments, train, name, {**fixed, param: value})
                fits.append((gram.rmse(train, fitted), gram.rmse(held, fitted)))
            else:
                train = stage.filter(F.col("fold") != f)
                model = estimator(name, **fixed, **{param: value}).fit(train)
                fits.append((_rmse(model, train), _rmse(model, stage.filter(F.col("fold") == f))))
        rows.append((param, str(value), _root_mean([a for a, _ in fits]), _root_mean([b for _, b in fits])))
    discard(stage)
    return data.sparkSession.createDataFrame(rows, "param string, value string, train_rmse double, validation_rmse double")


def spread(data: DataFrame, order_by: str = ORD) -> DataFrame:
    """Training rows dealt to as many tasks as there are cores, at least: a boosting fit passes over them hundreds of times."""
    parts = max(data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions())
    return data.repartition(parts, col(order_by))


def boosting_history(model: Model, train: DataFrame, test: DataFrame) -> DataFrame | None:
    """(iteration, train_rmse, validation_rmse) of a boosting model; None for other models."""
    if not hasattr(model, "evaluateEachIteration"):
        return None
    errors = zip(model.evaluateEachIteration(train, "squared"), model.evaluateEachIteration(test, "squared"))
    rows = [(i + 1, a**0.5, b**0.5) for i, (a, b) in enumerate(errors)]
    return train.sparkSession.createDataFrame(rows, "iteration int, train_rmse double, validation_rmse double")


def diagnostics(data: DataFrame, test: DataFrame, trained: Trained, folds: int = CV_FOLDS) -> dict[str, DataFrame | None]:
    """Learning curve, validation curve and boosting history of one tuned model."""
    return {
        "learning_curve": learning_curve(data, estimator(trained.name, **trained.params), folds),
        "validation_curve": validation_curve(data, trained.name, trained.params, folds=folds),
        "iteration_history": boosting_history(trained.model, data, test) if trained.name == BOOSTING else None,
    }
