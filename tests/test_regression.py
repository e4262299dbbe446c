import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from tabprep.plans import features as X
from tabprep.plans import models as M
from tabprep.plans import regression as R
from tabprep.plans import trees

FAST = {M.FOREST: {"numTrees": [20], "maxDepth": [8]}, M.BOOSTING: {"maxIter": [20], "maxDepth": [3]},
        M.RIDGE: {"alpha": [0.1, 1.0]}, M.LASSO: {"regParam": [0.1, 1.0]}}


@pytest.fixture(scope="module")
def result(regression):
    return R.train_regression(regression, "target", folds=3, models=[M.LINEAR, M.RIDGE], grids=FAST)


@pytest.fixture(scope="module")
def raw_result(regression):
    return R.train_regression(regression, "target", folds=2, models=[M.LINEAR], encode_raw=True)


def test_scores(result):
    assert result.predictor.score > 0.9
    m = result.test_metrics.first()
    assert m.r2_score > 0.9 and m.rmse == pytest.approx(m.mse**0.5)
    assert result.all_metrics.count() == 2
    assert result.importance.first().feature == "feature_a"
    assert result.summary["best_model"] in (M.LINEAR, M.RIDGE)


def test_active_model(result):
    assert result.use(M.RIDGE).name == M.RIDGE
    with pytest.raises(ValueError):
        result.use("absent")


def test_features_are_numeric_and_complete(spark, regression):
    bad = regression.withColumn("feature_a", F.when(F.col("_ord") % 7 == 0, float("inf")).otherwise(F.col("feature_a")))
    bad = bad.withColumn("category", F.when(F.col("_ord") % 5 != 0, F.col("category")))
    out, plan = X.prepare(bad, "target")
    assert all(t == "double" for n, t in out.dtypes if n in plan.features)
    assert out.filter(" OR ".join(f"{n} IS NULL OR isnan({n})" for n in plan.features)).count() == 0


def test_unusable_targets(spark):
    two = spark.createDataFrame([(1.0, 1), (2.0, 2)], "x double, y int")
    with pytest.raises(ValueError, match="unique values"):
        X.prepare(two, "y")
    with pytest.raises(ValueError, match="not found"):
        X.prepare(two, "z")
    with pytest.raises(ValueError, match="No valid target"):
        X.prepare(two.withColumn("y", F.lit(None).cast("int")), "y")


def test_ridge_and_lasso_reach_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 3))
    y = x @ np.array([2.0, -1.0, 0.0]) + rng.normal(0, 0.3, 300)
    rows = [(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, ["features", "label"])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    got = M.estimator(M.RIDGE, alpha=10.0).fit(df).coefficients.toArray()
    assert np.allclose(got, want, atol=1e-8)
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / 300
            w[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / ((xc[:, j] ** 2).mean())
    got = M.estimator(M.LASSO, regParam=0.1).fit(df).coefficients.toArray()
    assert np.allclose(got, w, atol=1e-5)


def test_folds_are_contiguous(spark):
    df = spark.range(11).withColumnRenamed("id", "_ord")
    folded, k = M.with_folds(df, 3)
    assert k == 3
    assert [r.fold for r in folded.orderBy("_ord").collect()] == [0] * 4 + [1] * 4 + [2] * 3
    assert M.resolve_folds(3, 5) == 2 and M.resolve_folds(100, 5) == 5


def test_tree_models(spark, regression):
    plan = X.fit_features(regression, "target")
    data = R.labelled(regression, plan)
    trained = M.train_models(data, [M.FOREST, M.BOOSTING], folds=2, strategy="random", iterations=1, grids=FAST)
    assert all(t.mean_score > 0.5 for t in trained.values())
    assert M.feature_importance(spark, trained[M.FOREST].model, plan.features).count() == len(plan.features)
    history = M.boosting_history(trained[M.BOOSTING].model, data, data)
    assert history.count() == 20
    assert M.boosting_history(trained[M.FOREST].model, data, data) is None
    with pytest.raises(ValueError):
        M.train_models(data, [])


def test_curves(regression):
    data = R.labelled(regression, X.fit_features(regression, "target"))
    sizes = [r.train_size for r in M.learning_curve(data, M.estimator(M.LINEAR), folds=2).collect()]
    assert sizes == [20, 40, 60, 80, 100]
    assert M.validation_curve(data, M.RIDGE, folds=2).count() == 3
    assert M.validation_curve(data, M.LINEAR) is None


def _linear_table(spark, rows=120, offset=1e4):
    """Features far from 0, one of them constant, so that sums of raw squares would lose digits."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(offset, 2, rows), rng.normal(0, 1, rows), rng.uniform(-1, 5, rows), np.full(rows, 3.0)])
    y = x[:, :3] @ np.array([1.0, -2.0, 0.5]) + rng.normal(0, 1, rows)
    made = [(i, Vectors.dense(a.tolist()), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, ["_ord", "features", "label"]).repartition(3), x, y


def _plain_r2(train, test, name, params):
    (x, y), (u, v) = train, test
    mx, my = (x.mean(0), y.mean()) if params.get("fitIntercept", True) else (0.0, 0.0)
    a, b = x - mx, y - my
    if name == M.RIDGE:
        w = np.linalg.solve(a.T @ a + params["alpha"] * np.eye(x.shape[1]), a.T @ b)
    elif name == M.LASSO:
        w = np.zeros(x.shape[1])
        for _ in range(3000):
            for j in np.flatnonzero((a * a).sum(0) > 1e-9):
                rho = a[:, j] @ (b - a @ w + a[:, j] * w[j]) / len(b)
                w[j] = np.sign(rho) * max(abs(rho) - params["regParam"], 0) / (a[:, j] ** 2).mean()
    else:
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    error = v - my - (u - mx) @ w
    return 1 - (error @ error) / ((v - v.mean()) @ (v - v.mean())), np.sqrt((error @ error) / len(v))


@pytest.mark.parametrize("name", [M.LINEAR, M.RIDGE, M.LASSO])
def test_scores_from_sums_equal_plain_fits(spark, name):
    df, x, y = _linear_table(spark)
    folded, k = M.with_folds(df, 5)
    choices = M.choices_of(name, "grid", 10, None)
    assert M.from_sums(name, choices) and not M.from_sums(name, [{"tol": 1e-3}]) and not M.from_sums(M.FOREST, [{}])
    scores = M.linear_scores(M.fold_moments(folded, k), name, choices)
    fold = np.repeat(np.arange(5), 24)
    for f in range(5):
        for c, params in enumerate(choices):
            want, _ = _plain_r2((x[fold != f], y[fold != f]), (x[fold == f], y[fold == f]), name, params)
            assert scores[f, c] == pytest.approx(want, abs=1e-8)
    tuned = M.tune(folded, name, k)
    assert tuned.mean_score == pytest.approx(scores.mean(0).max()) and tuned.params == choices[int(scores.mean(0).argmax())]


def test_linear_curves_equal_plain_fits(spark, monkeypatch):
    df, x, y = _linear_table(spark, 53)
    fold, sizes = np.repeat(np.arange(5), [11, 11, 11, 10, 10]), [11, 11, 11, 10, 10]
    for made, name, params in ((M.estimator(M.LINEAR), M.LINEAR, {}), (M.estimator(M.RIDGE, alpha=3.0), M.RIDGE, {"alpha": 3.0})):
        assert M.linear_kind(made)[0] == name
        for row in M.learning_curve(df, made).collect():
            errors = []
            for f in range(5):
                at = np.flatnonzero(fold != f)[:row.train_size]
                train, held = (x[at], y[at]), (x[fold == f], y[fold == f])
                errors.append((_plain_r2(train, train, name, params)[1], _plain_r2(train, held, name, params)[1]))
            want = np.sqrt((np.array(errors) ** 2).mean(0))
            assert (row.train_rmse, row.validation_rmse) == pytest.approx(tuple(want), rel=1e-5)
    got = M.validation_curve(df, M.LASSO).collect()
    monkeypatch.setattr(M.gram, "GRAM_FEATURES", 1)  # every fit a job of its own
    for a, b in zip(got, M.validation_curve(df, M.LASSO).collect()):
        assert a.value == b.value and (a.train_rmse, a.validation_rmse) == pytest.approx((b.train_rmse, b.validation_rmse), rel=1e-5)


def test_shorter_ensembles_are_prefixes(spark):
    df, _, _ = _linear_table(spark, 60, 0.0)
    folded, k = M.with_folds(df, 2)
    choices = [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 6, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 3}]
    scores = M.staged_scores(folded, k, choices)
    for f in range(k):
        for c, params in enumerate(choices):
            model = M.estimator(M.BOOSTING, **params).fit(folded.filter(f"fold <> {f}"))
            want = M.regression_metrics(model.transform(folded.filter(f"fold = {f}"))).first().r2_score
            assert scores[f, c] == pytest.approx(want, abs=1e-12)


def test_sums_of_sparse_rows_and_missing_labels(spark):
    rows = [(0, Vectors.sparse(3, {0: 1.0}), 2.0), (1, Vectors.sparse(3, {1: 1.0}), 3.0), (2, Vectors.sparse(3, {}), 1.0), (0, Vectors.dense([5.0, 5.0, 5.0]), None)]
    m = M.gram.segment_moments(spark.createDataFrame(rows, ["fold", "features", "label"]), F.col("fold"), 4)
    assert m.sums[:, 0, 0].tolist() == [1, 1, 1, 0] and m.shift.tolist() == pytest.approx([1 / 3, 1 / 3, 0, 2])
    fitted = m.least_squares(m.over(np.ones(4, bool)))
    assert M.gram.squared_error(m.over(np.ones(4, bool)), fitted) == pytest.approx(0, abs=1e-12)
    assert np.isnan(M.gram.r2(m.sums[0], fitted)) and np.isnan(M.gram.rmse(m.sums[3], fitted))
    with pytest.raises(ValueError, match="label"):
        M.gram.segment_moments(spark.createDataFrame(rows, ["fold", "features", "label"]).filter("label IS NULL"), F.lit(0), 1)


def test_failed_jobs_are_not_taken_for_bad_models(regression, monkeypatch):
    data = R.labelled(regression, X.fit_features(regression, "target"))

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(M, "linear_scores", broken)
    with pytest.raises(RuntimeError, match="lost"):
        M.train_models(data, [M.LINEAR])

    def unusable(*args, **kwargs):
        raise np.linalg.LinAlgError("singular")

    monkeypatch.setattr(M, "linear_scores", unusable)
    with pytest.raises(ValueError, match="fitted"):
        M.train_models(data, [M.LINEAR])


def test_save_and_load(spark, tmp_path, raw_result, regression):
    raw_result.predictor.save(str(tmp_path / "bundle"))
    again = R.Predictor.load(spark, str(tmp_path / "bundle"))
    fresh = regression.drop("target")
    key = ["_ord", "Predicted_target"]
    assert again.transform(fresh).select(*key).orderBy("_ord").collect() == raw_result.predictor.transform(fresh).select(*key).orderBy("_ord").collect()


def test_prediction_of_unseen_and_missing_input(spark, result, raw_result):
    rows = [(1, 2.0, 3.0, True, "new"), (2, None, float("inf"), None, None)]
    fresh = spark.createDataFrame(rows, "_ord long, feature_a double, feature_b double, bool_flag boolean, category string")
    for predictor in (result.predictor, raw_result.predictor):
        out = predictor.transform(fresh.withColumn("extra", F.lit("x")))
        assert out.count() == 2 and out.filter("Predicted_target IS NULL OR isnan(Predicted_target)").count() == 0
        assert set(fresh.columns) <= set(out.columns)
    assert result.predictor.transform(fresh.drop("feature_b")).count() == 2


def test_prediction_does_not_depend_on_other_rows(result, regression):
    holed = regression.withColumn("feature_a", F.when(F.col("_ord") != 3, F.col("feature_a")))
    alone = result.predictor.transform(holed.filter("_ord = 3")).first()["Predicted_target"]
    among = result.predictor.transform(holed).filter("_ord = 3").first()["Predicted_target"]
    assert alone == among


def test_summary(result, regression):
    out = R.prediction_summary(result.predictor.transform(regression), "Predicted_target").first()
    assert out["count"] == 200 and out["min"] < out["mean"] < out["max"]


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(spark, regression):
    data = R.labelled(regression, X.fit_features(regression, "target"))
    made = M.estimator(M.FOREST, numTrees=3, maxDepth=12)
    assert made.getCacheNodeIds()
    walked = made.copy({made.cacheNodeIds: False, made.maxMemoryInMB: 256}).fit(data)
    assert made.fit(data).toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_spread_deals_all_rows_to_the_cores(spark, regression):
    one = regression.coalesce(1)
    dealt = M.spread(one)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(one.collect())


def _spark_forest(made):
    """The same settings on Spark's own forest."""
    own = RandomForestRegressor()
    return own.copy({own.getParam(p.name): v for p, v in made.extractParamMap().items()})


@pytest.fixture
def uneven(spark):
    """Rows with ties in label and features, rows that come twice, in one partition as Spark's sums depend on their order."""
    rng = np.random.default_rng(7)
    n = 900
    a, b, c = rng.integers(0, 60, n), rng.integers(0, 5, n), rng.normal(size=n)
    y = (3 * a + 2 * b + rng.integers(0, 4, n)).astype(float)
    rows = [(float(y[i % 700]), Vectors.dense(float(a[i % 700]), float(b[i % 700]), float(c[i % 700]), 1.0)) for i in range(n)]
    return spark.createDataFrame(rows, ["label", "features"]).coalesce(1)


@pytest.mark.parametrize("params", [{"maxDepth": 30}, {"maxDepth": 4, "minInstancesPerNode": 5}, {"maxDepth": 0}, {"bootstrap": False, "subsamplingRate": 0.5}])
def test_forest_is_the_one_that_spark_grows(uneven, params):
    made = M.estimator(M.FOREST, numTrees=3, **params)
    grown, own = made.fit(uneven), _spark_forest(made).fit(uneven)
    assert isinstance(grown, trees.GrownForest)
    assert np.allclose(grown.featureImportances.toArray(), own.featureImportances.toArray(), rtol=1e-12, atol=0)
    assert grown._loaded is None  # no node has come to the driver
    assert grown.toDebugString.split("\n")[1:] == own.toDebugString.split("\n")[1:]
    assert np.array_equal(grown.featureImportances.toArray() > 0, own.featureImportances.toArray() > 0)


@pytest.mark.parametrize("rows, held", [(100, 64 << 20), (7, 64 << 20), (100, 5000)])
def test_nodes_of_many_rows_are_split_by_all_tasks(spark, uneven, monkeypatch, rows, held):
    """The nodes do not depend on how many rows a task finishes, nor on the partitions that give the sums."""
    made = M.estimator(M.FOREST, numTrees=3, maxDepth=9, minInstancesPerNode=3)
    whole = made.fit(uneven).toDebugString
    monkeypatch.setattr(trees, "NODE_ROWS", rows)
    monkeypatch.setattr(trees, "HELD_BYTES", held)
    before = [spark.conf.get(k) for k in trees.BATCHES]
    assert made.fit(uneven).toDebugString.split("\n")[1:] == whole.split("\n")[1:]
    assert [spark.conf.get(k) for k in trees.BATCHES] == before


def test_forest_of_constant_features_is_one_leaf_a_tree(spark, monkeypatch):
    data = spark.createDataFrame([(float(i), Vectors.dense(1.0, 2.0)) for i in range(20)], ["label", "features"])
    made = M.estimator(M.FOREST, numTrees=2)
    for rows in (trees.NODE_ROWS, 5):
        monkeypatch.setattr(trees, "NODE_ROWS", rows)
        grown = made.fit(data)
        assert grown.totalNumNodes == 2 and not grown.featureImportances.toArray().any()


def test_grown_forest_predicts_and_is_saved_as_sparks(uneven, tmp_path):
    made = M.estimator(M.FOREST, numTrees=3, maxDepth=6)
    grown, own = made.fit(uneven), _spark_forest(made).fit(uneven)
    predicted = [r[0] for r in own.transform(uneven).select("prediction").collect()]
    assert [r[0] for r in grown.transform(uneven).select("prediction").collect()] == pytest.approx(predicted, rel=1e-12)
    grown.write().save(str(tmp_path / "forest"))
    again = R._MODEL_CLASSES[type(grown).__name__].load(str(tmp_path / "forest"))
    assert again.toDebugString == grown.toDebugString


def test_weighted_forest_is_left_to_spark(uneven):
    made = M.estimator(M.FOREST, numTrees=2, maxDepth=3, weightCol="w")
    assert type(made.fit(uneven.withColumn("w", F.lit(2.0)))) is RandomForestRegressionModel


def test_leaves_of_one_prediction_are_pruned_above_subtrees():
    def node(number, feature, prediction):
        return (0, number, feature, 0.5 if feature >= 0 else 0.0, 1.0 if feature >= 0 else -1.0, 2.0, prediction, 4.0, 8.0, 24.0)

    nodes = [node(1, 0, 2.5), node(2, 1, 2.0), node(3, 1, 3.0), node(4, -1, 2.0)]
    left, gone = trees.pruned_above(nodes, {(0, 5): 2.0, (0, 6): 1.0})
    assert sorted(n[1] for n in left) == [1, 2, 3] and sorted(gone) == [(0, 4), (0, 5)]
    assert {n[1]: (n[2], n[4], n[6]) for n in left}[2] == (-1, -1.0, 2.0)
    left, gone = trees.pruned_above(nodes[:2], {(0, 3): 2.0, (0, 4): 2.0, (0, 5): 2.0})
    assert [n[1:3] for n in left] == [(1, -1)] and sorted(gone) == [(0, 2), (0, 3), (0, 4), (0, 5)]
