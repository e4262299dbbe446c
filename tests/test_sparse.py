"""Sparse one-hot encoding against plain dictionaries, and training on it against the dense encoder."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabprep.operators import encode as E
from tabprep.operators import sparse as S
from tabprep.plans import models as M
from tabprep.plans import regression as R
from tabprep.plans.sparse_features import fit_sparse_features

ROWS = [(0, "b", "x", 1.0, True), (1, "a", None, 2.0, False), (2, None, "=", None, True), (3, "b", "", 4.0, None), (4, "nan", "x", 0.0, False)]
SCHEMA = "_ord long, g string, h string, v double, f boolean"


def entries(rows, names):
    levels = [sorted({r[i] for r in rows}, key=lambda v: (v is not None, v or "")) for i in names]
    codes = {(i, v): c for c, (i, v) in enumerate((i, v) for i, found in zip(names, levels) for v in found)}
    return codes, {r[0]: {codes[i, r[i]] for i in names} for r in rows}


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_vectors_and_cells(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(ROWS, SCHEMA)
    codes, want = entries(ROWS, (1, 2))
    plan = S.fit_sparse_encoding(df)
    assert plan.text == ["g", "h"] and plan.size == len(codes)
    out = plan.with_vector(df, "one_hot").collect()
    assert {r._ord: set(r.one_hot.indices.tolist()) for r in out} == want
    assert all(r.one_hot.size == len(codes) and set(r.one_hot.values) == {1.0} for r in out)
    assert [r.g for r in sorted(out)] == ["b", "a", None, "b", "nan"]
    cells = plan.cells(df, "_ord").collect()
    assert {(r._ord, r.code) for r in cells} == {(k, c) for k, v in want.items() for c in v} and {r.value for r in cells} == {1.0}
    names = {r.code: r.feature for r in plan.feature_names().collect()}
    assert names == {c: f"{'gh'[i - 1]}_{'nan' if v is None else v}" for (i, v), c in codes.items()}
    fresh = spark.createDataFrame([(9, "new", "x"), (10, None, None)], "_ord long, g string, h string")
    got = {r._ord: set(r.features.indices.tolist()) for r in plan.with_vector(fresh).collect()}
    assert got == {9: {codes[2, "x"]}, 10: {codes[1, None], codes[2, None]}}
    assert all(not set(r.features.indices.tolist()) - {codes[2, "x"], codes[2, None]} for r in plan.with_vector(fresh.drop("g")).collect())
    with pytest.raises(ValueError, match="overwritten"):
        plan.with_vector(fresh.withColumn("features", F.lit(1)))


def test_one_hot_sparse_has_no_limit(spark):
    df = spark.range(3000).select(F.col("id").alias("_ord"), F.concat(F.lit("level "), F.col("id") % 1500).alias("g"))
    out = S.one_hot_sparse(df)
    assert out.columns == ["_ord", "one_hot"] and out.first().one_hot.size == 1500
    counts = out.rdd.map(lambda r: int(r.one_hot.indices[0])).countByValue()
    assert len(counts) == 1500 and set(counts.values()) == {2}
    assert S.one_hot_sparse(df.limit(0)).count() == 0
    smart = E.smart_encode(df.withColumn("k", (F.col("_ord") % 3).cast("string")))
    assert smart.columns == ["_ord", "one_hot", "k_0", "k_1", "k_2"] and smart.first().one_hot.size == 1500


@pytest.fixture(scope="module")
def many_levels(spark):
    rng = np.random.default_rng(8)
    effect = rng.normal(0, 3, 40)
    g, a = rng.integers(0, 40, 900), rng.uniform(0, 5, 900)
    rows = [(i, f"g{k}", float(x), bool(k % 2), float(2 * x + effect[k] + rng.normal(0, 0.1))) for i, (k, x) in enumerate(zip(g, a))]
    return spark.createDataFrame(rows, "_ord long, g string, a double, odd boolean, y double")


def test_training_on_sparse_levels_equals_the_dense_encoder(spark, many_levels, tmp_path):
    options = dict(models=[M.RIDGE], folds=3, encode_raw=True)
    dense = R.train_regression(many_levels, "y", **options)
    sparse = R.train_regression(many_levels, "y", max_levels=10, save_to=str(tmp_path / "p"), **options)
    assert dense.predictor.encoder is not None and sparse.predictor.encoder is None
    assert sparse.summary["final_features"] == dense.summary["final_features"]
    assert sparse.summary["original_features"] == dense.summary["original_features"]
    assert sparse.predictor.score == pytest.approx(dense.predictor.score, abs=1e-9) and sparse.predictor.score > 0.99
    raw = many_levels.drop("y")
    key = lambda p: np.array([r[1] for r in sorted(p.transform(raw).select("_ord", "Predicted_y").collect())])
    assert np.allclose(key(sparse.predictor), key(dense.predictor), atol=1e-7)
    again = R.Predictor.load(spark, str(tmp_path / "p"))
    assert np.allclose(key(again), key(sparse.predictor))
    top = sparse.importance.collect()
    assert len(top) == 15 and top[0].feature in ("a", *[f"g_g{i}" for i in range(40)])
    fresh = spark.createDataFrame([(1, "never seen", 2.0, True), (2, None, None, None)], "_ord long, g string, a double, odd boolean")
    assert sparse.predictor.transform(fresh).filter("Predicted_y IS NULL OR isnan(Predicted_y)").count() == 0


def test_entries_and_sizes_do_not_spread_out_a_vector(spark):
    vectors = [(1, Vectors.sparse(2_000_000_000, [3, 5, 9], [1.0, 0.0, 2.0])), (2, Vectors.dense([0.0, 1.0])), (3, Vectors.sparse(4, [], []))]
    df = spark.createDataFrame(vectors, ["k", "v"])
    assert sorted(df.select("k", S.entries_of("v"), S.size_of("v")).collect()) == [(1, 2, 2_000_000_000), (2, 1, 2), (3, 0, 4)]


def test_levels_without_correlation_give_an_empty_plan(spark):
    df = spark.createDataFrame([(i, f"g{i % 4}", float(i // 4 % 3)) for i in range(48)], "_ord long, g string, y double")
    plan = fit_sparse_features(df, "y")
    assert plan.size == 0 and plan.removed == 4 and plan.levels.count() == 0 and plan.feature_names().count() == 0
    assert {r.features.size for r in plan.with_vector(df).collect()} == {0}
    with pytest.raises(ValueError, match="No feature correlates"):
        R.train_regression(df, "y", models=[M.LINEAR], encode_raw=True, max_levels=2, threshold=1.0)
