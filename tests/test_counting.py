"""Counts by keys, runs over ranges, thinning by keys and sketches in two levels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.operators import aggregates as A
from tabprep.operators import charts, ordering
from tabprep.operators import clean as C
from tabprep.operators import profile as P


def test_long_texts_are_counted_by_keys(spark):
    """Ties among texts that share their first bytes, a text as long as a key, nulls and an empty text."""
    stem = "https://site.org/pages/"
    texts = [stem + f"{i % 40:04d}" for i in range(100)] + [stem[:16]] * 3 + ["", None, None] + [stem + "x" * 500] * 3
    df = spark.createDataFrame([(t, i % 3, float(i)) for i, t in enumerate(texts)], "t string, k int, d double").repartition(4)
    want = {t: texts.count(t) for t in texts if t is not None}
    ranked = sorted(want.items(), key=lambda e: (-e[1], e[0]))[:5]
    got = [(r["value"], r["n"]) for r in P.top_frequencies(df, ["t"]).orderBy("rank").collect()]
    assert got == ranked
    assert A.column_modes(df, ["t"]).first()["mode"] == ranked[0][0]
    info = {r["column"]: r for r in P.column_info(df).collect()}
    assert (info["t"]["unique_count"], info["t"]["null_count"]) == (len(want), 2)
    keys = A.value_keys(df, ["t"])
    assert max(len(r["key"] or b"") for r in keys.collect()) == 32


def test_many_tied_long_texts(spark, monkeypatch):
    monkeypatch.setattr(A, "TIED_VALUES", 10)
    df = spark.createDataFrame([(f"a long text with number {i * 7 % 50:03d}",) for i in range(50)], "t string")
    got = [r["value"] for r in P.top_frequencies(df, ["t"], 3).orderBy("rank").collect()]
    assert got == [f"a long text with number {i:03d}" for i in range(3)]
    assert A.counted_columns(df.limit(0), ["t"], 3)[1].count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_null_runs_of_several_columns(spark, small_ranges, seed):
    rng = np.random.default_rng(seed)
    cols = [rng.random(330) < p for p in (0.0, 0.3, 0.97, 1.0)]
    rows = [(i, *[None if c[i] else float(i) for c in cols]) for i in range(330)]
    df = spark.createDataFrame(rows, "_ord long, a double, b double, c double, d double").repartition(5)
    got = {r["column"]: r for r in C.null_runs(df).collect()}
    for name, holes in zip("abcd", cols, strict=True):
        runs = [len(r) for r in "".join("x" if h else " " for h in holes).split()]
        valid = np.flatnonzero(~holes)
        want = (int(holes.sum()), len(runs), max(runs, default=0), valid.min(initial=999), valid.max(initial=-1))
        r = got[name]
        first, last = (999, -1) if r.first_valid is None else (r.first_valid, r.last_valid)
        assert (r.null_count, r.null_runs, r.longest_run, first, last) == want


def test_thinning_carries_all_columns(spark, small_ranges):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7 % 500).alias("x"), F.concat(F.lit("t"), "id").alias("t"))
    got = {r["_pos"]: (r["x"], r["t"]) for r in ordering.evenly_downsample(df, 20, ["x", "id"]).collect()}
    assert sorted(got) == np.linspace(0, 499, 20, dtype=int).tolist()
    assert all(p == x and (int(t[1:]) * 7) % 500 == x for p, (x, t) in got.items())
    tied = df.withColumn("z", F.when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id")))
    assert sorted(r["_pos"] for r in ordering.evenly_downsample(tied, 20, "z").collect()) == sorted(got)


def test_quantiles_from_merged_sketches(spark, small_ranges):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), [math.inf, -math.inf]])
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.55, 0.9]
    assert ordering.quantiles(df, "v", probs)["v"][1:] == pytest.approx(np.quantile(v, probs[1:]))


def test_histograms_of_several_columns_at_once(spark):
    df = spark.createDataFrame([(float(i % 17), i % 5 if i % 3 else None) for i in range(200)], "a double, b int")
    both = {tuple(r) for r in charts.pair_grid_histograms(df, ["a", "b"], 4).collect()}
    single = {(n, *r) for n in ("a", "b") for r in charts.histogram(df, n, 4).select("bin", "low", "high", "count").collect()}
    assert both == single
