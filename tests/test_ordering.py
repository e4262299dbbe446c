"""Global order: the distributed paths are forced by tiny ranges, also with one hot value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.operators import clean as C
from tabprep.operators import ordering as O


@pytest.fixture(scope="module")
def hot(spark):
    """1000 rows; one value and one group hold a third of them."""
    rng = np.random.default_rng(7)
    v = np.where(rng.random(1000) < 0.35, 5.0, rng.normal(10, 4, 1000).round(1))
    g = np.where(rng.random(1000) < 0.4, "big", rng.choice(["s", "t", "u"], 1000))
    frame = pd.DataFrame({"id": np.arange(1000), "v": v, "g": g, "t": [f"k{i % 17:02d}" for i in range(1000)]})
    return spark.createDataFrame(frame).repartition(5), frame


@pytest.mark.parametrize("keys", [["v", "id"], ["t", "id"], ["g", "id"]])
def test_row_number(hot, small_ranges, keys):
    df, frame = hot
    got = O.with_row_number(df, keys, "rn").toPandas().sort_values("rn")
    want = frame.sort_values(keys)
    assert (got["rn"].to_numpy() == np.arange(1000)).all()
    assert (got["id"].to_numpy() == want["id"].to_numpy()).all()


def test_hot_value_is_cut_again(hot, small_ranges):
    df, _ = hot
    ranged, ranges = O.split_ranges(df, "v", "_r")
    cut = O._cut_crowded_ranges(ranged, ["v", "id"])
    largest = cut.groupBy("_r").count().agg(F.max("count")).first()[0]
    assert ranges > 5 and largest <= 4 * O.ROWS_PER_RANGE


def test_row_number_with_nulls(spark, small_ranges):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("x"))
    got = [r.id for r in O.with_row_number(df, ["x", "id"], "rn").orderBy("rn").collect()]
    assert got == [i for i in range(0, 300, 3)] + [i for i in range(300) if i % 3]


def test_average_ranks_match_pandas(hot, small_ranges):
    df, frame = hot
    got = O.average_ranks(df, "v", "g").toPandas()
    want = frame.assign(r=frame.groupby("g")["v"].rank())[["g", "v", "r"]].drop_duplicates()
    both = got.merge(want, on=["g", "v"])
    assert len(both) == len(got) == len(want)
    assert np.allclose(both["avg_rank"], both["r"])


@pytest.mark.parametrize("p", [0.0, 0.77, 1.0])
def test_quantiles_both_paths(hot, p, monkeypatch):
    df, frame = hot
    want = frame["v"].quantile(p)
    assert O.quantiles(df, "v", [p])["v"][0] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(O, "DISTINCT_IN_MEMORY", 5)
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 50)
    assert O.quantiles(df, "v", [p])["v"][0] == pytest.approx(want, abs=1e-12)


def test_quantile_bracket_is_widened_when_it_misses(hot, small_ranges, monkeypatch):
    df, frame = hot
    monkeypatch.setattr(O, "SKETCH_ACCURACY", 20)
    got = O.quantiles(df, ["v", "id"], [0.1, 0.5, 0.9])
    assert got["v"] == pytest.approx(frame["v"].quantile([0.1, 0.5, 0.9]).tolist())
    assert got["id"] == pytest.approx(frame["id"].quantile([0.1, 0.5, 0.9]).tolist())


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert O.quantiles(df, "x", [0.5]) == {"x": [None]}


def test_group_quantiles(hot, small_ranges):
    df, frame = hot
    got = {r.g: r.q for r in O.group_quantiles(df, "v", "g", {"q": 0.3}).collect()}
    assert got == pytest.approx(frame.groupby("g")["v"].quantile(0.3).to_dict())


def test_group_key_may_have_any_name(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0)], "n string, total double")
    assert [tuple(r) for r in O.group_quantiles(df, "total", "n", {"before": 0.5}).collect()] == [("x", 2.0)]


def test_scan_row_number(spark, tmp_path):
    spark.range(500).repartition(7).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    got = O.scan_row_number(df, "rn").toPandas()
    assert sorted(got["rn"]) == list(range(500))
    assert (got.sort_values("rn")["id"].to_numpy() == df.toPandas()["id"].to_numpy()).all()


@pytest.mark.parametrize("m", [1, 7, 999, 5000])
def test_evenly_downsample(hot, small_ranges, m):
    df, _ = hot
    got = sorted(r.id for r in O.evenly_downsample(df, m, "id").collect())
    want = list(range(1000)) if m >= 1000 else np.linspace(0, 999, m, dtype=int).tolist()
    assert got == want


def test_interpolate_matches_pandas(spark, small_ranges):
    rng = np.random.default_rng(3)
    v = pd.Series(np.where(rng.random(400) < 0.6, np.nan, rng.normal(0, 1, 400)))
    v[:5] = np.nan
    v[100:220] = np.nan
    v[390:] = np.nan
    df = spark.createDataFrame([(i, None if x != x else float(x)) for i, x in enumerate(v)], "_ord long, v double")
    got = [r.v for r in C.interpolate_linear(df, ["v"]).orderBy("_ord").collect()]
    want = v.interpolate()
    assert [None if w != w else pytest.approx(w) for w in want] == got


def test_null_runs_across_ranges(spark, small_ranges):
    rows = [(i, None if 90 <= i < 260 or i in (0, 5, 6) else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "_ord long, v double")
    r = C.null_runs(df, ["v"]).first()
    assert (r.null_count, r.null_runs, r.longest_run, r.first_valid, r.last_valid) == (173, 3, 170, 1, 299)


def test_row_number_of_texts_with_a_common_prefix(spark, monkeypatch):
    """Texts that share 15 bytes, one of them on a third of the rows, nulls, and infinite or missing second keys."""
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 50)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(f"https://site.co{i * 7919 % 900:05d}" if i % 3 else "https://site.co", float(i * 31 % 101), i) for i in range(1500)]
    rows += [(None, odd[i % 4] if i % 5 == 0 else i / 7, 2000 + i) for i in range(200)]
    rows += [("https://site.co", odd[i % 4], 3000 + i) for i in range(40)] + [("a", 1.0, 4000), ("zz", None, 4001), ("", 0.0, 4002)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(3)
    ranged, _ = O.split_ranges(df, "k", "_r")
    cut = [r["count"] for r in O._cut_crowded_ranges(ranged, ["k", "v", "i"]).groupBy("_r").count().collect()]
    assert sum(cut) == len(rows) and len(cut) > 20 and max(cut) <= 150
    got = [r.i for r in O.with_row_number(df, ["k", "v", "i"], "_n").orderBy("_n").collect()]
    assert got == [r.i for r in df.coalesce(1).sortWithinPartitions("k", "v", "i").collect()]
    numbers = [r["_n"] for r in O.with_row_number(df, ["k", "v", "i"], "_n").select("_n").collect()]
    assert sorted(numbers) == list(range(min(numbers), min(numbers) + len(rows)))
