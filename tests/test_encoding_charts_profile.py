import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.operators import charts as V
from tabprep.operators import encode as E
from tabprep.operators import ordering as O
from tabprep.operators import profile as P
from tabprep.operators import sample as M


def test_smart_encoding_drops_identifiers(mixed):
    out = E.smart_encode(mixed)
    assert "name" not in out.columns and "city" not in out.columns
    assert {"city_Lille", "city_Lyon", "city_Metz", "city_Nice", "city_Paris"} <= set(out.columns)
    assert dict(out.dtypes)["is_active"] == "int"
    assert out.agg(F.sum(sum(F.col(c) for c in out.columns if c.startswith("city_")))).first()[0] == 100


def test_one_hot_cap(mixed):
    with pytest.raises(ValueError, match="more than 10 levels"):
        E.one_hot_encode(mixed, ["name"], cap=10)


def test_label_codes_match_pandas(mixed):
    frame = mixed.toPandas()
    want = dict(zip(frame["_ord"], pd.factorize(frame["city"], sort=True)[0]))
    assert {r._ord: r.city for r in E.label_encode(mixed.select("_ord", "city")).collect()} == want


def test_target_encoding_of_a_single_occurrence_is_the_prior(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 5.0)], "x string, y double")
    fitted = E.fit_target_encoding(df, "y", ["x"])
    got = {r.x_new: r.x for r in fitted.transform(df.withColumn("x_new", F.col("x"))).distinct().collect()}
    prior = 35 / 31
    s = 1 / (1 + np.exp(-(30 - 20) / 10))
    assert got["b"] == pytest.approx(prior) and got["a"] == pytest.approx(prior * (1 - s) + s)
    unseen = spark.createDataFrame([("zz",), (None,)], "x string")
    assert {r.x for r in fitted.transform(unseen).collect()} == {prior}


def test_target_encoder_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 15}", float(i)) for i in range(300)], "x string, y double")
    fitted = E.fit_target_encoder(df, "y")
    fitted.save(str(tmp_path / "state"))
    again = E.TargetEncoding.load(spark, str(tmp_path / "state"))
    probe = spark.createDataFrame([("k3",), ("new",)], "x string")
    assert again.transform(probe).collect() == fitted.transform(probe).collect()


def test_large_level_tables_are_joined_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 15}", float(i)) for i in range(300)], "x string, y double")
    want = sorted(r.x for r in E.fit_target_encoder(df, "y").transform(df).collect())
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(E, "INLINE_BYTES", 0)
    assert sorted(r.x for r in E.fit_target_encoder(df, "y").transform(df).collect()) == want


def test_long_levels_are_bounded_by_bytes(spark, monkeypatch):
    """Few levels of long texts: neither kept in the plan nor broadcast."""
    df = spark.createDataFrame([("long " * 400 + f"{i % 12}", float(i % 12)) for i in range(240)] + [(None, 1.0)], "x string, y double")
    want = sorted(r.x for r in E.label_encode(df.select("x")).collect())
    monkeypatch.setattr(E, "BROADCAST_BYTES", 20_000)
    monkeypatch.setattr(E, "INLINE_BYTES", 20_000)
    tables, sizes = E.level_tables(df, ["x"])
    assert sizes["x"] > 24_000 and tables["x"].inputFiles()
    encoded = E.label_encode(df.select("x"))
    assert "Broadcast" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" in encoded._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.x for r in encoded.collect()) == want
    assert E.fit_target_encoding(df, "y", ["x"]).tables["x"].inputFiles()


def test_no_target_encoding_needed(mixed):
    assert E.fit_target_encoder(mixed.select("city", "salary"), "salary") is None
    with pytest.raises(ValueError):
        E.fit_target_encoder(mixed, "absent")


def test_one_hot_encoder_handles_missing_unseen_and_absent(spark):
    train = spark.createDataFrame([("a", 1, 2.0), (None, 2, 3.0)], "c string, n int, gone double")
    fitted = E.OneHotEncoding.fit(train)
    assert fitted.features == ["c_a", "c_nan", "n", "gone"]
    fresh = spark.createDataFrame([("new", 5), (None, 6)], "c string, n int")
    assert [tuple(r) for r in fitted.transform(fresh).collect()] == [(0, 0, 5, 0), (0, 1, 6, 0)]


def test_encode_strategies(mixed):
    assert E.encode(mixed, "none").columns == mixed.columns
    with pytest.raises(ValueError):
        E.encode(mixed, "other")


# --- charts --------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [120, 2000])
def test_time_axis_has_at_most_forty_buckets(spark, rows):
    df = spark.range(rows).select(
        F.col("id").alias("_ord"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("date_time"),
        (F.col("id") % 50).cast("double").alias("value"),
    )
    grouped, axis = V.bucket_axis(df, "date_time")
    assert axis == "date_time_grouped"
    assert grouped.select(axis).distinct().count() <= 40
    assert V.box_data(df, "date_time", "value").agg(F.sum("n")).first()[0] == rows


def test_number_axis_matches_pandas_bins(spark):
    rng = np.random.default_rng(5)
    values = rng.exponential(10, 3000).round(1)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    edges = V.quantile_edges(df, "v")
    got = sorted(r["count"] for r in V.bin_index(df, "v", edges, "b").groupBy("b").count().collect())
    assert got == sorted(pd.qcut(values, 40, duplicates="drop").value_counts().tolist())


def test_text_axis(spark):
    df = spark.createDataFrame([(f"t{i % 60:02d}",) for i in range(600)] + [(None,)], "x string")
    grouped, axis = V.bucket_axis(df, "x")
    labels = {r[0] for r in grouped.select(axis).distinct().collect()}
    assert len(labels) == 41 and {"Other", "Missing"} <= labels


def test_few_levels_stay(mixed):
    assert V.bucket_axis(mixed, "city")[1] == "city"


def test_histogram_counts_every_row(mixed):
    out = V.histogram(mixed, "salary", 10).collect()
    assert sum(r["count"] for r in out) == 100
    assert sum(r.density * (r.high - r.low) for r in out) == pytest.approx(1)


def test_scatter_keeps_six_columns_and_limits_points(mixed):
    out = V.scatter_data(mixed, "age", "salary", max_points=30)
    assert out.count() == 30 and out.columns[:2] == ["age", "salary"] and len(out.columns) <= 6


def test_random_split_is_repeatable(mixed):
    a, b = M.random_split(mixed, 0.3)
    assert a.count() + b.count() == 100
    assert {r._ord for r in b.collect()} == {r._ord for r in M.random_split(mixed.repartition(7), 0.3)[1].collect()}


# --- profiles ------------------------------------------------------------------------------------


def test_profile_matches_pandas(mixed):
    frame = mixed.toPandas()
    got = {r.column: r for r in P.numeric_profile(mixed).collect()}
    for n in ("age", "salary"):
        s = frame[n]
        assert got[n]["count"] == 100
        for k, w in (("mean", s.mean()), ("std", s.std()), ("skewness", s.skew()), ("kurtosis", s.kurtosis()),
                     ("median", s.median()), ("q1", s.quantile(0.25))):
            assert got[n][k] == pytest.approx(w, abs=1e-4)


def test_constant_column_profile(spark):
    df = spark.createDataFrame([(1.5,)] * 10, "x double")
    r = P.numeric_profile(df).first()
    assert (r.std, r.skewness, r.kurtosis) == (0.0, 0.0, 0.0)
    assert P.variance_analysis(df).first().is_constant


def test_report_issues(spark):
    rows = [(f"id{i}", "same", None if i % 10 < 7 else i, None if i % 10 < 3 else "x", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string, c int, d string, e int")
    issues = {r.column: r.issues for r in P.quality_report(df).collect()}
    assert issues["a"] == [P.ISSUE_IDENTIFIER] and issues["b"] == [P.ISSUE_CONSTANT]
    assert issues["c"] == [P.ISSUE_HIGH_MISSING] and issues["d"] == [P.ISSUE_SOME_MISSING, P.ISSUE_CONSTANT]
    score = P.quality_score(df).first()
    assert score.completeness == pytest.approx(80.0) and score.uniqueness == 60.0 and score.grade == "C"


def test_top_values_are_cut_before_the_shuffle(mixed):
    plan = P.top_frequencies(mixed)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_negative_zero_counts_once(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert P.column_info(df).first().unique_count == 1


def test_preview(mixed):
    assert [r._ord for r in O.preview(mixed, "_ord", 3).collect()] == [0, 1, 2]


def test_axis_labels_of_close_edges_differ(spark):
    df = spark.range(400).selectExpr("1.7e9 + id AS x")
    grouped, axis = V.bucket_axis(df, "x")
    assert grouped.select(axis).distinct().count() == 40


def test_basic_stats_of_numbers_and_texts(spark):
    rows = [(1.0, "b", None), (3.0, "a", None), (None, "b", None), (5.0, "a", None), (2.0, None, None)]
    df = spark.createDataFrame(rows, "x double, g string, h string")
    got = {r.column: r for r in P.basic_stats(df, ["x", "g", "h"]).collect()}
    assert (got["x"]["count"], got["x"].mean, got["x"].min, got["x"].max, got["x"].missing) == (4, 2.75, 1.0, 5.0, 1)
    assert (got["g"]["count"], got["g"].unique, got["g"].top, got["g"].missing, got["g"].mean) == (4, 2, "a", 1, None)
    assert (got["h"]["count"], got["h"].unique, got["h"].top, got["h"].missing) == (0, 0, None, 5)
    assert P.basic_stats(df, ["g"]).first().top == "a"
