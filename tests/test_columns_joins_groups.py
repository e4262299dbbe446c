import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions.types import columns_by_type, name_contains, name_has_token
from tabprep.operators import aggregates as A
from tabprep.operators import columns as C
from tabprep.operators import filters as R
from tabprep.operators import joins as J


def test_names():
    assert [C.normalize_name(n) for n in ("Age", " salary  ", "Taux (%)", "a/b\\c", "_x__y_")] == [
        "age", "salary", "taux", "a_b_c", "x_y",
    ]
    assert C.unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]
    assert name_contains("humidity", ["id"]) and not name_has_token("humidity", ["id"])
    assert name_has_token("sample_id", ["id"])


def test_rename_rules():
    assert C.parse_rename_rules("a:b\n c : d \nnone\n:x\ny:") == {"a": "b", "c": "d"}


def test_type_classes(mixed):
    kinds = columns_by_type(mixed)
    assert kinds["numeric"] == ["age", "salary"]
    assert kinds["categorical"] == ["name", "city"]
    assert kinds["boolean"] == ["is_active"]


@pytest.mark.parametrize(
    "rows, schema, removed",
    [
        ([(0.0, 0, 0), (0.0, 0, 0), (1.0, 2, 3), (0.01, 0, 4)], "feature_a double, feature_b int, target int", 2),
        ([("2024-01-01", 0, 0), ("2024-01-02", 0, 0), ("2024-01-03", 1, 2)], "date_time string, feature_a int, target int", 2),
        ([("x", 0, None, 0), ("y", 0, 0.0, 0), ("z", 1, 2.0, 3)], "category string, a int, b double, target int", 2),
    ],
)
def test_zero_only_rows(spark, rows, schema, removed):
    df = spark.createDataFrame(rows, schema)
    assert df.count() - R.remove_zero_only_rows(df).count() == removed
    assert R.mark_zero_only_rows(df).filter("zero_only").count() == removed


def test_zero_only_rows_without_numbers(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert R.remove_zero_only_rows(df).count() == 1


def test_exact_zero_keeps_null(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 0)], "a int, b int")
    assert R.filter_exact_zero_rows(df).count() == 2


@pytest.mark.parametrize("how, rows", [("inner", 2), ("left", 3), ("right", 3), ("outer", 4)])
def test_merge_sizes(spark, how, rows):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "key string, val1 int")
    b = spark.createDataFrame([("B", 4), ("C", 5), ("D", 6)], "key string, val2 int")
    assert J.merge(a, b, "key", how).count() == rows


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_matches_pandas_with_null_keys(spark, how):
    a = spark.createDataFrame([(1, 10), (None, 11), (2, 12), (2, 13)], "k int, v int")
    b = spark.createDataFrame([(1, 20), (None, 21), (3, 22), (2, 23)], "k int, v int")
    want = a.toPandas().merge(b.toPandas(), on="k", how=how)
    got = J.merge(a, b, "k", how).toPandas()
    key = ["k", "v_x", "v_y"]

    def plain(f):
        return sorted(tuple(-1.0 if x != x else float(x) for x in r) for r in f[key].astype(float).to_numpy())

    assert plain(got) == plain(want)


def test_merge_errors(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="Unsupported merge method"):
        J.merge(a, a, "k", "cross")
    with pytest.raises(ValueError, match="not found"):
        J.merge(a, a, "absent")


def test_concat(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "_ord long, a int")
    b = spark.createDataFrame([(0, 3), (1, 4)], "_ord long, a int")
    assert J.concat(a, b, 0).count() == 4
    side = J.concat(a, b, 1).orderBy("_pos").select("a", "a_2").collect()
    assert [tuple(r) for r in side] == [(1, 3), (2, 4)]
    with pytest.raises(ValueError):
        J.concat(a, b, 2)


def test_duplicates_keep_first(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", 1)], "_ord long, x string, y int")
    assert sorted(r._ord for r in J.drop_duplicates(df).collect()) == [0, 2]
    assert J.duplicate_count(df).first()[0] == 1


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    got = {r.g: (r.v_sum, r.v_mean) for r in A.group_auto(df, "g").collect()}
    assert got == {"a": (0.0, None), "b": (1.0, 1.0)}


def test_grouping_errors(mixed):
    with pytest.raises(ValueError, match="not found"):
        A.group_auto(mixed, "absent")
    with pytest.raises(ValueError, match="Unknown aggregation"):
        A.group_by_functions(mixed, "city", ["median"])


def test_level_cap(mixed):
    with pytest.raises(ValueError, match="more than"):
        A.levels_of(mixed, "name", cap=10)


def test_crosstab_and_contingency_agree(mixed):
    long = A.contingency(mixed, "city", "is_active").collect()
    wide = {r.city: r for r in A.crosstab(mixed.withColumn("flag", F.col("is_active").cast("string")), "city", "flag").collect()}
    assert sum(r["count"] for r in long) == 100
    for r in long:
        assert wide[r.city][str(r.is_active).lower()] == r["count"]


@pytest.mark.parametrize("row", ["city", "name"])
def test_contingency_in_blocks_of_levels(mixed, row):
    holed = mixed.withColumn("name", F.when(F.col("age") > 25, F.col("name")))
    whole = {tuple(r) for r in A.contingency(holed, row, "name").collect()}
    blocks = A.contingency(holed, row, "name", max_levels=7).collect()
    assert {tuple(r) for r in blocks} == whole and len(blocks) == len(whole)


def _correlated(spark, rows=200):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(rows, 5)) + rng.normal(size=(rows, 1)), columns=list("abcde"))
    frame["b"] += 1e7
    frame.loc[rng.random(rows) < 0.3, "a"] = np.nan
    frame.loc[rng.random(rows) < 0.3, "c"] = np.nan
    frame["same"], frame["none"] = 0.1, np.nan
    frame["part"] = np.where(frame["a"].isna(), rng.normal(size=rows), 2.5)  # constant where a is present
    types = ", ".join(f"{n} double" for n in frame.columns)
    return frame, spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in frame.to_numpy()], types).repartition(3)


@pytest.mark.parametrize("block", [2, 3, 100])
def test_correlations_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(A, "CORRELATION_BLOCK", block)
    frame, df = _correlated(spark)
    want = frame.corr()
    want.loc["part", "a"] = want.loc["a", "part"] = np.nan
    got = {(r.var1, r.var2): r.r for r in A.correlation_pairs(df).collect()}
    names = list(frame.columns)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), r in got.items():
        assert (r is None) == bool(np.isnan(want.loc[a, b])) and (r is None or r == pytest.approx(want.loc[a, b], abs=1e-9))
    matrix = {(r.var1, r.var2): r.r for r in A.correlation_matrix(df).collect()}
    assert len(matrix) == len(names) ** 2 and matrix["b", "a"] == matrix["a", "b"] == got["a", "b"]
    assert [matrix[n, n] for n in names] == [None if n in ("same", "none") else 1.0 for n in names]
    with_b = {r.column: r.r for r in A.target_correlations(df, "b").collect()}
    assert with_b["a"] == pytest.approx(got["a", "b"]) and with_b["d"] == pytest.approx(got["b", "d"]) and with_b["same"] is None
    assert A.target_correlations(df, "b").first().column == max((n for n in with_b if with_b[n] is not None), key=with_b.get)


def test_correlations_of_odd_values(spark):
    rows = [(1.0, 2.0, 1, 5.0), (2.0, 4.5, 3, None), (3.0, float("nan"), 2, 6.0), (None, 1.0, 9, 7.0)]
    got = {(r.var1, r.var2): r.r for r in A.correlation_pairs(spark.createDataFrame(rows, "x double, y double, z int, w double")).collect()}
    assert got["x", "y"] is None and got["y", "z"] is None and got["x", "z"] == pytest.approx(0.5) and got["x", "w"] == pytest.approx(1.0)
    empty = spark.createDataFrame([], "x double, y double, z int")
    assert sorted(tuple(r) for r in A.correlation_pairs(empty).collect()) == [("x", "y", None), ("x", "z", None), ("y", "z", None)]
    assert {tuple(r) for r in A.target_correlations(empty, "z").collect()} == {("x", None), ("y", None)}
    assert A.correlation_matrix(empty).count() == 9 and A.target_correlations(empty.select("x"), "x").count() == 0
    with pytest.raises(ValueError):
        A.correlation_pairs(empty.select("x"))
