import pytest
from pyspark.sql import functions as F

from tabprep.functions import scalars as S
from tabprep.operators import clean as C
from tabprep.operators import columns as K
from tabprep.operators import ordering as O
from tabprep.plans import cleaning as L


@pytest.fixture(scope="module")
def with_missing(spark):
    rows = []
    for i in range(50):
        rows.append((i, None if i < 5 else float(i), [None, "X", "Y", "Z"][i % 4], None if 10 <= i < 15 else i * 0.5,
                     None if 20 <= i < 25 else i / 50))
    return spark.createDataFrame(rows, "_ord long, col_a double, col_b string, col_c double, col_d double")


@pytest.mark.parametrize(
    "text, want",
    [("06H00", "06:00:00"), ("6h", "06:00:00"), ("06:30", "06:30:00"), ("600", "06:00:00"), ("1430", "14:30:00"),
     ("24", "24:00:00"), ("6", "06:00:00"), (" 7 h 5 ", "07:05:00"), ("noon", "noon"), ("123456", "1234:56:00")],
)
def test_parse_time(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_time(F.col("t"))).first()[0] == want


def test_unreadable_values_become_null(spark):
    df = spark.createDataFrame([("12",), ("x",), ("nan",), (None,)], "t string")
    assert [r[0] for r in df.select(S.to_number(F.col("t"))).collect()] == [12.0, None, None, None]
    assert [r[0] for r in df.select(S.to_timestamp(F.lit("24:00:00 x"))).limit(1).collect()] == [None]


def test_static_imputation(with_missing):
    out = C.impute_static(with_missing)
    assert sum(C.null_counts(out).values()) == 0
    assert out.filter("_ord = 0").first().col_a == pytest.approx(sum(range(5, 50)) / 45)
    assert out.filter("_ord = 4").first().col_b == "X"


def test_all_null_text_becomes_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "n int, t string")
    assert {r.t for r in C.impute_static(df).collect()} == {"Unknown"}


def test_pipeline_removes_nulls_and_duplicates(with_missing):
    doubled = with_missing.unionByName(with_missing.withColumn("_ord", F.col("_ord") + 100))
    out = L.clean(doubled)
    assert out.count() == 50
    assert sum(C.null_counts(out).values()) == 0
    assert set(out.columns) == {"_ord", "col_a", "col_b", "col_c", "col_d"}


def test_no_missing_value_means_no_dropped_column(spark):
    df = spark.createDataFrame([(1, "x" * 80, "http://a"), (2, "y", "http://b")], "user_id int, note string, link string")
    assert set(L.clean(df).columns) == {"user_id", "note", "link"}
    holed = df.unionByName(spark.createDataFrame([(None, "z", "http://c")], df.schema))
    assert L.clean(holed).columns == []


def test_blocks_follow_row_numbers_after_deduplication(spark):
    # Row 1 repeats row 0, so rows 2 and 3 stay in the second block of two.
    levels = [("a", 1.0), ("a", 1.0), ("b", None), ("b", 9.0), ("c", None)]
    rows = [(i, "2024-01-01", tag, level) for i, (tag, level) in enumerate(levels)]
    df = spark.createDataFrame(rows, "_ord long, date string, tag string, level double")
    out = {r._ord: r.level for r in L.clean(df, "frequence", 2, downcast=False).collect()}
    assert out == {0: 1.0, 2: 9.0, 3: 9.0, 4: 0.0}


def test_long_blocks_use_the_distributed_median(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").alias("_ord"), F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("v"))
    want = [tuple(r) for r in C.impute_by_block(df, 10).orderBy("_ord").collect()]
    monkeypatch.setattr(C, "BLOCK_IN_MEMORY", 5)
    assert [tuple(r) for r in C.impute_by_block(df, 10).orderBy("_ord").collect()] == want


def test_frequency_falls_back_to_static_without_a_date(with_missing):
    assert sum(C.null_counts(L.clean(with_missing, "frequence")).values()) == 0


def test_frequency_drops_empty_dates(spark):
    rows = [(0, "2024-01-01", 0.0), (1, "2024-01-01", None), (2, "2024-01-02", -1.0), (3, None, 5.0)]
    df = spark.createDataFrame(rows, "_ord long, date string, level double")
    assert [r._ord for r in L.clean(df, "frequence").collect()] == [2]


def test_convertible_columns(spark):
    rows = [(i, str(i), f"n{i}", "12" if i % 5 else "x", "5e3") for i in range(20)]
    df = spark.createDataFrame(rows, "_ord long, digits string, names string, mostly string, expo string")
    assert C.convertible_columns(df) == ["digits", "mostly", "expo"]


def test_narrowed_types(spark):
    df = spark.createDataFrame([(1, 300, 70_000, 1.5)], "a long, b long, c long, d double")
    assert dict(C.optimize_types(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float"}


def test_date_and_time_columns_merge(spark):
    df = spark.createDataFrame([("2024-01-02", "06H30", 1), ("2024-01-02", "bad", 2)], "date_c string, heure string, v int")
    out = C.merge_date_and_time(df)
    assert out.columns == ["v", "date_time"]
    assert [str(r.date_time) for r in out.orderBy("v").collect()] == ["2024-01-02 06:30:00", "None"]


def test_failed_date_candidate_is_left_alone(spark):
    df = spark.createDataFrame([("no", 1)], "update_note string, v int")
    assert C.merge_date_and_time(df).first().update_note == "no"


@pytest.mark.parametrize("strategy", C.MISSING_VALUE_STRATEGIES)
def test_strategies_run(with_missing, strategy):
    out = C.handle_missing(with_missing, strategy)
    if strategy not in ("interpolate", "drop_columns", "fill_mean", "fill_median", "fill_zero"):
        assert sum(C.null_counts(out).values()) == 0


def test_unknown_strategy(with_missing):
    with pytest.raises(ValueError):
        C.handle_missing(with_missing, "guess")


def test_url_columns(spark):
    df = spark.createDataFrame([("https://a", "x"), ("WWW.b", "y"), ("c", "z"), (None, "w")], "a string, b string")
    assert K.url_columns(df, 0.6) == ["a"] and K.url_columns(df, 0.7) == []


def test_plan_has_no_single_partition_window(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 50)
    df = spark.range(1000).select(F.col("id").alias("_ord"), (F.col("id") * 7 % 1000).alias("x"))
    plan = O.with_row_number(df, ["x", "_ord"], "rn")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_fitted_plan_keeps_values_outside_the_fitted_range(spark):
    from tabprep.plans.cleaning import fit_cleaning

    plan = fit_cleaning(spark.range(50).selectExpr("id AS _ord", "id AS amount", "cast(id AS string) AS code"))
    fresh = spark.createDataFrame([(0, 200, "300"), (1, 1 << 40, "7")], "_ord long, amount long, code string")
    assert [r.amount for r in plan.transform(fresh).orderBy("_ord").collect()] == [200, 1 << 40]


def test_excluded_text_columns_stay_text(spark):
    df = spark.createDataFrame([(0, "1"), (1, "2")], "_ord long, month string")
    assert C.optimize_types(df).schema["month"].dataType.simpleString() == "string"


def test_null_runs_takes_all_columns(spark):
    df = spark.range(20).selectExpr("id + 1 AS _ord", *[f"CASE WHEN id % {i + 2} = 0 THEN NULL ELSE id END AS c{i}" for i in range(7)])
    assert C.null_runs(df).count() == 7
