from pyspark.sql import functions as F

from tabprep.plans import batch as B
from tabprep.plans import cleaning as L
from tabprep.plans import regression as R
from tabprep.plans import models as M
from tabprep.streaming import apply_stream, stream_table


def _tables(mixed):
    return {"a": mixed, "b": mixed.withColumn("salary", F.col("salary") * 2)}


def test_process_all_with_one_config(mixed):
    config = B.ProcessConfig(rename_rules="city:town", grouping=True, group_columns=["city"], functions=["sum", "count"])
    results = B.process_all(_tables(mixed), config)
    assert set(results) == {"a", "b"}
    assert {"town", "salary_sum", "age_count"} <= set(results["a"].final.columns)
    shapes = {r.stage: r.n_rows for r in results["a"].shapes().collect()}
    assert shapes == {"raw": 100, "cleaned": 100, "grouped": 5, "final": 5}


def test_stages_one_by_one(mixed):
    configs = {n: B.ProcessConfig(encoding=True, encoding_strategy="one_hot" if n == "a" else "label", grouping=True,
                                  group_columns=["is_active"], functions=["mean"]) for n in ("a", "b")}
    tables = {n: t.drop("name") for n, t in _tables(mixed).items()}
    cleaned = B.clean_all(tables, configs)
    encoded = B.encode_all(cleaned, configs)
    assert "city_Paris" in encoded["a"].final.columns and dict(encoded["b"].final.dtypes)["city"] == "bigint"
    grouped = B.group_all(encoded, configs)
    assert grouped["b"].final.count() == 2
    assert "city" not in B.drop_after_cleaning(cleaned["a"], ["city"]).final.columns
    assert B.remove_zero_rows_after_cleaning(cleaned["a"]).final.count() == 100


def test_stream_equals_batch(spark, tmp_path, regression):
    raw = regression.withColumn("feature_b", F.when(F.col("_ord") % 4 != 0, F.col("feature_b")))
    plan = L.fit_cleaning(raw)
    predictor = R.train_regression(plan.transform(raw), "target", folds=2, models=[M.LINEAR]).predictor
    new_rows = raw.drop("target")
    source = str(tmp_path / "in")
    new_rows.repartition(3).write.parquet(source)
    out = str(tmp_path / "out")
    query = apply_stream(
        stream_table(spark, source, new_rows.schema), [plan, predictor], out, name="t",
        checkpoint=str(tmp_path / "cp"), available_now=True,
    )
    query.awaitTermination(120)
    got = spark.read.parquet(out).orderBy("_ord").collect()
    want = predictor.transform(plan.transform(new_rows)).orderBy("_ord").collect()
    assert len(got) == 200 and got == want
