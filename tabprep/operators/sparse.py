"""One-hot encoding of text columns with any number of levels: one sparse vector column instead of a column per level."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.scalars import finite_or
from tabprep.functions.types import ORD, boolean_columns, col, numeric_columns
from tabprep.operators.ordering import with_row_number
from tabprep.storage import materialize

#: A level table up to this many bytes of text goes to every task; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Text form of a missing value in feature names.
MISSING_NAME = "nan"


def _text(df: DataFrame, name: str) -> Column:
    return col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def entries_of(vector: str) -> Column:
    """Number of non-zero entries of a vector; a sparse one is not spread out."""
    return F.size(F.filter(F.unwrap_udt(col(vector))["values"], lambda v: v != 0))


def size_of(vector: str) -> Column:
    """Width of a vector; a sparse one is not spread out."""
    parts = F.unwrap_udt(col(vector))
    return F.coalesce(parts["size"], F.size(parts["values"]))


@dataclass
class SparseEncoding:
    """Fitted encoding: numbers have the first codes, then the levels of each text column in their order.

    ``levels`` is a written table (place, level, code, weight, n) with one row per level; a missing value is the null level.
    ``numbers`` maps a column to (value for missing, centre, scale).
    """

    numbers: dict[str, tuple[float, float, float]]
    text: list[str]
    levels: DataFrame
    size: int
    bytes: list[int]
    target: str | None = None
    removed: int = 0
    removed_numbers: list[str] = field(default_factory=list)

    def _number(self, df: DataFrame, name: str) -> Column:
        fill, centre, scale = self.numbers[name]
        if name not in df.columns:
            return F.lit(0.0)
        return (finite_or(col(name).cast("double"), fill) - F.lit(centre)) / F.lit(scale)

    def _table(self, place: int) -> DataFrame:
        """Codes of one text column by a key that is never null."""
        key = F.coalesce(F.concat(F.lit("="), F.col("level")), F.lit(""))
        table = self.levels.filter(F.col("place") == place).select(key.alias(f"_k{place}"), F.col("code").alias(f"_c{place}"), F.col("weight").alias(f"_w{place}"))
        return F.broadcast(table) if self.bytes[place] <= BROADCAST_BYTES else table

    def cells(self, df: DataFrame, key: str) -> DataFrame:
        """(key, code, value): the non-zero entries of each row; unseen levels and absent columns have none."""
        parts = [F.struct(F.lit(i).cast("long").alias("code"), self._number(df, n).alias("value")) for i, n in enumerate(self.numbers)]
        out = None
        if parts:
            out = df.select(col(key), F.explode(F.array(*parts)).alias("p")).select(col(key), "p.code", "p.value").filter("value <> 0")
        if self.text:
            pairs = F.array(*[F.struct(F.lit(i).alias("place"), _text(df, n).alias("level")) for i, n in enumerate(self.text) if n in df.columns])
            rows = df.select(col(key), F.explode(pairs).alias("p")).select(col(key), F.col("p.place").alias("_p"), F.col("p.level").alias("_l"))
            table = self.levels.select("place", "level", "code", "weight")
            table = F.broadcast(table) if sum(self.bytes) <= BROADCAST_BYTES else table
            found = rows.join(table, (F.col("_p") == F.col("place")) & F.col("_l").eqNullSafe(F.col("level")))
            found = found.select(col(key), "code", F.col("weight").alias("value"))
            out = found if out is None else out.unionByName(found)
        return out

    def with_vector(self, df: DataFrame, vector: str = "features") -> DataFrame:
        """The table with one sparse vector column added; works on streams. A column of that name is refused."""
        if vector in df.columns:
            raise ValueError(f"Column '{vector}' would be overwritten.")
        staged = df.select(F.struct(*[col(n) for n in df.columns]).alias("_row"), *[
            F.coalesce(F.concat(F.lit("="), _text(df, n)), F.lit("") if n in df.columns else F.lit(None)).alias(f"_k{i}") for i, n in enumerate(self.text)
        ], F.array(*[self._number(df, n) for n in self.numbers]).cast("array<double>").alias("_x"))
        for i in range(len(self.text)):
            staged = staged.join(self._table(i), f"_k{i}", "left")
        places = range(len(self.text))
        packed = staged.select(
            "_row", "_x", F.array(*[F.col(f"_c{i}") for i in places]).cast("array<long>").alias("_c"),
            F.array(*[F.col(f"_w{i}") for i in places]).cast("array<double>").alias("_w"),
        )
        size, numbers, texts = self.size, len(self.numbers), len(self.text)

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                x, code, weight = (
                    batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, w)
                    for i, w in ((1, numbers), (2, texts), (3, texts))
                )
                codes = np.hstack([np.broadcast_to(np.arange(numbers), (n, numbers)), np.where(np.isnan(code), -1, code)]).astype(np.int32)
                values = np.hstack([x, weight])
                there = (codes >= 0) & (values != 0)
                ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]), pa.int32())
                made = pa.StructArray.from_arrays([
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(codes[there])), pa.ListArray.from_arrays(ends, pa.array(values[there])),
                ], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["_row", vector])

        shape = T.StructType([T.StructField("_row", packed.schema["_row"].dataType), T.StructField(vector, VectorUDT())])
        return packed.mapInArrow(run, shape).select("_row.*", F.col(f"`{vector}`"))

    def feature_names(self) -> DataFrame:
        """(code, feature) of all features: the name of a number, or column_level."""
        names = F.array(*[F.lit(n) for n in self.text]) if self.text else F.array(F.lit(""))
        level = F.concat(F.get(names, F.col("place")), F.lit("_"), F.coalesce("level", F.lit(MISSING_NAME)))
        own = self.levels.sparkSession.createDataFrame(list(enumerate(self.numbers)), "code long, feature string")
        return own.unionByName(self.levels.select("code", level.alias("feature")))

    def importance(self, model, top: int | None = 15) -> DataFrame:
        """(feature, importance): absolute coefficients or tree importances, highest first."""
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
        rows = [(i, abs(float(v))) for i, v in enumerate(values.toArray())]
        found = self.levels.sparkSession.createDataFrame(rows, "code long, importance double").join(self.feature_names(), "code")
        out = found.select("feature", "importance").orderBy(F.col("importance").desc(), "feature")
        return out if top is None else out.limit(top)

    def save(self, path: str, spark: SparkSession) -> None:
        state = {k: v for k, v in vars(self).items() if k != "levels"}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")
        self.levels.write.parquet(f"{path}/levels")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> SparseEncoding:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        state["numbers"] = {n: tuple(v) for n, v in state["numbers"].items()}
        return cls(levels=spark.read.parquet(f"{path}/levels"), **state)


def _level_sums(df: DataFrame, text: list[str], y: Column) -> DataFrame:
    """(place, level, n, d): rows and sum of ``y`` of each level, nulls included; equal levels are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), _text(df, n).alias("level")) for i, n in enumerate(text)])
    rows = df.select(F.explode(pairs).alias("p"), y.alias("y"))
    return rows.groupBy("p.place", "p.level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("d"))


def _coded(df: DataFrame, counted: DataFrame, first: int, text: list[str]) -> tuple[DataFrame, int, list[int]]:
    """The written level table with codes from ``first`` on, the number of all features and the bytes per text column."""
    if not text:
        empty = df.sparkSession.createDataFrame([], "place int, level string, code long, weight double, n long")
        return empty, first, []
    levels = materialize(with_row_number(counted.select("place", "level", "weight", "n"), ["place", "level"], "code", first).select("place", "level", "code", "weight", "n"))
    sizes = {r["place"]: (r["n"], r["b"]) for r in levels.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("level"), F.lit(0)) + 24).alias("b")).collect()}
    return levels, first + sum(n for n, _ in sizes.values()), [sizes.get(i, (0, 0))[1] for i in range(len(text))]


def fit_sparse_encoding(df: DataFrame, columns: Iterable[str] | None = None) -> SparseEncoding:
    """0/1 entries for the levels of the text columns (all of them by default), with no limit on their number."""
    numbers = set(numeric_columns(df)) | set(boolean_columns(df))
    text = [n for n in df.columns if n != ORD and n not in numbers] if columns is None else list(columns)
    counted = _level_sums(df, text, F.lit(0.0)).withColumn("weight", F.lit(1.0)) if text else None
    levels, size, sizes = _coded(df, counted, 0, text)
    return SparseEncoding({}, text, levels, size, sizes)


def one_hot_sparse(df: DataFrame, columns: Iterable[str] | None = None, vector: str = "one_hot") -> DataFrame:
    """The table with its text columns replaced by one sparse 0/1 vector; missing values have an entry of their own."""
    plan = fit_sparse_encoding(df, columns)
    return plan.with_vector(df, vector).drop(*plan.text)
