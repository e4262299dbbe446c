"""Apply fitted cleaning, encoding and prediction to a stream of new rows."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabprep.storage import shared_dir


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


def stream_table(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", **options) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)


def apply_stream(
    source: DataFrame, steps: Iterable[Fitted], path: str, *, name: str, file_format: str = "parquet",
    checkpoint: str | None = None, available_now: bool = False, interval: str = "1 minute",
) -> StreamingQuery:
    """Write the transformed stream; the same stateless steps serve batch tables.

    Progress is kept in the shared folder under ``name``, so a restarted query goes on where it stopped and
    every input file is used exactly once.
    """
    out = source
    for step in steps:
        out = step.transform(out)
    place = checkpoint or f"{shared_dir(source.sparkSession)}/tabprep/streams/{name}"
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    writer = out.writeStream.format(file_format).option("checkpointLocation", place).outputMode("append")
    return writer.trigger(**trigger).start(path)
