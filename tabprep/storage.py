"""Stages written to the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_LOCAL: list[str] = []
#: Bytes of a generated method beyond which HotSpot only interprets it; Spark's documented setting for that JVM.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local master without it, as in tests, gets one folder per process."""
    configured = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"Set {_KEY} to a folder that every executor can reach.")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tabprep-"))
    return _LOCAL[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write once as Parquet to the shared folder and read back.

    Later passes read only the columns they need, and a lost executor re-reads the files
    instead of repeating the work that made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabprep/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from ``materialize``, once no job needs them."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/tabprep/"
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if own.split(":", 1)[-1].lstrip("/") in folder:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Jobs started inside run under these settings of Spark; those before are put back after."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def compiled(spark: SparkSession):
    """Jobs started inside run wide projections in methods that the JVM compiles; the setting is put back after."""
    return settings(spark, dict([_METHOD_LIMIT]))
