"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.types import ORD, col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True, sep: str = ",") -> None:
    """Write a folder of CSV parts, one per partition; nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    out = [
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
        for f in df.schema.fields
        if f.name != ORD
    ]
    df.select(*out).write.csv(path, mode=mode, header=header, sep=sep)
