"""CSV tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.types import ORD
from tabprep.operators.ordering import scan_row_number
from tabprep.sources.repair import HEADER_SEARCH_ROWS, header_position, infer_types, present, usable_names


def _first_rows(spark: SparkSession, path: str, sep: str) -> list[list[str]]:
    """Cells of the first lines of the file: its first block is read from the front."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).take(HEADER_SEARCH_ROWS + 1)
    return list(csv.reader([r[0].removeprefix("﻿") for r in lines], delimiter=sep))


def _has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so a quoted cell may go on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", header_detection: bool = True, multi_line: bool | None = None,
    row_number: bool = False,
) -> DataFrame:
    """One CSV file with header detection and type inference; columns without a header are dropped.

    The file is parsed by Spark in splits. When the header is not the first line, the lines up to it are
    skipped by their position in the file. A file whose quoted cells hold line breaks cannot be split: ``multi_line``
    says so, and None looks for lines with an open quote, in one more scan.
    """
    first = _first_rows(spark, path, sep)
    if not first:
        raise ValueError("No columns to parse from file")
    at = header_position(first, header_detection)
    names = usable_names(first[at])
    width = len(names)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    if multi_line is None:
        multi_line = _has_open_quotes(spark, path)
    if at == 0:
        raw = spark.read.schema(schema).csv(path, header=True, sep=sep, multiLine=multi_line, enforceSchema=True)
    elif multi_line:
        # Such a file is read by one task in order; empty lines are no records.
        before = sum(1 for cells in first[: at + 1] if cells)
        records = spark.read.schema(schema).csv(path, sep=sep, multiLine=True)
        numbered = records.withColumn("_record", F.monotonically_increasing_id())
        raw = numbered.filter(F.col("_record") >= before).drop("_record")
    else:
        # A single file is scanned in order, so the row position in the first partition is the line number.
        lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
        data = lines.filter((F.col("_line") > at) & (F.trim("value") != ""))
        raw = data.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r")).select("r.*")
    if row_number:
        raw = scan_row_number(raw, ORD)
    kept = [present(F.col(f"_{i}")).alias(n) for i, n in enumerate(names) if n is not None]
    table = raw.select(*([F.col(ORD)] if row_number else []), *kept)
    return infer_types(table)
