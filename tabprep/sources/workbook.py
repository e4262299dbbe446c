"""Excel workbooks (.xlsx, .xlsm): a Spark job over one or many workbooks.

Spark reads the files, so any file system it knows works. A workbook has at most 1 048 576 rows per
sheet by its format, and its cells leave the parser in batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.functions.types import ORD
from tabprep.sources.repair import HEADER_SEARCH_ROWS, header_position, infer_types, present, usable_names

BATCH_ROWS = 5_000
# Built-in number formats that show a date or a time, and the day that serial 0 stands for.
DATE_FORMATS = frozenset({*range(14, 23), *range(45, 48)})
EPOCH = datetime(1899, 12, 30)

_SHEET_SCHEMA = "path string, position int, sheet string"
_CELL_SCHEMA = "path string, sheet string, row long, cells array<string>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part name) in workbook order."""
    targets = {}
    for rel in _part(book, "xl/_rels/workbook.xml.rels"):
        target = rel.get("Target")
        targets[rel.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for node in _part(book, "xl/workbook.xml").iter():
        if _local(node.tag) == "sheet":
            rid = next(v for k, v in node.attrib.items() if _local(k) == "id")
            out.append((node.get("name"), targets[rid]))
    return out


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = set()
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", node.get("formatCode", ""))
            if re.search("[ymdhs]", code, re.IGNORECASE):
                custom.add(int(node.get("numFmtId")))
    dated = DATE_FORMATS | custom
    for node in root:
        if _local(node.tag) == "cellXfs":
            return {i for i, xf in enumerate(node) if int(xf.get("numFmtId", 0)) in dated}
    return set()


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _cell_text(cell, texts: list[str], dated: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind is None and int(cell.get("s", 0)) in dated:
        return (EPOCH + timedelta(days=float(value))).replace(microsecond=0).isoformat(sep=" ")
    return value


def _rows(book: zipfile.ZipFile, part: str, texts: list[str], dated: set[int]) -> Iterator[list[str | None]]:
    """Cells of each row that holds a value, streamed from the sheet part."""
    with book.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) != "row":
                continue
            cells: list[str | None] = []
            for position, cell in enumerate(node):
                at = _column_number(cell.get("r", "")) if cell.get("r") else position
                cells.extend([None] * (at + 1 - len(cells)))
                cells[at] = _cell_text(cell, texts, dated)
            node.clear()
            if any(c is not None for c in cells):
                yield cells


def _list_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                names = [name for name, _ in _sheets(book)]
            yield pd.DataFrame({"path": path, "position": range(len(names)), "sheet": names})


def _read_cells(wanted: list[str] | None):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    texts, dated = _shared_texts(book), _date_styles(book)
                    for sheet, part in _sheets(book):
                        if wanted is not None and sheet not in wanted:
                            continue
                        held: list[list[str | None]] = []
                        start = 0
                        for cells in _rows(book, part, texts, dated):
                            held.append(cells)
                            if len(held) == BATCH_ROWS:
                                yield _frame(path, sheet, start, held)
                                start, held = start + len(held), []
                        if held:
                            yield _frame(path, sheet, start, held)

    return read


def _frame(path: str, sheet: str, start: int, rows: list) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "sheet": sheet, "row": range(start, start + len(rows)), "cells": rows})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, sheet) of one workbook or of all workbooks under a path."""
    return _files(spark, path).mapInPandas(_list_sheets, _SHEET_SCHEMA)


def read_workbook(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """(path, sheet, row, cells) of the wanted sheets, all sheets by default."""
    return _files(spark, path).mapInPandas(_read_cells(sheets), _CELL_SCHEMA)


def sheet_table(
    spark: SparkSession, path: str, sheet: str, header_detection: bool = True, row_number: bool = False
) -> DataFrame:
    """One sheet of one workbook as a table, with header detection and type inference."""
    cells = read_workbook(spark, path, [sheet])
    first = cells.filter(F.col("row") <= HEADER_SEARCH_ROWS).orderBy("row").limit(HEADER_SEARCH_ROWS + 1).collect()
    if not first:
        return spark.createDataFrame([], "empty string").drop("empty")
    width = max(len(r.cells) for r in first)
    rows = [list(r.cells) + [None] * (width - len(r.cells)) for r in first]
    at = header_position(rows, header_detection)
    kept = [
        present(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(usable_names(rows[at])) if n is not None
    ]
    data = cells.filter(F.col("row") > at)
    order = [(F.col("row") - F.lit(at + 1)).alias(ORD)] if row_number else []
    return infer_types(data.select(*order, *kept))
