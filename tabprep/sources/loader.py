"""One entry for all tabular files."""

from __future__ import annotations

import logging
import posixpath
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.sources.delimited import read_csv
from tabprep.sources.workbook import sheet_names, sheet_table

logger = logging.getLogger(__name__)

# The accepted file name endings.
FORMATS = ("csv", "xlsx", "xlsm")
Loaded = DataFrame | dict[str, DataFrame]


def file_format(path: str) -> str:
    kind = posixpath.splitext(str(path))[1].lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"Unsupported file format. Please use one of: {', '.join('.' + f for f in FORMATS)}.")
    return kind


def require_path(spark: SparkSession, path: str) -> None:
    """Ask the file system that Spark uses whether the path exists."""
    try:
        spark.read.format("binaryFile").load(str(path)).schema
    except AnalysisException as exc:
        raise FileNotFoundError(f"Input file not found: {path}") from exc


def workbook_sheets(spark: SparkSession, path: str) -> list[str]:
    """Sheet names of one workbook in order."""
    require_path(spark, path)
    if file_format(path) == "csv":
        raise ValueError("Sheet inspection is only available for Excel files.")
    return [r.sheet for r in sheet_names(spark, str(path)).orderBy("position").collect()]


def _load_sheets(spark, path, sheet_name, load_all_sheets, options) -> Loaded:
    available = workbook_sheets(spark, path)
    if load_all_sheets or sheet_name is None:
        wanted: list = list(available)
    else:
        wanted = list(sheet_name) if isinstance(sheet_name, (list, tuple)) else [sheet_name]
    tables = {}
    for choice in wanted:
        name = available[choice] if isinstance(choice, int) and choice < len(available) else choice
        if name not in available:
            raise ValueError(f"Sheet '{choice}' not found in '{posixpath.basename(path)}'. Available sheets: {available}")
        tables[str(choice)] = sheet_table(spark, path, name, **options)
    single = not load_all_sheets and sheet_name is not None and not isinstance(sheet_name, (list, tuple))
    return next(iter(tables.values())) if single else tables


def load(
    spark: SparkSession, path: str, *, sheet_name=0, load_all_sheets: bool = False, header_detection: bool = True,
    row_number: bool = False, sep: str = ",", multi_line: bool | None = None,
) -> Loaded:
    """Load a CSV file or one, several or all sheets of a workbook.

    ``sheet_name`` is a name, a position, a list of these, or None for all sheets; several sheets give a
    mapping. ``row_number`` adds the row identity column. ``sep`` and ``multi_line`` are for CSV files.
    """
    path = str(path)
    require_path(spark, path)
    kind = file_format(path)
    options = {"header_detection": header_detection, "row_number": row_number}
    try:
        if kind == "csv":
            return read_csv(spark, path, sep, multi_line=multi_line, **options)
        return _load_sheets(spark, path, sheet_name, load_all_sheets, options)
    except Exception as exc:
        raise ValueError(f"Failed to load file '{posixpath.basename(path)}': {exc}") from exc


def loader(spark: SparkSession, path: str, **options) -> Loaded:
    """Earlier name of :func:`load`."""
    return load(spark, path, **options)


def load_batch(
    spark: SparkSession, paths: Iterable[str], *, sheet_names: Mapping[str, object] | None = None,
    load_all_sheets: bool = False, skip_errors: bool = False, **options,
) -> dict[str, Loaded]:
    """Load several files; failures are skipped or reported together at the end."""
    chosen = {str(k): v for k, v in (sheet_names or {}).items()}
    tables: dict[str, Loaded] = {}
    failures: dict[str, str] = {}
    for path in map(str, paths):
        sheet = chosen.get(path)
        try:
            tables[path] = load(
                spark, path, sheet_name=0 if sheet is None else sheet, load_all_sheets=load_all_sheets, **options
            )
        except (ValueError, FileNotFoundError) as exc:
            failures[path] = str(exc)
            logger.warning("Could not load '%s': %s", path, exc)
    if failures and not skip_errors:
        listed = "; ".join(f"{p}: {m}" for p, m in failures.items())
        raise ValueError(f"Batch load failed for one or more files: {listed}")
    return tables


def flatten_workbooks(loaded: Mapping[str, Loaded]) -> dict[str, DataFrame]:
    """Keys ``file`` for single tables and ``file_sheet`` for the sheets of a workbook."""
    out: dict[str, DataFrame] = {}
    for path, item in loaded.items():
        name = posixpath.basename(str(path))
        if isinstance(item, DataFrame):
            out[name] = item
        else:
            out.update({f"{name}_{sheet}": table for sheet, table in item.items()})
    return out


def stack_tables(tables: Mapping[str, DataFrame], key: str = "source") -> DataFrame:
    """All tables under one another with their key in a column; missing columns are null."""
    parts = [table.withColumn(key, F.lit(name)) for name, table in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
