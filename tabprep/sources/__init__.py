"""Readers and writers."""

from tabprep.sources.loader import flatten_workbooks, load, load_batch, loader, stack_tables
from tabprep.sources.sinks import write_csv
from tabprep.sources.workbook import read_workbook, sheet_names, sheet_table

__all__ = [
    "flatten_workbooks",
    "load",
    "load_batch",
    "loader",
    "read_workbook",
    "sheet_names",
    "sheet_table",
    "stack_tables",
    "write_csv",
]
