"""One Spark session for all tests, small seeded tables, and a writer of minimal workbooks."""

import sys
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(42)


@pytest.fixture
def small_ranges(monkeypatch):
    """Force the distributed paths on tiny tables."""
    from tabprep.operators import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(ordering, "DISTINCT_IN_MEMORY", 5)


@pytest.fixture(scope="session")
def mixed(spark):
    rng = np.random.default_rng(42)
    n = 100
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "_ord": np.arange(n),
                "name": [f"Person_{i}" for i in range(n)],
                "city": rng.choice(["Paris", "Lyon", "Nice", "Lille", "Metz"], n),
                "age": rng.integers(18, 70, n),
                "salary": rng.uniform(30_000, 120_000, n).round(2),
                "is_active": rng.choice([True, False], n),
            }
        )
    )


@pytest.fixture(scope="session")
def regression(spark):
    rng = np.random.default_rng(42)
    n = 200
    a, b = rng.uniform(0, 10, n), rng.uniform(0, 5, n)
    frame = pd.DataFrame(
        {
            "_ord": np.arange(n),
            "feature_a": a,
            "feature_b": b,
            "bool_flag": rng.choice([True, False], n),
            "category": rng.choice(["A", "B", "C"], n),
            "target": 3 * a + 2 * b + rng.normal(0, 0.5, n),
        }
    )
    return spark.createDataFrame(frame)


_BOOK = '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_SHEET = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
_STYLES = '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'


def _letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(value, at):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value}</v></c>'
    if isinstance(value, pd.Timestamp):
        days = (value - pd.Timestamp("1899-12-30")) / pd.Timedelta(days=1)
        return f'<c r="{at}" s="1"><v>{days}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'


def write_workbook(path, sheets):
    """sheets: name -> list of rows."""
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/workbook.xml", _BOOK.format(names))
        book.writestr("xl/_rels/workbook.xml.rels", _RELS.format(rels))
        book.writestr("xl/styles.xml", _STYLES)
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(_cell(v, f"{_letters(c)}{r}") for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            book.writestr(f"xl/worksheets/sheet{i}.xml", _SHEET.format(body))


@pytest.fixture(scope="session")
def workbook():
    return write_workbook
