import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep import sources as S
from tabprep.sources.repair import header_position, keyword_rows


@pytest.fixture
def csv_file(tmp_path, mixed):
    path = tmp_path / "mixed.csv"
    mixed.drop("_ord").toPandas().to_csv(path, index=False)
    return str(path)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types(spark, csv_file):
    df = S.load(spark, csv_file)
    assert dict(df.dtypes) == {"name": "string", "city": "string", "age": "bigint", "salary": "double", "is_active": "boolean"}
    assert df.count() == 100


def test_csv_row_numbers(spark, csv_file):
    df = S.load(spark, csv_file, row_number=True)
    assert [r["name"] for r in df.orderBy("_ord").limit(2).collect()] == ["Person_0", "Person_1"]


def test_header_on_a_later_line(spark, tmp_path):
    path = write(tmp_path, "report.csv", "Export of plant 7,,\nmade by A,,\nDate,Level,Note\n2024-01-01,1.5,a\n2024-01-02,,b\n")
    df = S.load(spark, path)
    assert df.columns == ["Date", "Level", "Note"]
    assert [r.Level for r in df.orderBy("Date").collect()] == [1.5, None]
    plain = S.load(spark, path, header_detection=False)
    assert plain.count() == 4


def test_unnamed_column_is_dropped(spark, tmp_path):
    df = S.load(spark, write(tmp_path, "u.csv", ",col1,col2\n0,1,a\n1,2,b\n"))
    assert df.columns == ["col1", "col2"]


def test_mostly_numeric_text_becomes_numeric(spark, tmp_path):
    body = "\n".join(f"{v},n{i}" for i, v in enumerate(["1", "2", "3", "4", "bad"]))
    df = S.load(spark, write(tmp_path, "n.csv", "a,b\n" + body + "\n"))
    assert dict(df.dtypes) == {"a": "double", "b": "string"}
    assert df.filter(F.col("a").isNull()).count() == 1


def test_keyword_rows():
    assert keyword_rows([["x", 1], ["TIMESTAMP", 2], ["z", "la date"]]) == [1, 2]
    assert keyword_rows([["x"], ["y"]]) == []
    assert header_position([["a"], ["b"], ["Date"]]) == 2


def test_workbook_sheets(spark, tmp_path, workbook):
    path = str(tmp_path / "b.xlsx")
    stamp = pd.Timestamp("2024-03-01 06:30:00")
    workbook(path, {
        "people": [["name", "age", "ok", "seen"], ["Ann", 30, True, stamp], ["Bob", None, False, stamp]],
        "metrics": [["title"], ["Time", "v"], [1, 2.5], [2, 3.5]],
    })
    assert [r.sheet for r in S.sheet_names(spark, path).orderBy("position").collect()] == ["people", "metrics"]
    people = S.load(spark, path)
    assert dict(people.dtypes) == {"name": "string", "age": "bigint", "ok": "boolean", "seen": "timestamp_ntz"}
    assert str(people.first().seen) == "2024-03-01 06:30:00"
    metrics = S.load(spark, path, sheet_name="metrics", row_number=True)
    assert metrics.columns == ["_ord", "Time", "v"]
    assert [tuple(r) for r in metrics.orderBy("_ord").collect()] == [(0, 1, 2.5), (1, 2, 3.5)]
    both = S.load(spark, path, load_all_sheets=True)
    assert list(both) == ["people", "metrics"]
    assert list(S.load(spark, path, sheet_name=["metrics"])) == ["metrics"]
    with pytest.raises(ValueError, match="not found"):
        S.load(spark, path, sheet_name="absent")


def test_many_workbooks_in_one_job(spark, tmp_path, workbook):
    for i in range(3):
        workbook(str(tmp_path / f"b{i}.xlsm"), {"s": [["a"], [i]]})
    cells = S.read_workbook(spark, str(tmp_path))
    assert cells.select("path").distinct().count() == 3 and cells.count() == 6


def test_errors(spark, tmp_path, csv_file):
    with pytest.raises(FileNotFoundError):
        S.load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported"):
        S.load(spark, write(tmp_path, "x.json", "{}"))
    from tabprep.sources.loader import workbook_sheets

    with pytest.raises(ValueError, match="only available for Excel"):
        workbook_sheets(spark, csv_file)


def test_batch(spark, tmp_path, csv_file, workbook):
    book = str(tmp_path / "b.xlsx")
    workbook(book, {"one": [["a"], [1]], "two": [["a"], [2]]})
    absent = str(tmp_path / "absent.xlsx")
    with pytest.raises(ValueError, match="Batch load failed"):
        S.load_batch(spark, [csv_file, absent])
    loaded = S.load_batch(spark, [csv_file, book, absent], sheet_names={book: ["one", "two"]}, skip_errors=True)
    flat = S.flatten_workbooks(loaded)
    assert sorted(flat) == ["b.xlsx_one", "b.xlsx_two", "mixed.csv"]
    stacked = S.stack_tables({k: flat[k] for k in ("b.xlsx_one", "b.xlsx_two")})
    assert sorted(tuple(r) for r in stacked.collect()) == [(1, "b.xlsx_one"), (2, "b.xlsx_two")]


def test_csv_sink(spark, tmp_path, mixed):
    out = str(tmp_path / "out")
    S.write_csv(mixed, out)
    back = spark.read.csv(out, header=True)
    assert back.count() == 100 and "_ord" not in back.columns


def test_csv_line_breaks_in_quotes_and_separator(spark, tmp_path):
    plain = write(tmp_path, "plain.csv", 'name;n\n"x\ny";1\nz;2\n')
    late = write(tmp_path, "late.csv", 'report\n\njour,n\n"x\ny",1\nz,2\n')
    assert sorted(tuple(r) for r in S.load(spark, plain, sep=";").collect()) == [("x\ny", 1), ("z", 2)]
    rows = S.load(spark, late, row_number=True).orderBy("_ord").collect()
    assert [r.jour for r in rows] == ["x\ny", "z"]
