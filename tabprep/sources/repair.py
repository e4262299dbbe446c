"""Header detection and type inference shared by the readers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions import scalars as S
from tabprep.functions.types import categorical_columns, col
from tabprep.operators.clean import LOAD_NUMERIC_SHARE

# Words that mark a header row.
HEADER_WORDS = (
    "date", "timestamp", "datetime", "time", "jour", "journee", "annee", "year", "mois", "month", "semaine", "week",
)
HEADER_SEARCH_ROWS = 20
# Texts that stand for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER_PATTERN = r"^[-+]?\d{1,18}$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"


def keyword_rows(rows: Sequence[Sequence[object]], words: Iterable[str] = HEADER_WORDS) -> list[int]:
    """Positions of the rows in which any cell holds one of the words."""
    lowered = [w.lower() for w in words]
    return [i for i, row in enumerate(rows) if any(w in str(cell).lower() for cell in row for w in lowered)]


def header_position(first_rows: Sequence[Sequence[object]], detect: bool = True) -> int:
    """Row number of the header among the first rows of a file.

    The first row is the header unless one of the next 20 rows holds a header word; then that row is.
    """
    if not detect:
        return 0
    hits = keyword_rows(first_rows[1 : 1 + HEADER_SEARCH_ROWS])
    return hits[0] + 1 if hits else 0


def present(text: Column) -> Column:
    """The trimmed text, or NULL for a missing-value text."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(*MISSING_TEXTS), trimmed)


def infer_types(df: DataFrame, share: float = LOAD_NUMERIC_SHARE) -> DataFrame:
    """Types of text columns from one aggregation over all values.

    All values integers -> LONG, all numbers -> DOUBLE, all true/false -> BOOLEAN, all ISO timestamps ->
    TIMESTAMP; more than ``share`` number-like -> DOUBLE with the rest null; anything else stays text.
    """
    names = categorical_columns(df)
    if not names:
        return df
    tests = {
        "n": lambda c: F.count(c),
        "i": lambda c: F.count_if(c.rlike(INTEGER_PATTERN)),
        "d": lambda c: F.count(S.to_number(c)),
        "b": lambda c: F.count_if(F.lower(c).isin("true", "false")),
        "t": lambda c: F.count_if(c.rlike(ISO_PATTERN)),
        "l": lambda c: F.count_if(S.full_match(c, S.NUMBER_LIKE_PATTERN)),
    }
    row = df.agg(*[make(col(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, make in tests.items()]).first()
    casts = {}
    for i, n in enumerate(names):
        total, ints, numbers, bools, stamps, like = (row[f"{k}{i}"] for k in tests)
        if total == 0:
            continue
        if ints == total:
            casts[n] = col(n).try_cast("bigint")
        elif numbers == total:
            casts[n] = S.to_number(col(n))
        elif bools == total:
            casts[n] = col(n).try_cast("boolean")
        elif stamps == total:
            casts[n] = col(n).try_cast("timestamp_ntz")
        elif like / total > share:
            casts[n] = S.to_number(col(n))
    return df.withColumns(casts)


def usable_names(cells: Sequence[object]) -> list[str | None]:
    """Header texts; None for a column without a header."""
    out: list[str | None] = []
    taken: set[str] = set()
    for cell in cells:
        name = "" if cell is None else str(cell).strip()
        if not name or "unnamed" in name.lower():
            out.append(None)
            continue
        candidate, k = name, 0
        while candidate in taken:
            k += 1
            candidate = f"{name}.{k}"
        taken.add(candidate)
        out.append(candidate)
    return out
