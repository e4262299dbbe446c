"""Column naming, renaming and removal."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.scalars import URL_PATTERN
from tabprep.functions.types import ORD, as_list, categorical_columns, col, name_contains

# Characters that become "_" and characters that vanish.
TO_UNDERSCORE = " /\\"
REMOVED = ".%()[]"
# Names that hold one of these are dropped by static cleaning.
UNWANTED_NAME_PARTS = ("id", "temp", "test", "unnamed", "runtime", "rank", "plateform")

_NAME_TABLE = str.maketrans(TO_UNDERSCORE, "_" * len(TO_UNDERSCORE), REMOVED)


def normalize_name(name: object) -> str:
    """Lower-case name with single underscores."""
    words = str(name).strip().lower().translate(_NAME_TABLE).split("_")
    return "_".join(w for w in words if w)


def unique_names(names: Iterable[str]) -> list[str]:
    """Give later copies of a name the suffix ``_2``, ``_3``, ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        candidate, k = name, 1
        while candidate in taken:
            k += 1
            candidate = f"{name}_{k}"
        taken.add(candidate)
        out.append(candidate)
    return out


def standardize_columns(df: DataFrame) -> DataFrame:
    """Normalise all names; the row identity column keeps its own."""
    names = [n if n == ORD else normalize_name(n) for n in df.columns]
    return df.toDF(*unique_names(names))


def parse_rename_rules(text: str) -> dict[str, str]:
    """Lines ``old:new`` to a mapping; lines without both parts are skipped."""
    pairs = (line.partition(":") for line in text.splitlines())
    named = ((old.strip(), new.strip()) for old, sep, new in pairs if sep)
    return {old: new for old, new in named if old and new}


def rename_columns(df: DataFrame, rules: str | Mapping[str, str]) -> DataFrame:
    mapping = parse_rename_rules(rules) if isinstance(rules, str) else dict(rules)
    return df.withColumnsRenamed({o: n for o, n in mapping.items() if o in df.columns})


def drop_columns(df: DataFrame, names: str | Iterable[str] | None) -> DataFrame:
    present = [n for n in as_list(names) if n in df.columns]
    return df.drop(*present)


def _scalar_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f.name for f in df.schema.fields if f.name != ORD and not isinstance(f.dataType, nested)]


def long_text_columns(df: DataFrame, max_length: int = 50) -> list[str]:
    """Columns whose longest text form is above ``max_length`` (one aggregation)."""
    names = _scalar_columns(df)
    if not names:
        return []
    row = df.agg(*[F.max(F.length(col(n).cast("string"))).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if (row[i] or 0) > max_length]


def drop_long_text_columns(df: DataFrame, max_length: int = 50) -> DataFrame:
    return df.drop(*long_text_columns(df, max_length))


def unwanted_columns(names: Iterable[str], parts: Iterable[str] = UNWANTED_NAME_PARTS) -> list[str]:
    return [n for n in names if n != ORD and name_contains(n, parts)]


def drop_unwanted_columns(df: DataFrame, parts: Iterable[str] = UNWANTED_NAME_PARTS) -> DataFrame:
    return df.drop(*unwanted_columns(df.columns, parts))


def url_columns(df: DataFrame, threshold: float = 0.7) -> list[str]:
    """Text columns in which at least ``threshold`` of the non-null values hold a link."""
    names = categorical_columns(df)
    if not names:
        return []
    share = [F.avg(col(n).rlike(URL_PATTERN).cast("double")).alias(f"u{i}") for i, n in enumerate(names)]
    row = df.agg(*share).first()
    return [n for i, n in enumerate(names) if row[i] is not None and row[i] >= threshold]


def drop_url_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.drop(*url_columns(df, threshold))


def drop_unnamed_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a header (``_c0``-style names or names holding ``unnamed``)."""
    def headless(n: str) -> bool:
        return "unnamed" in n.lower() or (n.startswith("_c") and n[2:].isdigit())

    return df.drop(*[n for n in df.columns if headless(n)])
