"""The cleaning pipeline as a fitted plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions import scalars as S
from tabprep.functions.types import (
    ORD,
    categorical_columns,
    col,
    name_contains,
    name_has_token,
    nan_to_null,
    numeric_columns,
)
from tabprep.operators import clean as C
from tabprep.operators.columns import standardize_columns, unwanted_columns
from tabprep.operators.joins import drop_duplicates
from tabprep.storage import materialize

# Names of the two modes.
STATIC, FREQUENCY = "statique", "frequence"
MAX_TEXT_LENGTH = 50
URL_SHARE = 0.7


@dataclass
class CleanPlan:
    """Fitted cleaning: every field is a name, a type or a constant, so ``transform`` is stream-safe.

    De-duplication, the date-group filter and block medians depend on neighbouring rows; they are part
    of :func:`clean` and not of the plan.
    """

    datetime_merge: C.DateTimeMerge = field(default_factory=C.DateTimeMerge)
    to_number: list[str] = field(default_factory=list)
    narrow: dict[str, str] = field(default_factory=dict)
    fill: C.Fill = field(default_factory=C.Fill)
    dropped: list[str] = field(default_factory=list)

    def repair(self, df: DataFrame) -> DataFrame:
        """Names, date and time, types."""
        out = self.datetime_merge.transform(standardize_columns(nan_to_null(df)))
        out = C.cast_to_number(out, [n for n in self.to_number if n in out.columns])
        return out.withColumns({n: col(n).cast(t) for n, t in self.narrow.items() if n in out.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fill.transform(self.repair(df)).drop(*self.dropped)


def _fit_repair(df: DataFrame, downcast: bool) -> CleanPlan:
    plan = CleanPlan(datetime_merge=C.fit_datetime_merge(df))
    merged = plan.datetime_merge.transform(df)
    text = [n for n in categorical_columns(merged) if not name_contains(n, C.NO_CONVERSION_PARTS)]
    plan.to_number = C.convertible_columns(merged, text) if text else []
    if downcast:
        plan.narrow = C.narrow_types(C.cast_to_number(merged, plan.to_number))
    return plan


def _fit_static(df: DataFrame, plan: CleanPlan) -> None:
    """Fill values and dropped columns; nothing at all when no value is missing.

    Null counts, text lengths and link counts come from one aggregation.
    """
    names = [n for n in df.columns if n != ORD]
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    flat = [n for n in names if not isinstance(df.schema[n].dataType, nested)]
    text = categorical_columns(df)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.max(F.length(col(n).cast("string"))).alias(f"l{i}") for i, n in enumerate(flat)],
        *[F.count_if(col(n).rlike(S.URL_PATTERN)).alias(f"u{i}") for i, n in enumerate(text)],
    ).first()
    nulls = {n: row[f"m{i}"] for i, n in enumerate(names)}
    if not any(nulls.values()):
        return
    plan.fill = C.fit_static_fill(df, nulls)
    long = {n for i, n in enumerate(flat) if (row[f"l{i}"] or 0) > MAX_TEXT_LENGTH}
    unwanted = set(unwanted_columns(names))
    links = set()
    for i, n in enumerate(text):
        filled = plan.fill.values.get(n)
        total = row["rows"] if filled is not None else row["rows"] - nulls[n]
        hits = row[f"u{i}"] + (nulls[n] if filled is not None and re.search(S.URL_PATTERN, filled) else 0)
        if total and hits / total >= URL_SHARE:
            links.add(n)
    plan.dropped = [n for n in names if n in long | unwanted | links]


def fit_cleaning(df: DataFrame) -> CleanPlan:
    """Fit the static plan on a table that already has normalised names (or gets them here).

    The plan meets other rows, whose values may lie outside the range seen here, so it keeps the wide number types.
    """
    named = standardize_columns(nan_to_null(df))
    plan = _fit_repair(named, downcast=False)
    _fit_static(plan.repair(named), plan)
    return plan


def frequency_measures(df: DataFrame) -> list[str]:
    return [n for n in numeric_columns(df) if not name_has_token(n, C.NO_MEASURE_TOKENS)]


def frequency_date(df: DataFrame) -> str | None:
    return next((n for n in df.columns if n != ORD and name_contains(n, C.FREQUENCY_DATE_PARTS)), None)


def impute_frequency(df: DataFrame, k: int = 8) -> DataFrame | None:
    """Date-group filter, block medians and backup fill; None without a date or a measure."""
    date, measures = frequency_date(df), frequency_measures(df)
    if date is None or not measures:
        return None
    kept = C.drop_empty_date_groups(df, date, measures)
    blocked = C.impute_by_block(kept, k)
    skipped = [n for n in measures if n not in C.block_columns(df)]
    backup = C.Fill(values={n: C.UNKNOWN for n in categorical_columns(blocked)})
    if skipped:
        # Measures that blocks leave out (identifier-like names) get their mean, else 0.
        means = kept.agg(*[F.avg(col(n)).alias(f"a{i}") for i, n in enumerate(skipped)]).first()
        backup.numeric = {n: means[i] if means[i] is not None else 0.0 for i, n in enumerate(skipped)}
        holes = C.null_counts(kept.select(*[col(n) for n in skipped]))
        backup.numeric = {n: v for n, v in backup.numeric.items() if holes[n] > 0}
    return backup.transform(blocked)


def clean(
    df: DataFrame, mode: str = STATIC, k: int = 8, downcast: bool = True, write_stage: bool = True
) -> DataFrame:
    """Full cleaning: duplicates, names, date and time, types, missing values.

    The de-duplicated table is written once to the shared folder (``write_stage``) because several fit
    passes read it; each later pass then reads only its columns.
    """
    if mode not in (STATIC, FREQUENCY):
        raise ValueError(f"Unknown cleaning mode '{mode}'.")
    base = standardize_columns(drop_duplicates(nan_to_null(df)))
    if write_stage:
        base = materialize(base)
    plan = _fit_repair(base, downcast)
    repaired = plan.repair(base)
    if mode == FREQUENCY:
        filled = impute_frequency(repaired, k)
        if filled is not None:
            return filled
    _fit_static(repaired, plan)
    return plan.transform(base)
