"""Building blocks of cleaning: type repair, date and time merging, missing values, null runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions import scalars as S
from tabprep.functions.types import (
    ORD,
    categorical_columns,
    col,
    is_datetime,
    is_floating,
    is_numeric,
    name_contains,
    name_has_token,
    numeric_columns,
)
from tabprep.operators import ordering
from tabprep.operators.aggregates import column_modes
from tabprep.operators.filters import has_measurement
from tabprep.operators.ordering import group_quantiles, quantiles, split_ranges, with_row_number

# Name parts and tokens that steer cleaning.
DATE_WORDS = ("date", "datetime", "timestamp", "jour", "journee")
TIME_WORDS = ("heure", "hour", "time")
NO_CONVERSION_PARTS = ("heure", "date", "time", "day", "month", "year", "ligne", "poste", "labo")
FREQUENCY_DATE_PARTS = ("date", "timestamp")
NO_MEASURE_TOKENS = (
    "heure", "hour", "time", "date", "timestamp", "poste", "shift", "team", "station", "lab", "mois", "semaine",
)
NO_IMPUTE_TOKENS = (*NO_MEASURE_TOKENS, "id", "rank", "index")
MISSING_VALUE_STRATEGIES = (
    "drop_rows", "drop_columns", "fill_mean", "fill_median", "fill_mode", "fill_zero", "interpolate",
)
# Shares that decide about a type change.
LOAD_NUMERIC_SHARE = 0.7
CLEAN_NUMERIC_SHARE = 0.8
TEXT_LIKE_SHARE = 0.5
SAMPLED_VALUES = 10
EXPONENT_PATTERN = r"^\d+[eE][+-]?\d+$"
UNKNOWN = "Unknown"

# Up to this block length the median is taken inside one window partition.
BLOCK_IN_MEMORY = 1_000_000


# --- type repair -------------------------------------------------------------------------------


def number_like_columns(df: DataFrame, share: float = LOAD_NUMERIC_SHARE) -> list[str]:
    """Text columns in which more than ``share`` of the non-null values are number-like (one aggregation)."""
    names = categorical_columns(df)
    if not names:
        return []
    hits = [F.avg(S.full_match(col(n), S.NUMBER_LIKE_PATTERN).cast("double")).alias(f"s{i}") for i, n in enumerate(names)]
    row = df.agg(*hits).first()
    return [n for i, n in enumerate(names) if row[i] is not None and row[i] > share]


def cast_to_number(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: S.to_number(col(n)) for n in names})


def promote_numeric_text(df: DataFrame, share: float = LOAD_NUMERIC_SHARE) -> DataFrame:
    """Turn mostly number-like text columns into DOUBLE; the other values become null."""
    return cast_to_number(df, number_like_columns(df, share))


def convertible_columns(
    df: DataFrame, columns: Iterable[str] | None = None, threshold: float = CLEAN_NUMERIC_SHARE, order_by: str = ORD
) -> list[str]:
    """Text columns that are numbers in disguise.

    Not when more than half of the first ten distinct values hold letters, not when fewer than
    ``threshold`` of the values convert. Without a row order the smallest distinct values are looked at.
    """
    names = list(categorical_columns(df) if columns is None else columns)
    if not names:
        return []
    row = df.agg(
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count(S.to_number(col(n))).alias(f"k{i}") for i, n in enumerate(names)],
    ).first()
    able = [n for i, n in enumerate(names) if row[f"n{i}"] > 0 and row[f"k{i}"] / row[f"n{i}"] >= threshold]
    if not able:
        return []
    order = col(order_by).cast("long") if order_by in df.columns else F.lit(0).cast("long")
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), col(n).alias("v")) for i, n in enumerate(able)])
    seen = (
        df.select(order.alias("o"), F.explode(pairs).alias("p"))
        .filter(F.col("p.v").isNotNull())
        .groupBy("p.i", "p.v")
        .agg(F.min("o").alias("o"))
    )
    rank = F.row_number().over(Window.partitionBy("i").orderBy("o", "v"))
    head = seen.withColumn("rank", rank).filter(F.col("rank") <= SAMPLED_VALUES)
    text = F.trim("v")
    lettered = text.rlike("[a-zA-Z]") & ~text.rlike(EXPONENT_PATTERN)
    share = head.groupBy("i").agg(F.avg(lettered.cast("double")).alias("s"))
    wordy = {r.i for r in share.filter(F.col("s") > TEXT_LIKE_SHARE).collect()}
    return [n for i, n in enumerate(able) if i not in wordy]


def narrow_types(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Smallest type of each LONG and DOUBLE column by its range (one aggregation)."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    wide = [n for n in chosen if isinstance(df.schema[n].dataType, (T.LongType, T.DoubleType))]
    if not wide:
        return {}
    row = df.agg(*[x for i, n in enumerate(wide) for x in (F.min(col(n)).alias(f"a{i}"), F.max(col(n)).alias(f"b{i}"))]).first()
    out = {}
    for i, n in enumerate(wide):
        low, high = row[f"a{i}"], row[f"b{i}"]
        if low is None:
            continue
        if isinstance(df.schema[n].dataType, T.DoubleType):
            limit = 3.4028234663852886e38
            if -limit <= low and high <= limit:
                out[n] = "float"
            continue
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(2**bits) <= low and high < 2**bits:
                out[n] = kind
                break
    return out


def optimize_types(df: DataFrame, downcast: bool = True, order_by: str = ORD) -> DataFrame:
    """Convert number-like text columns, then narrow numeric columns by their range."""
    text = [n for n in categorical_columns(df) if not name_contains(n, NO_CONVERSION_PARTS)]
    out = cast_to_number(df, convertible_columns(df, text, order_by=order_by))
    if not downcast:
        return out
    return out.withColumns({n: col(n).cast(t) for n, t in narrow_types(out).items()})


# --- date and time -----------------------------------------------------------------------------


@dataclass
class DateTimeMerge:
    """Which columns hold the date and the time of day."""

    date: str | None = None
    time: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.date is None or self.date not in df.columns:
            return df
        stamp = S.to_timestamp(col(self.date), df.schema[self.date].dataType)
        if self.time is None or self.time not in df.columns:
            return df.withColumn(self.date, stamp)
        joined = S.combine_date_time(stamp, S.parse_time(col(self.time)))
        return df.withColumn("date_time", joined).drop(*[n for n in (self.date, self.time) if n != "date_time"])


def fit_datetime_merge(
    df: DataFrame, date_words: Iterable[str] = DATE_WORDS, time_words: Iterable[str] = TIME_WORDS
) -> DateTimeMerge:
    """The first date-named column with a readable value, and the first other time-named column."""
    named = [n for n in df.columns if n != ORD and name_contains(n, date_words)]
    candidates = [n for n in named if is_datetime(df, n) or isinstance(df.schema[n].dataType, T.StringType)]
    if not candidates:
        return DateTimeMerge()
    row = df.agg(
        *[F.count(S.to_timestamp(col(n), df.schema[n].dataType)).alias(f"c{i}") for i, n in enumerate(candidates)]
    ).first()
    date = next((n for i, n in enumerate(candidates) if row[i] > 0), None)
    if date is None:
        return DateTimeMerge()
    time = next((n for n in df.columns if n not in (date, ORD) and name_contains(n, time_words)), None)
    return DateTimeMerge(date, time)


def merge_date_and_time(df: DataFrame) -> DataFrame:
    """Replace a date column and a time column by one ``date_time`` timestamp."""
    return fit_datetime_merge(df).transform(df)


# --- missing values ----------------------------------------------------------------------------


@dataclass
class Fill:
    """Constant that replaces the nulls of each column."""

    values: dict[str, object] = field(default_factory=dict)
    numeric: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for n, v in self.numeric.items():
            if n in df.columns:
                kind = "double" if not is_floating(df, n) else df.schema[n].dataType.simpleString()
                out[n] = F.coalesce(col(n).cast(kind), F.lit(float(v)).cast(kind))
        for n, v in self.values.items():
            if n in df.columns:
                out[n] = F.coalesce(col(n), F.lit(v).cast(df.schema[n].dataType))
        return df.withColumns(out)


def null_counts(df: DataFrame) -> dict[str, int]:
    names = [n for n in df.columns if n != ORD]
    if not names:
        return {}
    row = df.agg(*[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def fit_static_fill(df: DataFrame, nulls: dict[str, int] | None = None) -> Fill:
    """Numeric columns: mean. Others: most frequent value, else ``Unknown``. Only columns with nulls."""
    nulls = null_counts(df) if nulls is None else nulls
    holed = [n for n, k in nulls.items() if k > 0]
    numbers = [n for n in holed if is_numeric(df, n)]
    plain = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    others = [n for n in holed if isinstance(df.schema[n].dataType, plain)]
    fill = Fill()
    if numbers:
        row = df.agg(*[F.avg(col(n)).alias(f"a{i}") for i, n in enumerate(numbers)]).first()
        fill.numeric = {n: float(row[i]) for i, n in enumerate(numbers) if row[i] is not None}
    if others:
        modes = {r["column"]: r["mode"] for r in column_modes(df, others).collect()}
        for n in others:
            if n in modes:
                fill.values[n] = modes[n]
            elif isinstance(df.schema[n].dataType, T.StringType):
                fill.values[n] = UNKNOWN
    return fill


def impute_static(df: DataFrame) -> DataFrame:
    return fit_static_fill(df).transform(df)


def drop_empty_date_groups(df: DataFrame, date: str, measures: list[str]) -> DataFrame:
    """Keep the rows of dates with at least one non-null, non-zero measure; rows without a date go.

    The kept dates are found first and joined back as a semi join, so the rows of one date never have
    to sit in one task.
    """
    kept = df.filter(has_measurement(measures)).select(col(date)).distinct()
    return df.join(kept, date, "left_semi")


def block_columns(df: DataFrame) -> list[str]:
    return [n for n in numeric_columns(df) if not name_has_token(n, NO_IMPUTE_TOKENS)]


def impute_by_block(
    df: DataFrame, k: int = 8, columns: Iterable[str] | None = None, order_by: str = ORD
) -> DataFrame:
    """Fill nulls with the median of the block of ``k`` consecutive row numbers, else with 0."""
    if k < 1:
        raise ValueError("The block length must be at least 1 row")
    names = list(columns) if columns is not None else block_columns(df)
    if not names:
        return df
    block = F.expr(f"`{order_by}` div {int(k)}")

    def filled(n: str, median: Column) -> Column:
        kind = df.schema[n].dataType.simpleString()
        kind = kind if kind in ("float", "double") else "double"
        return F.coalesce(col(n).cast(kind), median.cast(kind), F.lit(0).cast(kind))

    if k <= BLOCK_IN_MEMORY:
        window = Window.partitionBy(block)
        return df.withColumns({n: filled(n, F.median(col(n)).over(window)) for n in names})
    out = df.withColumn("_block", block)
    for i, n in enumerate(names):
        medians = group_quantiles(out, n, "_block", {f"_m{i}": 0.5})
        out = out.join(medians, "_block", "left")
    filled_columns = {n: filled(n, F.col(f"_m{i}")) for i, n in enumerate(names)}
    return out.withColumns(filled_columns).select(*[col(n) for n in df.columns])


def handle_missing(df: DataFrame, strategy: str, order_by: str = ORD) -> DataFrame:
    """Apply one of :data:`MISSING_VALUE_STRATEGIES` to the whole table."""
    if strategy not in MISSING_VALUE_STRATEGIES:
        raise ValueError(f"Unknown strategy '{strategy}'. Expected one of {list(MISSING_VALUE_STRATEGIES)}.")
    names = [n for n in df.columns if n not in (ORD, order_by)]
    numbers = numeric_columns(df, exclude=[order_by])
    if strategy == "drop_rows":
        return df.na.drop(subset=names)
    if strategy == "drop_columns":
        nulls = null_counts(df)
        return df.drop(*[n for n in names if nulls.get(n, 0) > 0])
    if strategy == "fill_zero":
        return df.withColumns({n: F.coalesce(col(n), F.lit(0).cast(df.schema[n].dataType)) for n in numbers})
    if strategy == "fill_mean":
        row = df.agg(*[F.avg(col(n)).alias(f"a{i}") for i, n in enumerate(numbers)]).first()
        return Fill(numeric={n: row[i] for i, n in enumerate(numbers) if row[i] is not None}).transform(df)
    if strategy == "fill_median":
        middle = quantiles(df, numbers, [0.5])
        return Fill(numeric={n: v[0] for n, v in middle.items() if v[0] is not None}).transform(df)
    if strategy == "fill_mode":
        modes = {r["column"]: r["mode"] for r in column_modes(df, names).collect()}
        return Fill(values=modes).transform(df)
    return interpolate_linear(df, numbers, order_by)


def interpolate_linear(df: DataFrame, columns: Iterable[str], order_by: str = ORD) -> DataFrame:
    """Linear interpolation along the row order; leading nulls stay, trailing ones repeat the last value.

    Windows run inside ranges of the order column. The last and next value of each range come from one
    small summary row per range.
    """
    names = list(columns)
    if not names:
        return df
    ranged, ranges = split_ranges(df, order_by)
    before = Window.partitionBy("_range").orderBy(col(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    # The next value is the last one seen from the other end: a running frame, not one frame per row.
    after = Window.partitionBy("_range").orderBy(col(order_by).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def point(n: str) -> Column:
        return F.when(col(n).isNotNull(), F.struct(col(order_by).cast("double").alias("x"), col(n).cast("double").alias("y")))

    staged = ranged
    if ranges > 1:
        edges = ranged.groupBy("_range").agg(
            *[F.max_by(point(n), F.when(col(n).isNotNull(), col(order_by))).alias(f"_last{i}") for i, n in enumerate(names)],
            *[F.min_by(point(n), F.when(col(n).isNotNull(), col(order_by))).alias(f"_first{i}") for i, n in enumerate(names)],
        )
        # At most one row per range.
        edge = Window.partitionBy(F.lit(0))
        earlier = edge.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        later = edge.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(
            "_range",
            *[F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_pl{i}") for i in range(len(names))],
            *[F.last(f"_first{i}", ignorenulls=True).over(later).alias(f"_nf{i}") for i in range(len(names))],
        )
        staged = ranged.join(F.broadcast(edges), "_range", "left")
    out = []
    for i, n in enumerate(names):
        low = F.last(point(n), ignorenulls=True).over(before)
        high = F.last(point(n), ignorenulls=True).over(after)
        if ranges > 1:
            low, high = F.coalesce(low, F.col(f"_pl{i}")), F.coalesce(high, F.col(f"_nf{i}"))
        out += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    placed = staged.select(*[col(n) for n in df.columns], *out)
    x = col(order_by).cast("double")

    def value(i: int, n: str) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        slope = (hi["y"] - lo["y"]) / (hi["x"] - lo["x"])
        between = lo["y"] + slope * (x - lo["x"])
        return (
            F.when(col(n).isNotNull(), col(n).cast("double"))
            .when(lo.isNull(), F.lit(None).cast("double"))
            .when(hi.isNull(), lo["y"])
            .otherwise(between)
        )

    wanted = {n: i for i, n in enumerate(names)}
    return placed.select(*[value(wanted[n], n).alias(n) if n in wanted else col(n) for n in df.columns])


def null_runs(df: DataFrame, columns: Iterable[str] | None = None, order_by: str = ORD) -> DataFrame:
    """Per numeric column: nulls, null runs, longest run, first and last valid row number.

    ``order_by`` holds row numbers. One shuffle of null flags serves all columns: inside a range of row numbers a run is
    the gap between neighbouring valid rows, and a range is summed up by its rows, runs and the places of its first and
    last valid row. Gaps across ranges come from these summaries, one row per range and column. Rows without a row
    number are left out.
    """
    names = list(columns) if columns is not None else numeric_columns(df, exclude=[order_by])
    if not names:
        return df.sparkSession.createDataFrame([], "column string, null_count long, null_runs long, longest_run long, first_valid long, last_valid long")
    flags = df.filter(col(order_by).isNotNull()).select(
        col(order_by).alias("_o"), F.floor(col(order_by) / F.lit(ordering.ROWS_PER_RANGE)).alias("_r"),
        *[col(n).isNotNull().alias(f"_v{i}") for i, n in enumerate(names)],
    )
    inside = Window.partitionBy("_r").orderBy("_o")
    placed = flags.withColumn("_p", F.row_number().over(inside).cast("long"))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    at = [F.when(F.col(f"_v{i}"), F.col("_p")) for i in range(len(names))]
    placed = placed.select("*", *[(p - F.last(p, ignorenulls=True).over(earlier) - 1).alias(f"_g{i}") for i, p in enumerate(at)])
    valid = [F.when(F.col(f"_v{i}"), F.col("_o")) for i in range(len(names))]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (p, o) in enumerate(zip(at, valid, strict=True)):
        aggs += [
            F.count(p).alias(f"c{i}"), F.min(p).alias(f"a{i}"), F.max(p).alias(f"b{i}"), F.min(o).alias(f"f{i}"), F.max(o).alias(f"l{i}"),
            F.coalesce(F.max(f"_g{i}"), F.lit(0)).alias(f"g{i}"), F.count_if(F.col(f"_g{i}") > 0).alias(f"r{i}"),
        ]
    ranges = placed.groupBy("_r").agg(*aggs)
    fields = {"c": "valid", "a": "first", "b": "last", "f": "first_valid", "l": "last_valid", "g": "gap", "r": "runs"}
    parts = [F.struct(F.lit(n).alias("column"), *[F.col(f"{k}{i}").alias(v) for k, v in fields.items()]) for i, n in enumerate(names)]
    along = Window.partitionBy("column").orderBy("_r")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.select("_r", "rows", F.explode(F.array(*parts)).alias("s")).select("_r", "rows", "s.*")
    summed = summed.withColumn("_off", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    summed = summed.withColumns({"first": F.col("first") + F.col("_off"), "last": F.col("last") + F.col("_off")})
    summed = summed.withColumn("lead", F.col("first") - F.coalesce(F.max("last").over(before), F.lit(0)) - 1)
    tail = F.sum("rows") - F.coalesce(F.max("last"), F.lit(0))
    return summed.groupBy("column").agg(
        (F.sum("rows") - F.sum("valid")).alias("null_count"),
        (F.sum("runs") + F.count_if(F.col("lead") > 0) + (tail > 0).cast("long")).alias("null_runs"),
        F.greatest(F.max("gap"), F.coalesce(F.max("lead"), F.lit(0)), tail).alias("longest_run"),
        F.min("first_valid").alias("first_valid"), F.max("last_valid").alias("last_valid"),
    )
