"""Category encoding."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions import scalars as S
from tabprep.functions.types import (
    ORD,
    boolean_columns,
    categorical_columns,
    col,
    numeric_columns,
)
from tabprep.operators.aggregates import MAX_LEVELS, value_frequencies, value_keys
from tabprep.operators.columns import standardize_columns
from tabprep.operators.filters import filter_exact_zero_rows
from tabprep.operators.ordering import with_row_number
from tabprep.operators.sparse import BROADCAST_BYTES, SparseEncoding, fit_sparse_encoding
from tabprep.storage import materialize

# Encoding thresholds, and the library defaults of smoothed target encoding.
HIGH_CARDINALITY = 10
DROP_RATIO = 0.9
MIN_SAMPLES_LEAF = 20
SMOOTHING = 10.0
STRATEGIES = ("smart", "one_hot", "label", "none")
UNKNOWN_LEVEL = "Unknown"
MISSING_LEVEL = "missing_value"
# The vector column of the levels that are too many for a column each.
SPARSE_COLUMN = "one_hot"

# A fitted level table up to this many bytes is kept in the plan; a larger one is written to the shared folder. One
# above BROADCAST_BYTES is joined by shuffle. A level counts as its text and ROW_BYTES.
INLINE_BYTES = 1 << 20
ROW_BYTES = 16


def level_statistics(df: DataFrame, columns: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Distinct values and non-null rows per column, from one count of all values."""
    names = list(columns)
    if not names:
        return {}
    rows = (
        value_keys(df, names)
        .filter(F.col("key").isNotNull())
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"))
        .collect()
    )
    found = {r["column"]: (r["u"], r["n"]) for r in rows}
    return {n: found.get(n, (0, 0)) for n in names}


def levels_by_column(df: DataFrame, columns: Iterable[str], cap: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted levels of several columns in one job; each column is checked against ``cap`` first."""
    names = list(columns)
    if not names:
        return {}
    wide = [n for n, (u, _) in level_statistics(df, names).items() if u > cap]
    if wide:
        raise ValueError(f"Columns {wide} have more than {cap} levels; use one_hot_sparse, target or label encoding for them.")
    rows = value_frequencies(df, names).filter(F.col("value").isNotNull()).select("column", "value").collect()
    out: dict[str, list[str]] = {n: [] for n in names}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {n: sorted(v) for n, v in out.items()}


def one_hot_columns(df: DataFrame, column: str, levels: Iterable[str]) -> dict:
    """0/1 expressions named ``column_level``; null gives 0 everywhere."""
    return {
        f"{column}_{v}": F.coalesce((col(column) == F.lit(v)).cast("int"), F.lit(0))
        for v in levels
        if f"{column}_{v}" not in df.columns
    }


def booleans_to_int(df: DataFrame) -> DataFrame:
    return df.withColumns({n: S.bool_to_int(col(n)) for n in boolean_columns(df)})


def one_hot_encode(df: DataFrame, columns: Iterable[str] | None = None, cap: int = MAX_LEVELS) -> DataFrame:
    names = list(columns) if columns is not None else categorical_columns(df)
    out = df
    for n, levels in levels_by_column(df, names, cap).items():
        out = out.withColumns(one_hot_columns(out, n, levels))
    return booleans_to_int(out.drop(*names))


def lookup(df: DataFrame, table: DataFrame, column: str, size: int) -> DataFrame:
    """Left join with a level table of at most ``size`` bytes: broadcast when that is small, else a shuffle join."""
    return df.join(F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("shuffle_merge"), column, "left")


def freeze(table: DataFrame, size: int) -> DataFrame:
    """Fix fitted state of at most ``size`` bytes so that later uses do not repeat the fit."""
    if size > INLINE_BYTES:
        return materialize(table)
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def label_levels(df: DataFrame, column: str, null_level: str = UNKNOWN_LEVEL) -> DataFrame:
    """(level, code): sorted levels numbered from 0; nulls count as ``null_level``."""
    distinct = df.select(F.coalesce(col(column).cast("string"), F.lit(null_level)).alias("level")).distinct()
    return with_row_number(distinct, "level", "code")


def level_tables(
    df: DataFrame, columns: Iterable[str], null_level: str = UNKNOWN_LEVEL
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(level, code) table and its size in bytes for several columns.

    Columns with few bytes of levels are read in one job and numbered at once; larger ones are numbered by Spark.
    """
    names = list(columns)
    if not names:
        return {}, {}
    freq = value_frequencies(df, names).select("column", F.coalesce("value", F.lit(null_level)).alias("level"))
    counted = freq.distinct()
    sizes = {n: 0 for n in names}
    sizes.update({r["column"]: r["n"] for r in counted.groupBy("column").agg(F.sum(F.octet_length("level") + ROW_BYTES).alias("n")).collect()})
    few = [n for n in names if sizes[n] <= INLINE_BYTES]
    found: dict[str, list[str]] = {n: [] for n in few}
    for r in counted.filter(F.col("column").isin(few)).collect() if few else []:
        found[r["column"]].append(r["level"])
    tables = {}
    for n in names:
        if n in found:
            rows = list(enumerate(sorted(found[n])))
            tables[n] = df.sparkSession.createDataFrame([(v, i) for i, v in rows], "level string, code long")
        else:
            tables[n] = materialize(label_levels(df, n, null_level))
    return tables, sizes


def label_encode(df: DataFrame, columns: Iterable[str] | None = None, null_level: str = UNKNOWN_LEVEL) -> DataFrame:
    """Replace each text column by the position of its value among the sorted levels."""
    names = list(columns) if columns is not None else categorical_columns(df)
    tables, sizes = level_tables(df, names, null_level)
    out = df
    for n in names:
        table = tables[n].withColumnRenamed("level", "_level")
        keyed = out.withColumn("_level", F.coalesce(col(n).cast("string"), F.lit(null_level)))
        joined = lookup(keyed, table, "_level", sizes[n])
        out = joined.withColumn(n, F.col("code")).select(*[col(c) for c in out.columns])
    return booleans_to_int(out)


# --- target encoding ---------------------------------------------------------------------------


@dataclass
class TargetEncoding:
    """Fitted smoothed means: one small table (level, value) per column, and the prior."""

    prior: float
    tables: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the columns by their encoded values; unknown and missing levels get the prior."""
        out = df
        for n, table in self.tables.items():
            if n not in out.columns:
                out = out.withColumn(n, F.lit(self.prior))
                continue
            names = out.columns
            keyed = table.select(F.col("level").alias("_level"), F.col("value").alias("_value"))
            joined = lookup(out.withColumn("_level", col(n)), keyed, "_level", self.sizes[n])
            out = joined.withColumn(n, F.coalesce("_value", F.lit(self.prior))).select(*[col(c) for c in names])
        return out

    def state(self) -> DataFrame:
        """(column, level, value) of all columns, with the prior as the row without a level."""
        parts = [t.select(F.lit(n).alias("column"), "level", "value") for n, t in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        prior = out.sparkSession.range(len(self.tables)).select(
            F.get(F.array(*[F.lit(n) for n in self.tables]), F.col("id").cast("int")).alias("column"),
            F.lit(None).cast("string").alias("level"),
            F.lit(self.prior).alias("value"),
        )
        return out.unionByName(prior)

    def save(self, path: str) -> None:
        self.state().write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> TargetEncoding:
        state = spark.read.parquet(path)
        heads = state.filter(F.col("level").isNull()).collect()
        size = F.coalesce(F.sum(F.octet_length("level") + ROW_BYTES), F.lit(0)).alias("n")
        sizes = {r["column"]: r["n"] for r in state.groupBy("column").agg(size).collect()}
        tables = {
            r["column"]: state.filter((F.col("column") == r["column"]) & F.col("level").isNotNull()).select("level", "value")
            for r in heads
        }
        return cls(heads[0]["value"], tables, sizes)


def target_means(df: DataFrame, column: str, target: str, prior: float) -> DataFrame:
    """(level, value): smoothed target mean per level.

    value = prior * (1 - s) + mean * s with s = 1 / (1 + exp(-(n - m) / f)); a level seen once gets the prior.
    """
    y = F.coalesce(col(target).cast("double"), F.lit(prior))
    grouped = (
        df.filter(col(column).isNotNull())
        .groupBy(col(column).cast("string").alias("level"))
        .agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))
    )
    s = 1 / (1 + F.exp(-(F.col("n") - MIN_SAMPLES_LEAF) / F.lit(SMOOTHING)))
    value = F.when(F.col("n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - s) + F.col("mean") * s)
    return grouped.select("level", value.alias("value"))


def fit_target_encoding(df: DataFrame, target: str, columns: Iterable[str], levels: dict | None = None) -> TargetEncoding:
    """``levels``: number of levels of each column, where it is known. With the longest text it bounds the tables."""
    names = list(columns)
    longest = [F.coalesce(F.max(F.octet_length(col(n).cast("string"))), F.lit(0)) for n in names]
    prior, *longest = df.agg(F.avg(col(target).cast("double")), *longest).first()
    if prior is None:
        raise ValueError(f"Target column '{target}' has no values.")
    known = levels or {n: u for n, (u, _) in level_statistics(df, names).items()}
    sizes = {n: known[n] * (most + ROW_BYTES) for n, most in zip(names, longest, strict=True)}
    return TargetEncoding(prior, {n: freeze(target_means(df, n, target, prior), sizes[n]) for n in names}, sizes)


def fit_target_encoder(
    df: DataFrame, target: str, high_cardinality: int = HIGH_CARDINALITY, drop_ratio: float = DROP_RATIO
) -> TargetEncoding | None:
    """Reusable encoder of the columns with many, but not nearly unique, levels; None when there is none."""
    named = standardize_columns(df)
    if target not in named.columns:
        raise ValueError(f"Target column '{target}' not found in dataframe.")
    stats = level_statistics(named, [n for n in categorical_columns(named) if n != target])
    chosen = {n: u for n, (u, k) in stats.items() if u > high_cardinality and u / k <= drop_ratio}
    return fit_target_encoding(named, target, chosen, chosen) if chosen else None


# --- smart encoding ----------------------------------------------------------------------------


@dataclass
class EncodingPlan:
    """What happens to each text column, decided once."""

    dropped: list[str] = field(default_factory=list)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    target: TargetEncoding | None = None
    target_column: str | None = None
    sparse: SparseEncoding | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        out = standardize_columns(df)
        if self.sparse is not None:
            out = self.sparse.with_vector(out, SPARSE_COLUMN).drop(*self.sparse.text)
        if self.target is not None and self.target_column in out.columns:
            y = col(self.target_column)
            out = out.withColumn(self.target_column, F.coalesce(y.cast("double"), F.lit(self.target.prior)))
        if self.target is not None:
            out = self.target.transform(out)
        for n, levels in self.one_hot.items():
            if n in out.columns:
                out = out.withColumns(one_hot_columns(out, n, levels))
        return booleans_to_int(out.drop(*self.dropped, *self.one_hot))


def fit_smart_encoding(
    df: DataFrame,
    target: str | None = None,
    high_cardinality: int = HIGH_CARDINALITY,
    drop_ratio: float = DROP_RATIO,
    cap: int = MAX_LEVELS,
) -> EncodingPlan:
    """Nearly unique columns are dropped, few levels become 0/1 columns, many levels become target
    means (0/1 columns when there is no target). Columns with more than ``cap`` levels, which would be as many columns,
    share one sparse vector column ``one_hot``."""
    named = standardize_columns(df)
    plan = EncodingPlan()
    stats = level_statistics(named, categorical_columns(named))
    has_target = target is not None and target in named.columns
    means: dict[str, int] = {}
    spread = []
    for n, (unique, present) in stats.items():
        if present and unique / present > drop_ratio:
            plan.dropped.append(n)
        elif unique > high_cardinality and has_target:
            means[n] = unique
        else:
            spread.append(n)
    wide = [n for n in spread if stats[n][0] > cap]
    plan.one_hot = levels_by_column(named, [n for n in spread if n not in wide], cap)
    if wide:
        plan.sparse = fit_sparse_encoding(named, wide)
    if means:
        plan.target = fit_target_encoding(named, target, means, means)
        plan.target_column = target
    return plan


def smart_encode(df: DataFrame, target: str | None = None, **options) -> DataFrame:
    plan = fit_smart_encoding(df, target, **options)
    out = plan.transform(df)
    if target is not None and plan.target is None and target in numeric_columns(out):
        mean = out.agg(F.avg(col(target))).first()[0]
        if mean is not None:
            out = out.withColumn(target, F.coalesce(col(target).cast("double"), F.lit(mean)))
    return out


def encode(df: DataFrame, strategy: str = "smart", target: str | None = None) -> DataFrame:
    """Apply one strategy after removing rows whose numbers are all exactly 0."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy '{strategy}'. Expected one of {list(STRATEGIES)}.")
    kept = filter_exact_zero_rows(df)
    if strategy == "smart":
        return smart_encode(kept, target)
    if strategy == "one_hot":
        return one_hot_encode(kept)
    if strategy == "label":
        return label_encode(kept)
    return kept


# --- reusable one-hot encoder ------------------------------------------------------------------


@dataclass
class OneHotEncoding:
    """Fitted one-hot encoder: numbers pass, unseen levels give zeros, absent columns are added as 0."""

    numeric: list[str]
    levels: dict[str, list[str | None]]
    features: list[str]

    @classmethod
    def fit(cls, df: DataFrame, cap: int = MAX_LEVELS) -> OneHotEncoding:
        names = [n for n in df.columns if n != ORD]
        numbers = [n for n in names if n in set(numeric_columns(df)) | set(boolean_columns(df))]
        text = [n for n in names if n not in numbers]
        levels: dict[str, list] = {n: list(v) for n, v in levels_by_column(df, text, cap).items()}
        if text:
            row = df.agg(*[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(text)]).first()
            for i, n in enumerate(text):
                if row[i] > 0:
                    levels[n].append(None)
        features = []
        for n in names:
            features += [n] if n in numbers else [cls.feature(n, v) for v in levels[n]]
        return cls(numbers, levels, features)

    @staticmethod
    def feature(column: str, level: str | None) -> str:
        return f"{column}_{'nan' if level is None else level}"

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        made = {}
        for n, levels in self.levels.items():
            for v in levels:
                if n not in df.columns:
                    made[self.feature(n, v)] = F.lit(0)
                elif v is None:
                    made[self.feature(n, v)] = col(n).isNull().cast("int")
                else:
                    made[self.feature(n, v)] = F.coalesce((col(n).cast("string") == v).cast("int"), F.lit(0))
        for n in self.numeric:
            made[n] = col(n) if n in df.columns else F.lit(0)
        return df.select(*[col(k) for k in keep], *[made[f].alias(f) for f in self.features])


def align_columns(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Exactly the expected columns (name -> type); absent ones are null."""
    return df.select(*[(col(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in expected.items()])


def align_features(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the model features as DOUBLE; absent, null and infinite values become 0."""
    return df.select(
        *[col(k) for k in keep],
        *[(S.finite_or(col(f), 0.0) if f in df.columns else F.lit(0.0)).alias(f) for f in features],
    )
