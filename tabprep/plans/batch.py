"""One dataset or many by configuration: clean, rename, encode or group."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.operators.aggregates import group_by_functions
from tabprep.operators.columns import drop_columns, parse_rename_rules, rename_columns
from tabprep.operators.encode import encode
from tabprep.operators.filters import remove_zero_only_rows
from tabprep.plans.cleaning import STATIC, clean


@dataclass
class ProcessConfig:
    cleaning: bool = True
    cleaning_mode: str = STATIC
    block_rows: int = 8
    downcast: bool = True
    rename_rules: str = ""
    encoding: bool = False
    encoding_strategy: str = "smart"
    target: str | None = None
    grouping: bool = False
    group_columns: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=lambda: ["sum", "mean"])


@dataclass
class StageResult:
    """Lazy tables of each stage; a stage that was not asked for is None."""

    raw: DataFrame
    cleaned: DataFrame | None = None
    encoded: DataFrame | None = None
    grouped: DataFrame | None = None
    config: ProcessConfig | None = None

    @property
    def final(self) -> DataFrame:
        for stage in (self.grouped, self.encoded, self.cleaned):
            if stage is not None:
                return stage
        return self.raw

    def shapes(self) -> DataFrame:
        """(stage, n_rows, n_columns), one count per stage."""
        out = None
        for name in ("raw", "cleaned", "encoded", "grouped", "final"):
            table = getattr(self, name)
            if table is None:
                continue
            part = table.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("stage"), "n_rows", F.lit(len(table.columns)).alias("n_columns")
            )
            out = part if out is None else out.unionByName(part)
        return out


def clean_stage(df: DataFrame, config: ProcessConfig) -> DataFrame:
    out = clean(df, config.cleaning_mode, config.block_rows, config.downcast) if config.cleaning else df
    return rename_columns(out, config.rename_rules)


def _renamed(config: ProcessConfig) -> tuple[str | None, list[str]]:
    rules = parse_rename_rules(config.rename_rules)
    target = rules.get(config.target, config.target) if config.target else None
    return target, [rules.get(c, c) for c in config.group_columns]


def process(df: DataFrame, config: ProcessConfig) -> StageResult:
    """All stages of one dataset. Encoding and grouping both start from the cleaned table."""
    target, groups = _renamed(config)
    result = StageResult(raw=df, cleaned=clean_stage(df, config), config=config)
    if config.encoding:
        result.encoded = encode(result.cleaned, config.encoding_strategy, target)
    if config.grouping:
        result.grouped = group_by_functions(result.cleaned, groups, config.functions)
    return result


def _configs(names, configs: ProcessConfig | Mapping[str, ProcessConfig]) -> dict[str, ProcessConfig]:
    return {n: configs if isinstance(configs, ProcessConfig) else configs[n] for n in names}


def process_all(tables: Mapping[str, DataFrame], configs) -> dict[str, StageResult]:
    """Process every dataset, with one configuration for all or one for each."""
    return {n: process(tables[n], c) for n, c in _configs(tables, configs).items()}


def clean_all(tables: Mapping[str, DataFrame], configs) -> dict[str, StageResult]:
    """Only the cleaning stage."""
    return {
        n: StageResult(raw=tables[n], cleaned=clean_stage(tables[n], c), config=c)
        for n, c in _configs(tables, configs).items()
    }


def encode_all(results: Mapping[str, StageResult], configs) -> dict[str, StageResult]:
    """Only the encoding stage, from the cleaned or else the raw table."""
    out = {}
    for n, c in _configs(results, configs).items():
        r = results[n]
        base = r.cleaned if r.cleaned is not None else r.raw
        encoded = encode(base, c.encoding_strategy, c.target) if c.encoding else None
        out[n] = StageResult(r.raw, r.cleaned, encoded, None, c)
    return out


def group_all(results: Mapping[str, StageResult], configs) -> dict[str, StageResult]:
    """Only the grouping stage, from the encoded, else the cleaned, else the raw table."""
    out = {}
    for n, c in _configs(results, configs).items():
        r = results[n]
        base = next(t for t in (r.encoded, r.cleaned, r.raw) if t is not None)
        grouped = group_by_functions(base, c.group_columns, c.functions) if c.grouping and c.group_columns else None
        out[n] = StageResult(r.raw, r.cleaned, r.encoded, grouped, c)
    return out


def drop_after_cleaning(result: StageResult, columns) -> StageResult:
    if result.cleaned is None:
        raise ValueError("No cleaned dataset available.")
    return StageResult(result.raw, drop_columns(result.cleaned, columns), config=result.config)


def remove_zero_rows_after_cleaning(result: StageResult, datetime_col: str | None = None) -> StageResult:
    if result.cleaned is None:
        raise ValueError("No cleaned dataset available.")
    return StageResult(result.raw, remove_zero_only_rows(result.cleaned, datetime_col), config=result.config)
