"""Registry of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same result."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The given tables hold no nulls, so queries about missing values put nulls into fixed cells. Every row
# stays in; both engines use the same rule.
LI_NULL_RULES = {
    "l_discount": "(l_orderkey + l_linenumber) % 4 = 0",
    "l_tax": "l_linenumber = 3",
    "l_returnflag": "l_partkey % 5 = 0",
}
EV_NULL_RULES = {"value": "event_type = 'error' OR event_id % 7 < 2", "event_type": "user_id % 11 = 0"}
LI_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
EV_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def _with_nulls(columns, rules) -> list[str]:
    return [f"CASE WHEN {rules[c]} THEN NULL ELSE {c} END AS {c}" if c in rules else c for c in columns]


LI = f"li AS (SELECT {', '.join(_with_nulls(LI_COLUMNS, LI_NULL_RULES))} FROM lineitem)"
EV = f"ev AS (SELECT {', '.join(_with_nulls(EV_COLUMNS, EV_NULL_RULES))} FROM events)"


def holed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*_with_nulls(LI_COLUMNS, LI_NULL_RULES))


def holed_events(spark: SparkSession, folder: str, ordered: bool = True) -> DataFrame:
    """Events with nulls; with ``ordered`` the key is also the row identity column."""
    df = table(spark, folder, "events").selectExpr(*_with_nulls(EV_COLUMNS, EV_NULL_RULES))
    return df.withColumn("_ord", F.col("event_id")) if ordered else df


def ordered_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("_ord", F.col("event_id"))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round DOUBLE columns (all of them when none is named)."""
    wanted = names or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in wanted})
