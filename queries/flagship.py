"""The flagship query and batch processing."""

from pyspark.sql import functions as F

from queries.base import EV, holed_events, query, rounded, table
from tabprep.operators.aggregates import group_by_functions
from tabprep.operators.clean import impute_by_block
from tabprep.operators.joins import merge
from tabprep.operators.profile import quality_report
from tabprep.plans.batch import ProcessConfig, process


@query(f"""WITH {EV}, b AS (SELECT event_id // 8 AS b, median(value) AS m FROM ev GROUP BY 1), c AS (SELECT user_id,
    coalesce(value, m, 0) AS value FROM ev JOIN b ON b.b = event_id // 8), j AS (SELECT c_mktsegment AS segment, value FROM c
    JOIN customer ON c_custkey = user_id), g AS (SELECT segment, sum(value) AS s, avg(value) AS m, max(value) AS x,
    stddev_samp(value) AS d FROM j GROUP BY 1), r AS (SELECT unnest(['segment', 'value_sum', 'value_mean', 'value_max',
    'value_std']) AS "column", unnest([count(segment), count(s), count(m), count(x), count(d)]) AS non_null_count, unnest([
    count(DISTINCT segment), count(DISTINCT round(s, 2)), count(DISTINCT round(m, 6)), count(DISTINCT x),
    count(DISTINCT round(d, 6))]) AS unique_count, count(*) AS n FROM g) SELECT "column", non_null_count, n - non_null_count
    AS null_count, unique_count, round(unique_count / n * 100, 2) AS unique_percentage FROM r""")
def flagship(spark, d):
    """Impute by block, join the users' segments, group, and report the quality of the result."""
    events = impute_by_block(holed_events(spark, d).select("_ord", "user_id", "value"), 8)
    segments = table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    joined = merge(events, segments, on="user_id").select("segment", "value")
    grouped = group_by_functions(joined, "segment", ["sum", "mean", "max", "std"])
    grouped = rounded(rounded(grouped, 2, "value_sum"), 6, "value_mean", "value_std")
    report = quality_report(grouped)
    return report.select("column", "non_null_count", "null_count", "unique_count", "unique_percentage")


@query(f"""WITH {EV}, f AS (SELECT avg(value) AS a FROM ev), m AS (SELECT event_type AS k FROM ev WHERE event_type IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT coalesce(event_type, k) AS kind, round(sum(coalesce(value, a)), 3)
    AS value_sum, round(avg(coalesce(value, a)), 6) AS value_mean FROM ev, f, m GROUP BY 1""")
def process_dataset(spark, d):
    """Clean, rename and group one dataset by configuration."""
    config = ProcessConfig(
        downcast=False, rename_rules="event_type:kind", grouping=True, group_columns=["event_type"],
        functions=["sum", "mean"],
    )
    events = holed_events(spark, d, False).select("ts", "event_type", "value")
    final = process(events, config).final
    return rounded(rounded(final, 3, "value_sum"), 6, "value_mean")
