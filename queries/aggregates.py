"""Grouping, counts, cross tables, correlation."""

from pyspark.sql import functions as F

from queries.base import EV, LI, holed_events, holed_lineitem, query, rounded, table
from tabprep.operators import aggregates as A

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _each(template: str, names=_MEASURES) -> str:
    return ", ".join(template.format(c=n) for n in names)


@query(f"""WITH {LI} SELECT l_returnflag, l_linestatus, {_each('''round(coalesce(sum({c}), 0), 2) AS {c}_sum,
           round(avg({c}), 6) AS {c}_mean, max({c}) AS {c}_max''')}
           FROM li WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag, l_linestatus""")
def group_auto(spark, d):
    lines = holed_lineitem(spark, d).select("l_returnflag", "l_linestatus", *_MEASURES)
    out = A.group_auto(lines, ["l_returnflag", "l_linestatus"])
    out = rounded(out, 2, *[f"{c}_sum" for c in _MEASURES])
    return rounded(out, 6, *[f"{c}_mean" for c in _MEASURES])


@query("""SELECT o_orderdate, round(avg(o_totalprice), 6) AS o_totalprice_mean, max(o_totalprice) AS o_totalprice_max,
          round(stddev_samp(o_totalprice), 3) AS o_totalprice_std FROM orders GROUP BY o_orderdate""")
def group_auto_by_time(spark, d):
    out = A.group_auto(table(spark, d, "orders").select("o_orderdate", "o_totalprice"), "o_orderdate")
    return rounded(rounded(out, 6, "o_totalprice_mean"), 3, "o_totalprice_std")


@query("""WITH e AS (SELECT event_id, user_id::VARCHAR AS u, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END
          AS event_type, props FROM events) SELECT u, arg_min(event_type, event_id) FILTER (event_type IS NOT NULL)
          AS event_type, arg_min(props, event_id) AS props FROM e GROUP BY u""")
def group_first_values(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("_ord"),
        F.col("user_id").cast("string").alias("u"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        "props",
    )
    return A.group_auto(events, "u")


@query(f"""WITH {LI} SELECT l_linestatus, {_each('''round(coalesce(sum({c}), 0), 2) AS {c}_sum, round(avg({c}), 6) AS
           {c}_mean, max({c}) AS {c}_max, min({c}) AS {c}_min, count({c}) AS {c}_count,
           round(stddev_samp({c}), 6) AS {c}_std''')} FROM li GROUP BY l_linestatus""")
def group_by_functions(spark, d):
    lines = holed_lineitem(spark, d).select("l_linestatus", *_MEASURES)
    out = A.group_by_functions(lines, "l_linestatus", ["sum", "mean", "max", "min", "count", "std"])
    out = rounded(out, 2, *[f"{c}_sum" for c in _MEASURES])
    return rounded(out, 6, *[f"{c}_{f}" for c in _MEASURES for f in ("mean", "std")])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS "count" FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 5""")
def group_sizes(spark, d):
    return A.group_sizes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(f"""WITH {EV} SELECT event_type, count(*) AS "count" FROM ev WHERE event_type IS NOT NULL GROUP BY 1""")
def value_counts(spark, d):
    return A.value_counts(holed_events(spark, d), "event_type")


@query(f"""WITH {LI} SELECT l_returnflag, round(coalesce(sum(l_discount), 0), 2) AS l_discount FROM li GROUP BY 1""")
def grouped_total(spark, d):
    return rounded(A.grouped_total(holed_lineitem(spark, d), "l_returnflag", "l_discount"), 2)


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
          SELECT b.p_brand, t.p_type, coalesce(n, 0) AS "count" FROM (SELECT DISTINCT p_brand FROM part) b
          CROSS JOIN (SELECT DISTINCT p_type FROM part) t LEFT JOIN c ON c.p_brand = b.p_brand AND c.p_type = t.p_type""")
def contingency(spark, d):
    return A.contingency(table(spark, d, "part"), "p_brand", "p_type")


@query("""SELECT l_linenumber, l_orderkey, count(*) AS "count" FROM lineitem GROUP BY 1, 2""")
def contingency_many_levels(spark, d):
    return A.contingency(table(spark, d, "lineitem"), "l_linenumber", "l_orderkey", zeros=False)


@query("""WITH c AS (SELECT l_linenumber, l_suppkey * 100 + l_quantity::BIGINT AS kind, count(*) AS n FROM lineitem
          WHERE l_quantity IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2)
          SELECT a.l_linenumber, b.kind, coalesce(n, 0) AS "count"
          FROM (SELECT DISTINCT l_linenumber FROM c WHERE l_linenumber IS NOT NULL) a CROSS JOIN (SELECT DISTINCT kind FROM c WHERE l_linenumber IS NOT NULL) b
          LEFT JOIN c ON c.l_linenumber = a.l_linenumber AND c.kind = b.kind""")
def contingency_zeros_many_levels(spark, d):
    """Kinds of supplier and quantity: thousands of column levels, with the pairs that never occur."""
    kind = F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    return A.contingency(table(spark, d, "lineitem").withColumn("kind", kind), "l_linenumber", "kind")


@query(f"""WITH {LI} SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS "A",
           count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R"
           FROM li WHERE l_returnflag IS NOT NULL GROUP BY l_linenumber""")
def crosstab(spark, d):
    return A.crosstab(holed_lineitem(spark, d), "l_linenumber", "l_returnflag")


@query(f"""WITH {LI} SELECT l_linenumber, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS "A",
           round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS "N",
           round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS "R"
           FROM li WHERE l_returnflag IS NOT NULL AND l_discount IS NOT NULL GROUP BY l_linenumber""")
def pivot_mean(spark, d):
    return rounded(A.pivot_mean(holed_lineitem(spark, d), "l_linenumber", "l_returnflag", "l_discount"), 6)


@query(f"""WITH {LI} SELECT unnest(['l_orderkey', 'l_returnflag', 'l_discount', 'l_shipdate']) AS "column", unnest([
           count(DISTINCT l_orderkey), count(DISTINCT l_returnflag), count(DISTINCT l_discount),
           count(DISTINCT l_shipdate)]) AS unique_count FROM li""")
def distinct_counts(spark, d):
    return A.distinct_counts(holed_lineitem(spark, d), ["l_orderkey", "l_returnflag", "l_discount", "l_shipdate"])


@query(f"""WITH {LI}, c AS (SELECT l_discount AS m, count(*) AS n FROM li WHERE l_discount IS NOT NULL GROUP BY 1)
           SELECT m AS mode, n AS "count" FROM c ORDER BY n DESC, m LIMIT 1""")
def mode_value(spark, d):
    return A.mode_of(holed_lineitem(spark, d), "l_discount")


@query(f"""WITH {LI}, p AS (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_shipdate']) AS "column",
           unnest([l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')]) AS v FROM li),
           c AS (SELECT "column", v, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL)
           SELECT "column", v AS mode, n AS frequency FROM c
           QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) = 1""")
def column_modes(spark, d):
    return A.column_modes(holed_lineitem(spark, d), ["l_returnflag", "l_linestatus", "l_shipdate"])


def _pairs_sql(names) -> str:
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r FROM li")
    return " UNION ALL ".join(out)


@query(f"WITH {LI} {_pairs_sql(_MEASURES)}")
def correlation_pairs(spark, d):
    return rounded(A.correlation_pairs(holed_lineitem(spark, d), _MEASURES), 6)


#: Many columns whose products with every other are needed; some share a part, some have holes.
_WIDE = {
    f"c{k}": f"l_partkey * {2 * k + 3} % {97 + k} + l_quantity * {k % 4}" + (" + l_extendedprice / 1000" if k % 7 == 0 else "")
    for k in range(60)
}
_WIDE.update({f"c{k}": f"CASE WHEN l_linenumber <> {k % 5} THEN {_WIDE[f'c{k}']} END" for k in range(0, 60, 9)})
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1:]]


@query(f"""WITH w AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _WIDE.items())} FROM lineitem), c AS (SELECT
    [{', '.join(f'corr({a}, {b})' for a, b in _WIDE_PAIRS)}] AS r FROM w) SELECT unnest([{', '.join(f"'{a}'" for a, _ in _WIDE_PAIRS)}]) AS var1,
    unnest([{', '.join(f"'{b}'" for _, b in _WIDE_PAIRS)}]) AS var2, round(unnest(r), 6) AS r FROM c""")
def correlation_pairs_wide(spark, d):
    lines = table(spark, d, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()])
    return rounded(A.correlation_pairs(lines), 6)


@query(f"""WITH {LI} {" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(corr({c}, l_extendedprice), 6) AS r FROM li" for c in ("l_quantity", "l_discount", "l_tax"))}""")
def target_correlations(spark, d):
    lines = holed_lineitem(spark, d).select(*_MEASURES)
    return rounded(A.target_correlations(lines, "l_extendedprice"), 6)
