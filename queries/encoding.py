"""Category encoding."""

from pyspark.sql import functions as F

from queries.base import EV, LI, holed_events, holed_lineitem, query, rounded, table
from tabprep.operators import encode as E
from tabprep.operators import sparse as S
from tabprep.plans.sparse_features import fit_sparse_features

_SMART = """p AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type,
  'part ' || p_partkey AS code, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part)"""
_MEANS = """pr AS (SELECT avg(price) AS prior FROM p), st AS (SELECT p_brand, avg(coalesce(price, prior)) AS m, count(*) AS n
  FROM p, pr WHERE p_brand IS NOT NULL GROUP BY 1), te AS (SELECT p_brand, CASE WHEN n = 1 THEN prior ELSE
  prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0))) + m * (1 / (1 + exp(-(n - 20) / 10.0))) END AS v FROM st, pr)"""
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _parts(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(key % 6 != 0, F.col("p_brand")).alias("p_brand"),
        "p_type",
        F.concat(F.lit("part "), key).alias("code"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("price"),
    )


def _hot(column: str, levels, prefix: str | None = None) -> str:
    return ", ".join(f"""coalesce({column} = '{v}', false)::INT AS "{prefix or column}_{v}" """ for v in levels)


@query(f"""WITH {_SMART}, {_MEANS} SELECT p_partkey, round(coalesce(v, prior), 6) AS p_brand,
    round(coalesce(price, prior), 6) AS price, {_hot('p_type', _TYPES)} FROM p LEFT JOIN te USING (p_brand), pr""")
def smart_encode(spark, d):
    return rounded(E.smart_encode(_parts(spark, d), "price"), 6)


@query(f"""WITH {_SMART} SELECT p_partkey, price, {_hot('p_type', _TYPES)},
    {_hot('p_brand', [f'Brand#{i}' for i in range(1, 26)])} FROM p""")
def smart_encode_without_target(spark, d):
    return E.smart_encode(_parts(spark, d))


@query(f"""WITH {EV} SELECT event_id, value, (user_id % 2 = 0)::INT AS even,
    {_hot('event_type', ['click', 'error', 'purchase', 'signup', 'view'])} FROM ev""")
def one_hot_encode(spark, d):
    events = holed_events(spark, d, False).select(
        "event_id", "value", (F.col("user_id") % 2 == 0).alias("even"), "event_type"
    )
    return E.one_hot_encode(events)


@query(f"""WITH {EV}, l AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM
    (SELECT DISTINCT coalesce(event_type, 'Unknown') AS x FROM ev)), pl AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS
    code FROM (SELECT DISTINCT props AS x FROM ev)) SELECT event_id, l.code AS event_type, pl.code AS props FROM ev
    JOIN l ON l.x = coalesce(event_type, 'Unknown') JOIN pl ON pl.x = props""")
def label_encode(spark, d):
    return E.label_encode(holed_events(spark, d, False).select("event_id", "event_type", "props"))


@query(f"""WITH {EV}, t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END AS a, user_id % 3 AS b,
    event_type FROM ev), k AS (SELECT * FROM t WHERE NOT (coalesce(a = 0, false) AND b = 0)),
    l AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM
    (SELECT DISTINCT coalesce(event_type, 'Unknown') AS x FROM k))
    SELECT a, b, code AS event_type FROM k JOIN l ON x = coalesce(event_type, 'Unknown')""")
def encode_label_strategy(spark, d):
    events = holed_events(spark, d, False).select(
        F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("a"),
        (F.col("user_id") % 3).alias("b"),
        "event_type",
    )
    return E.encode(events, "label")


@query(f"""WITH {_SMART}, {_MEANS} SELECT 'p_brand' AS "column", p_brand AS level, round(v, 6) AS value FROM te
    UNION ALL SELECT 'p_brand', NULL, round(prior, 6) FROM pr""")
def target_encoder_state(spark, d):
    fitted = E.fit_target_encoder(_parts(spark, d), "price")
    return rounded(fitted.state(), 6)


@query(f"""WITH {_SMART}, {_MEANS} SELECT l_partkey, round(coalesce(v, prior), 6) AS p_brand FROM
    (SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Brand#99' ELSE p_brand END AS p_brand
    FROM lineitem JOIN p ON l_partkey = p_partkey) x LEFT JOIN te USING (p_brand), pr""")
def target_encoder_apply(spark, d):
    """A fitted encoder on other rows, with unseen and missing levels."""
    parts = _parts(spark, d)
    fitted = E.fit_target_encoder(parts, "price")
    used = table(spark, d, "lineitem").select("l_partkey").distinct()
    joined = used.join(parts, used.l_partkey == parts.p_partkey).select(
        "l_partkey", F.when(F.col("l_partkey") % 3 == 0, F.lit("Brand#99")).otherwise(F.col("p_brand")).alias("p_brand")
    )
    return rounded(fitted.transform(joined), 6)


@query(f"""WITH {EV} SELECT event_id, value, {_hot('event_type', ['click', 'purchase', 'signup', 'view'])},
    (event_type IS NULL)::INT AS event_type_nan, 0 AS absent FROM (SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN 'new'
    ELSE event_type END AS event_type FROM ev)""")
def one_hot_encoder_apply(spark, d):
    """Fitted without errors and with an extra column; applied to rows with an unseen level."""
    events = holed_events(spark, d, False).select("event_id", "value", "event_type")
    known = events.filter("event_type IS NULL OR event_type <> 'error'").withColumn("absent", F.lit(1))
    fitted = E.OneHotEncoding.fit(known)
    fresh = events.withColumn("event_type", F.when(F.col("event_id") % 5 == 0, "new").otherwise(F.col("event_type")))
    return fitted.transform(fresh)


@query(f"""WITH {EV} SELECT event_id, coalesce(value, 0) AS value, user_id::DOUBLE AS user_id, 0.0::DOUBLE AS absent FROM ev""")
def align_features(spark, d):
    return E.align_features(holed_events(spark, d, False), ["value", "user_id", "absent"], keep=["event_id"])


@query(f"""WITH {EV} SELECT event_type, NULL::DOUBLE AS absent, event_id FROM ev""")
def align_columns(spark, d):
    expected = {"event_type": "string", "absent": "double", "event_id": "bigint"}
    return E.align_columns(holed_events(spark, d, False), expected)


_WIDE_LEVELS = f"""{LI}, k AS (SELECT l_orderkey * 10 + l_linenumber AS line, 'part ' || l_partkey AS part, l_returnflag AS flag,
    l_quantity AS quantity, l_extendedprice AS price FROM li)"""


def _wide_levels(spark, d):
    """Lines with one level per part: more than a column each would allow."""
    return holed_lineitem(spark, d).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("part "), "l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


@query(f"""WITH {_WIDE_LEVELS}, c AS (SELECT line, dense_rank() OVER (ORDER BY part) - 1 AS a, dense_rank() OVER (ORDER BY flag NULLS FIRST) - 1
    AS b FROM k), m AS (SELECT max(a) + 1 AS parts FROM c) SELECT line, a AS code, 1.0::DOUBLE AS value FROM c UNION ALL
    SELECT line, b + parts, 1.0::DOUBLE FROM c, m""")
def one_hot_sparse_cells(spark, d):
    lines = _wide_levels(spark, d)
    return S.fit_sparse_encoding(lines, ["part", "flag"]).cells(lines, "line")


@query(f"""WITH {_WIDE_LEVELS} SELECT line, price, 2::INTEGER AS entries, (SELECT count(DISTINCT part) + count(DISTINCT flag)
    + max((flag IS NULL)::INT) FROM k)::INTEGER AS size FROM k""")
def one_hot_sparse_vectors(spark, d):
    """Width and entries of the vectors that models are trained on."""
    out = S.one_hot_sparse(_wide_levels(spark, d), ["part", "flag"])
    return out.select("line", "price", S.entries_of("one_hot").alias("entries"), S.size_of("one_hot").alias("size"))


@query(f"""WITH {_WIDE_LEVELS}, u AS (SELECT unnest(['part_' || part, 'flag_' || coalesce(flag, 'nan')]) AS feature, price FROM k),
    t AS (SELECT count(*) AS n, avg(price) AS m, stddev_pop(price) AS s, corr(quantity, price) AS r FROM k),
    g AS (SELECT feature, count(*) AS c, sum(price - (SELECT m FROM t)) AS d FROM u GROUP BY feature),
    w AS (SELECT feature, 1 / sqrt(c / n * (1 - c / n)) AS weight, d / n / (sqrt(c / n * (1 - c / n)) * s) AS r FROM g, t)
    SELECT feature, round(weight, 6) AS weight FROM w WHERE abs(r) > 0.01""")
def sparse_feature_levels(spark, d):
    """Levels that correlate with the price, with the weight of their entry."""
    plan = fit_sparse_features(_wide_levels(spark, d).drop("line", "quantity"), "price")
    return rounded(plan.levels.select("code", "weight").join(plan.feature_names(), "code").select("feature", "weight"), 6)
