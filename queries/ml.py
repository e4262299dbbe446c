"""Regression features, models and predictions."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from queries.base import LI, holed_lineitem, query, rounded, table
from queries.linear_sql import FOLDS, curve_sql, scores_sql, validation_sql, weights_sql
from tabprep.operators.charts import prediction_points
from tabprep.plans import features as X
from tabprep.plans import models as M
from tabprep.plans import regression as R

_NUMS = ("l_quantity", "l_discount", "l_tax")
_MED = ", ".join(f"median({c}) AS md_{c}" for c in _NUMS)
_FILLED = ", ".join(f"coalesce({c}, md_{c}) AS {c}" for c in _NUMS)
_STATS = ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, abs(corr({c}, l_extendedprice)) AS r_{c}" for c in _NUMS)
_SCALED_BASE = f"""{LI}, md AS (SELECT {_MED} FROM li), fl AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
  l_returnflag, l_linestatus, {_FILLED} FROM li, md), st AS (SELECT {_STATS} FROM fl)"""
_SCALED = ", ".join(f"round((fl.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in _NUMS)


@query(f"WITH {_SCALED_BASE} SELECT l_orderkey, l_linenumber, {_SCALED} FROM fl, st")
def scale_features(spark, d):
    lines = holed_lineitem(spark, d).select("l_orderkey", "l_linenumber", *_NUMS)
    return rounded(X.fit_scaling(lines, _NUMS).transform(lines), 6)


@query(f"""WITH {_SCALED_BASE} SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
    unnest([r_l_quantity, r_l_discount, r_l_tax]) <= 0.01 AS removed FROM st)""")
def low_correlation_features(spark, d):
    lines = holed_lineitem(spark, d)
    scaling = X.fit_scaling(lines, _NUMS, "l_extendedprice")
    removed = X.low_correlation_features(scaling)
    return spark.createDataFrame([(n, n in removed) for n in _NUMS], "feature string, removed boolean")


_CODES = """fc AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS c FROM (SELECT DISTINCT coalesce(l_returnflag,
  'missing_value') AS x FROM li)), sc AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS c FROM
  (SELECT DISTINCT l_linestatus AS x FROM li))"""


def _costs(spark, d):
    """Lines with a cost that depends on the quantity."""
    cost = F.col("l_extendedprice") + 1000 * F.col("l_quantity")
    return holed_lineitem(spark, d).select(cost.alias("cost"), *_NUMS, "l_returnflag", "l_linestatus")


@query(f"""WITH {_SCALED_BASE}, {_CODES} SELECT round(l_extendedprice + 1000 * l_quantity, 2) AS cost, round((l_quantity - m_l_quantity) / s_l_quantity, 6)
    AS l_quantity, fc.c::DOUBLE AS l_returnflag, sc.c::DOUBLE AS l_linestatus FROM fl JOIN fc ON fc.x =
    coalesce(l_returnflag, 'missing_value') JOIN sc ON sc.x = l_linestatus, st""")
def prepare_features(spark, d):
    """Only the quantity correlates with the price; discount and tax are dropped."""
    prepared, _ = X.prepare(_costs(spark, d), "cost", threshold=0.05)
    return rounded(rounded(prepared, 6), 2, "cost")


@query(f"""WITH {_SCALED_BASE}, {_CODES}, u AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'Z' ELSE
    l_returnflag END AS f, l_quantity FROM li) SELECT u.l_orderkey, u.l_linenumber, round((u.l_quantity - m_l_quantity) /
    s_l_quantity, 6) AS l_quantity, coalesce(fc.c, 0)::DOUBLE AS l_returnflag, 0.0::DOUBLE AS l_linestatus
    FROM u LEFT JOIN fc ON fc.x = coalesce(f, 'missing_value'), st""")
def apply_features(spark, d):
    """A fitted plan on rows with an unseen level and without one of the columns."""
    plan = X.fit_features(_costs(spark, d), "cost", threshold=0.05)
    fresh = holed_lineitem(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.when(F.col("l_linenumber") == 1, "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )
    return rounded(plan.transform(fresh, keep=["l_orderkey", "l_linenumber"]), 6)


def _one_feature(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label")
    )
    return VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines)


_LINE = """f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
  FROM lineitem)"""


@query(f"WITH {_LINE} SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM f")
def linear_regression(spark, d):
    model = M.estimator(M.LINEAR).fit(_one_feature(spark, d))
    row = [(round(float(model.coefficients[0]), 4), round(model.intercept, 4))]
    return spark.createDataFrame(row, "slope double, intercept double")


@query(f"""WITH {_LINE}, p AS (SELECT l_extendedprice AS y, a * l_quantity + b AS p FROM lineitem, f)
    SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2_score, round(avg((y - p) ** 2), 1) AS mse,
    round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs((y - p) / y)) * 100, 4)
    AS mape FROM p""")
def regression_metrics(spark, d):
    data = _one_feature(spark, d)
    predictions = M.estimator(M.LINEAR).fit(data).transform(data)
    out = M.regression_metrics(predictions)
    return rounded(rounded(rounded(out, 6, "r2_score"), 1, "mse"), 4, "mae", "rmse", "mape")


@query(f"""WITH {_LINE}, p AS (SELECT a * l_quantity + b AS p FROM lineitem, f)
    SELECT count(*) AS "count", round(avg(p), 4) AS mean, round(min(p), 4) AS min, round(max(p), 4) AS max FROM p""")
def prediction_summary(spark, d):
    data = _one_feature(spark, d)
    predictions = M.estimator(M.LINEAR).fit(data).transform(data)
    return rounded(R.prediction_summary(predictions, "prediction"), 4)


@query(f"""WITH {_LINE}, k AS (SELECT o_orderkey, o_totalprice AS y, o_custkey * 1.5 AS p FROM orders), n AS (SELECT count(*) AS n
    FROM k), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM k), s AS (SELECT * FROM r, n WHERE n <= 5000 OR
    rn IN (SELECT j * (n - 1) // 4999 FROM range(5000) t(j), n)) SELECT y AS actual, p::DOUBLE AS predicted,
    round((y - p)::DOUBLE, 4) AS residual FROM s""")
def prediction_points_query(spark, d):
    orders = table(spark, d, "orders").withColumn("p", F.col("o_custkey") * 1.5)
    return rounded(prediction_points(orders, "o_totalprice", "p", order_by="o_orderkey"), 4, "residual")


# --- fitted models: linear ones are held against SQL, trees by what must hold of their rows ------------------------


def _training(spark, d):
    """Parts with a price that depends on size, key and type."""
    parts = table(spark, d, "part")
    noise = F.expr("p_partkey * 7919 % 1000") / 500.0
    target = F.col("p_retailprice") + 20 * F.col("p_size") + noise
    return parts.select(
        F.col("p_partkey").alias("_ord"), "p_size", F.sqrt("p_partkey").alias("key_root"), "p_type", "p_brand",
        target.alias("price"),
    )


def _set(spark, d):
    data = _training(spark, d)
    return R.labelled(data, X.fit_features(data, "price"))


def _coefficients(spark, model, features):
    return M.feature_importance(spark, model, features)


@query(weights_sql("ridge", 10.0, 6))
def ridge_regression(spark, d):
    data = _training(spark, d)
    plan = X.fit_features(data, "price")
    return rounded(_coefficients(spark, M.estimator(M.RIDGE, alpha=10.0).fit(R.labelled(data, plan)), plan.features), 6)


@query(weights_sql("lasso", 1.0, 3))
def lasso_regression(spark, d):
    """Rounded to what the iterative solver reaches."""
    data = _training(spark, d)
    plan = X.fit_features(data, "price")
    return rounded(_coefficients(spark, M.estimator(M.LASSO, regParam=1.0).fit(R.labelled(data, plan)), plan.features), 3)


@query()
def random_forest(spark, d):
    data = _training(spark, d)
    plan = X.fit_features(data, "price")
    model = M.estimator(M.FOREST).fit(R.labelled(data, plan))
    return M.feature_importance(spark, model, plan.features)


def _boosted(spark, d):
    """The default boosting model on every part but each fifth, and its errors on both parts."""
    data = M.spread(_set(spark, d))
    train, held = data.filter("_ord % 5 <> 0"), data.filter("_ord % 5 = 0")
    return M.boosting_history(M.estimator(M.BOOSTING).fit(train), train, held)


@query()
def gradient_boosting_history(spark, d):
    return _boosted(spark, d)


@query("""SELECT unnest(range(1, 101))::INTEGER AS iteration, true AS train_falls, true AS held_out_beats_mean FROM (SELECT 1 FROM part LIMIT 1)""")
def gradient_boosting_progress(spark, d):
    """The error on the training rows never rises, and the finished model beats the mean on rows it has not seen."""
    history = _boosted(spark, d)
    spread = _set(spark, d).filter("_ord % 5 = 0").agg(F.stddev_pop("label").alias("spread"))
    last = history.agg(F.max_by("validation_rmse", "iteration").alias("last")).crossJoin(spread)
    before = history.select((F.col("iteration") + 1).alias("iteration"), F.col("train_rmse").alias("before"))
    return history.join(before, "iteration", "left").crossJoin(last).select(
        "iteration", (F.col("train_rmse") <= F.coalesce("before", F.lit(float("inf"))) * (1 + 1e-12)).alias("train_falls"),
        (F.col("last") < F.col("spread")).alias("held_out_beats_mean"),
    )


@query(scores_sql())
def cross_validated_models(spark, d):
    """The linear models over their default grids and folds."""
    trained = M.train_models(_set(spark, d), [M.LINEAR, M.RIDGE, M.LASSO], strategy="grid")
    return M.score_table(spark, trained)


@query(curve_sql())
def learning_curve(spark, d):
    return rounded(M.learning_curve(_set(spark, d), M.estimator(M.LINEAR)), 5)


@query(validation_sql("ridge", M.RIDGE))
def validation_curve(spark, d):
    return rounded(M.validation_curve(_set(spark, d), M.RIDGE), 5)


@query(validation_sql("lasso", M.LASSO))
def validation_curve_lasso(spark, d):
    return rounded(M.validation_curve(_set(spark, d), M.LASSO), 5)


@query()
def train_and_predict(spark, d):
    """End to end with raw categories: train, then predict every part."""
    data = _training(spark, d)
    result = R.train_regression(data, "price", models=[M.LINEAR], folds=FOLDS, encode_raw=True)
    return result.predictor.transform(data.drop("price"))


@query()
def evaluate_all_models(spark, d):
    """The linear models over their default grids, scored on the held-out rows."""
    return R.train_regression(_training(spark, d), "price", models=[M.LINEAR, M.RIDGE, M.LASSO]).all_metrics
