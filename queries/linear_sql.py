"""SQL of the linear models: normal equations by elimination, lasso by recursive coordinate descent."""

FOLDS, P = 5, 4
FEATURES = ("p_size", "key_root", "p_type", "p_brand")
_SHARES = "(0.2), (0.4), (0.6), (0.8), (1.0)"
_NAMES = {"ols": "Linear Regression", "ridge": "Ridge Regression", "lasso": "Lasso Regression"}

#: Scaled numbers and label codes, in row order.
_ROWS = f"""raw AS (SELECT p_partkey AS id, p_size, sqrt(p_partkey) AS key_root, p_type, p_brand, p_retailprice + 20 * p_size
    + (p_partkey * 7919 % 1000) / 500.0 AS y FROM part),
  rw AS (SELECT y, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x0,
    (key_root - avg(key_root) OVER ()) / stddev_pop(key_root) OVER () AS x1,
    (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS x2, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS x3,
    row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM raw),
  rows AS (SELECT *, CASE WHEN pos < (n % {FOLDS}) * (n // {FOLDS} + 1) THEN pos // (n // {FOLDS} + 1)
    ELSE (pos - (n % {FOLDS}) * (n // {FOLDS} + 1)) // (n // {FOLDS}) + n % {FOLDS} END AS fold FROM rw)"""
_ALL = ["y", *(f"x{i}" for i in range(P))]
_SUMS = ", ".join(
    ["count(*)::DOUBLE AS n", *(f"sum({a}) AS s_{a}" for a in _ALL)]
    + [f"sum({a} * {b}) AS s_{a}_{b}" for i, a in enumerate(_ALL) for b in _ALL[i:]]
)


def _sum(a: str, b: str) -> str:
    return f"s_{a}_{b}" if _ALL.index(a) <= _ALL.index(b) else f"s_{b}_{a}"


def _equations(keys: str, source: str) -> str:
    """g0: centred products with the penalty on the diagonal; raw products where there is no intercept."""
    cells = []
    for i in range(P):
        for j in range(i, P):
            a, b = f"x{i}", f"x{j}"
            cells.append(f"{_sum(a, b)} - free * s_{a} * s_{b} / n{' + penalty' if i == j else ''} AS m{i}_{j}")
            if i != j:
                cells.append(f"{_sum(a, b)} - free * s_{a} * s_{b} / n AS m{j}_{i}")
        cells.append(f"{_sum('y', f'x{i}')} - free * s_x{i} * s_y / n AS m{i}_{P}")
    return f"g0 AS (SELECT {keys}, free, n, s_y, {', '.join(f's_x{i}' for i in range(P))}, {', '.join(cells)} FROM {source})"


def _eliminated(keys: str) -> str:
    """g1 to gP: one unknown less in every other equation each; then the weights and the intercept as w."""
    steps, kept = [], f"{keys}, free, n, s_y, {', '.join(f's_x{i}' for i in range(P))}"
    for k in range(P):
        cells = [f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" for j in range(k + 1, P + 1)]
        for i in range(P):
            if i != k:
                cells += [f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for j in range(k + 1, P + 1)]
        steps.append(f"g{k + 1} AS (SELECT {kept}, {', '.join(cells)} FROM g{k})")
    weights = ", ".join(f"m{i}_{P} AS w{i}" for i in range(P))
    free = f"free * (s_y{''.join(f' - m{i}_{P} * s_x{i}' for i in range(P))}) / n AS b"
    return ", ".join(steps) + f", w AS (SELECT {keys}, {weights}, {free} FROM g{P})"


def _descended(keys: str, sweeps: int = 400) -> str:
    """lw: lasso weights after enough sweeps over the centred products in g0, whose penalty there is 0."""
    join = " AND ".join(f"g0.{k.strip()} = it.{k.strip()}" for k in keys.split(","))
    source = f"(SELECT it.*, {', '.join(f'g0.m{i}_{j}' for i in range(P) for j in range(P + 1))}, g0.n * g0.alpha AS t FROM it JOIN g0 ON {join} WHERE step < {sweeps})"
    for i in range(P):
        rest = f"m{i}_{P}" + "".join(f" - m{i}_{j} * w{j}" for j in range(P) if j != i)
        source = f"(SELECT * REPLACE (sign({rest}) * greatest(abs({rest}) - t, 0) / m{i}_{i} AS w{i}) FROM {source})"
    zeros = ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(P))
    names = ", ".join(f"w{i}" for i in range(P))
    free = "(s_y" + "".join(f" - w{i} * s_x{i}" for i in range(P)) + ") / n AS b"
    return f"""it AS (SELECT {keys}, 0 AS step, {zeros} FROM g0 UNION ALL SELECT {keys}, step + 1, {names} FROM {source}),
      lw AS (SELECT {', '.join(f'it.{k.strip()}' for k in keys.split(','))}, {names}, {free} FROM it JOIN g0 ON {join} WHERE step = {sweeps})"""


_GUESS = "b" + "".join(f" + w{i} * x{i}" for i in range(P))


def weights_sql(kind: str, alpha: float, digits: int) -> str:
    """Absolute weights of one model over all rows."""
    penalty = alpha if kind == "ridge" else 0
    sums = f"tr AS (SELECT 1 AS k, 1.0 AS free, {penalty}::DOUBLE AS penalty, {alpha}::DOUBLE AS alpha, {_SUMS} FROM rows)"
    if kind == "lasso":
        solved, table = _descended("k"), "lw"
    else:
        solved, table = _eliminated("k"), "w"
    first = _equations("k, alpha", "tr")
    names = ", ".join(f"'{f}'" for f in FEATURES)
    return f"""WITH RECURSIVE {_ROWS}, {sums}, {first}, {solved} SELECT unnest([{names}]) AS feature,
      round(abs(unnest([{', '.join(f'w{i}' for i in range(P))}])), {digits}) AS importance FROM {table}"""


def _folded(settings: str) -> str:
    """Training sums of each fold (all rows less its own) for each setting (model, value, free, penalty, alpha)."""
    names = ["n", *(f"s_{a}" for a in _ALL), *(f"s_{a}_{b}" for i, a in enumerate(_ALL) for b in _ALL[i:])]
    less = ", ".join(f"a.{c} - f.{c} AS {c}" for c in names)
    return f"""fs AS (SELECT fold, {_SUMS} FROM rows GROUP BY fold), al AS (SELECT {_SUMS} FROM rows),
      st(model, value, free, penalty, alpha) AS (VALUES {settings}),
      tr AS (SELECT model, value, fold, free, penalty, alpha, {less} FROM fs f, al a, st)"""


_LINEAR = "('ols', 1, 1.0, 0.0, 0.0), ('ols', 2, 0.0, 0.0, 0.0)"
_RIDGE = ", ".join(f"('ridge', {i}, 1.0, {a}, 0.0)" for i, a in enumerate((0.1, 1.0, 10.0), 1))
_LASSO = ", ".join(f"('lasso', {i}, 1.0, 0.0, {a})" for i, a in enumerate((0.1, 1.0, 10.0), 1))
_KEYS = "model, value, fold"


def _fitted(settings: str) -> str:
    """all_w: weights of each model, value and fold."""
    return f"""{_folded(settings)}, {_equations(f'{_KEYS}, alpha', 'tr')}, {_eliminated(_KEYS)}, {_descended(_KEYS)},
      all_w AS (SELECT * FROM w WHERE model <> 'lasso' UNION ALL SELECT * FROM lw WHERE model = 'lasso')"""


def scores_sql() -> str:
    """Mean and deviation of R2 over the folds for the best setting of each linear model."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
    return f"""WITH RECURSIVE {_ROWS}, {_fitted(f'{_LINEAR}, {_RIDGE}, {_LASSO}')},
      sc AS (SELECT model, value, r.fold, 1 - sum((y - ({_GUESS})) ** 2) / (var_pop(y) * count(*)) AS r2 FROM rows r JOIN all_w v
        ON r.fold = v.fold GROUP BY model, value, r.fold),
      me AS (SELECT model, value, avg(r2) AS r2, stddev_pop(r2) AS dev FROM sc GROUP BY model, value),
      be AS (SELECT model, max(r2) AS r2, arg_max(dev, r2) AS dev FROM me GROUP BY model)
      SELECT CASE model {names} END AS model, round(r2, 4) AS r2, round(dev, 4) AS cv_std, r2 = max(r2) OVER () AS is_best FROM be"""


def validation_sql(kind: str, name: str) -> str:
    param, settings = {"ridge": ("alpha", _RIDGE), "lasso": ("regParam", _LASSO)}[kind]
    source = "(SELECT r.*, v.model, v.value, v.fold AS of, " + ", ".join(f"w{i}" for i in range(P)) + ", b, r.fold <> v.fold AS inside FROM rows r, all_w v)"
    return f"""WITH RECURSIVE {_ROWS}, {_fitted(settings)}, er AS (SELECT value, of, avg((y - ({_GUESS})) ** 2) FILTER (inside) AS train,
        avg((y - ({_GUESS})) ** 2) FILTER (NOT inside) AS held FROM {source} GROUP BY value, of)
      SELECT '{param}' AS param, CASE value WHEN 1 THEN '0.1' WHEN 2 THEN '1.0' ELSE '10.0' END AS value,
        round(sqrt(avg(train)), 5) AS train_rmse, round(sqrt(avg(held)), 5) AS validation_rmse FROM er GROUP BY 2"""


def curve_sql() -> str:
    """Least squares on the first rows outside each fold, for five shares of the smallest training part."""
    return f"""WITH {_ROWS}, fo AS (SELECT fold, min(pos) AS first, count(*) AS size FROM rows GROUP BY fold),
      sh AS (SELECT floor(share * (SELECT sum(size) - max(size) FROM fo))::BIGINT AS m FROM (VALUES {_SHARES}) t(share)),
      pa AS (SELECT r.*, m, f.fold AS of, r.fold <> f.fold AND (CASE WHEN pos < first THEN pos ELSE pos - size END) < m AS inside
        FROM rows r, fo f, sh),
      tr AS (SELECT of, m, 1.0 AS free, 0.0 AS penalty, {_SUMS} FROM pa WHERE inside GROUP BY of, m),
      {_equations('of, m', 'tr')}, {_eliminated('of, m')},
      er AS (SELECT pa.m, pa.of, avg((y - ({_GUESS})) ** 2) FILTER (inside) AS train, avg((y - ({_GUESS})) ** 2) FILTER (fold = pa.of)
        AS held FROM pa JOIN w ON w.m = pa.m AND w.of = pa.of GROUP BY pa.m, pa.of)
      SELECT m::BIGINT AS train_size, round(sqrt(avg(train)), 5) AS train_rmse, round(sqrt(avg(held)), 5) AS validation_rmse FROM er GROUP BY m"""
