"""Global order without a global sort in one task: row numbers, ranks and exact quantiles.

A sort key is cut into value ranges of about ``ROWS_PER_RANGE`` rows. The cut points are plain
constants in the plan, so a row always falls into the same range, also when a lost task is run
again. Windows then run inside one range, and one small count per range gives its offset.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.scalars import sort_code
from tabprep.functions.types import as_list, col

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000
# Up to this many distinct values per column the built-in exact percentile is used.
DISTINCT_IN_MEMORY = 100_000
# Relative rank error of the cut points of ranges is 1 / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
# Size of a quantile sketch (rank error about 4 / 10 000), the partial sketches that are merged into one, and the reach
# of a bracket around a wanted rank: a bracket that misses its rank gets the next reach.
SKETCH_SIZE, SKETCH_GROUPS, REACHES = 8192, 64, (0.001, 0.01, 0.1, 1.0)


def _cut_points(df: DataFrame, code: Column, ranges: int) -> list[float]:
    """Strictly increasing inner cut points; a value that fills a whole range gets its own range."""
    probs = [i / ranges for i in range(1, ranges)]
    accuracy = max(SKETCH_ACCURACY, 10 * ranges)
    row = df.agg(F.percentile_approx(code, probs, accuracy).alias("p")).first()
    points: set[float] = set()
    previous = None
    for p in row.p or []:
        if p == previous:
            points.add(math.nextafter(p, math.inf))
        points.add(p)
        previous = p
    return sorted(points)


def _range_index(df: DataFrame, code: Column, points: Sequence[float], name: str) -> DataFrame:
    """Number of cut points at or below the code; nulls sort first as -1."""
    if not points:
        return df.withColumn(name, F.when(code.isNotNull(), F.lit(0)).otherwise(F.lit(-1)))
    splits = [-math.inf, *points, math.inf]
    staged = df.withColumn("_code", code)
    cut = Bucketizer(splits=splits, inputCol="_code", outputCol="_bin", handleInvalid="keep")
    return (
        cut.transform(staged)
        .withColumn(name, F.when(F.col("_code").isNull(), F.lit(-1)).otherwise(F.col("_bin").cast("int")))
        .drop("_code", "_bin")
    )


def split_ranges(df: DataFrame, key: str, name: str = "_range", rows: int | None = None) -> tuple[DataFrame, int]:
    """Add a range number that never decreases with ``key``; returns the table and the range count."""
    n = df.count() if rows is None else rows
    ranges = min(MAX_RANGES, max(1, math.ceil(n / ROWS_PER_RANGE)))
    code = sort_code(col(key), df.schema[key].dataType)
    points = _cut_points(df, code, ranges) if ranges > 1 else []
    return _range_index(df, code, points, name), len(points) + 1


def with_row_number(
    df: DataFrame, order_by: str | Iterable[str], name: str = "_ord", start: int = 0, rows: int | None = None
) -> DataFrame:
    """Consecutive row numbers in the order of ``order_by`` (ascending, nulls first); ``rows`` is the row count if known.

    The last order column should break ties. A crowded range of one code is cut again, by the next bytes of a text
    and then by the next column, so neither a common prefix nor one value on a third of all rows is one task.
    """
    keys = as_list(order_by)
    ranged, ranges = split_ranges(df, keys[0], "_r", rows)
    if ranges > 1:
        ranged = _cut_crowded_ranges(ranged, keys)
    window = Window.partitionBy("_r").orderBy(*[col(k).asc_nulls_first() for k in keys])
    local = F.row_number().over(window).cast("long") + F.lit(start - 1)
    offsets, total = [], 0
    for r in sorted(ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["_r"], total))
        total += r["n"]
    if len(offsets) <= 1:
        return ranged.withColumn(name, local).drop("_r")
    table = df.sparkSession.createDataFrame(offsets, "_r int, _off long")
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(table), "_r")
        .withColumn(name, F.col("_local") + F.col("_off"))
        .select(*[col(n) for n in df.columns if n != name], col(name))
    )


def _cut_crowded_ranges(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Cut ranges of ``_r`` that hold too many rows of one code, until no later bytes or columns are left."""
    at, chunk, before = 0, 0, 0
    while True:
        key, dtype = col(keys[at]), ranged.schema[keys[at]].dataType
        code = sort_code(key, dtype, chunk)
        is_text = isinstance(dtype, T.StringType)
        # A range may be cut by a code only where all that sorts before the code is the same.
        earlier = [*[col(k) for k in keys[:at]], *([F.substring(F.encode(key, "utf-8"), 1, 6 * chunk)] if chunk else [])]
        same = reduce(lambda x, y: x & y, [F.min(e).eqNullSafe(F.max(e)) for e in earlier], F.lit(True))
        sizes = ranged.groupBy("_r").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.octet_length(key) if is_text else F.lit(0)).alias("bytes"), same.alias("same"),
            F.min(code).eqNullSafe(F.max(code)).alias("one_code"), F.min(key).eqNullSafe(F.max(key)).alias("one_value"),
        ).collect()
        full = [r for r in sizes if r["same"] and r["n"] > 2 * ROWS_PER_RANGE]
        crowded = [r for r in full if not r["one_code"]]
        if crowded and len(sizes) > before:
            before = len(sizes)  # far outliers can hide the differences of the rest: again, while that makes more ranges
        else:
            crowded, before = [r for r in full if r["one_code"]], 0
            if any((r["bytes"] or 0) > 6 * (chunk + 1) for r in crowded):
                chunk += 1
            else:
                # Texts that differ in trailing zero bytes only have one code; the next column would put them out of order.
                crowded = [r for r in crowded if r["one_value"]]
                at, chunk = at + 1, 0
        if not crowded or at == len(keys):
            return ranged
        code = sort_code(col(keys[at]), ranged.schema[keys[at]].dataType, chunk)
        ranged = _cut_by_code(ranged, sorted(r["_r"] for r in sizes), {r["_r"]: r["n"] for r in crowded}, code)


def _cut_by_code(ranged: DataFrame, known: list[int], crowded: dict[int, int], code: Column) -> DataFrame:
    """Cut the crowded ranges by a code, each into as many ranges as its rows need, and number all ranges anew.

    The position of a row is the number of crowded ranges below its own, plus a fraction that grows with the code. It
    never decreases in the final order, so the number of cut points at or below it, added to the old number, is the new one.
    """
    finite = (F.abs(code) <= F.lit(1e300)) & ~F.isnan(code)
    bounded = F.when(finite, code)
    inside = ranged.filter(F.col("_r").isin(list(crowded)))
    ends = {r["_r"]: (r["a"], r["b"]) for r in inside.groupBy("_r").agg(F.min(bounded).alias("a"), F.max(bounded).alias("b")).collect()}
    rows, below = [], 0
    for r in known:
        rows.append((r, below, r in crowded, *ends.get(r, (None, None))))
        below += r in crowded
    table = ranged.sparkSession.createDataFrame(rows, "_r int, _below int, _crowded boolean, _low double, _high double")
    share = F.when(F.col("_high") > F.col("_low"), (bounded - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    part = F.when(~F.col("_crowded") | code.isNull(), 0.0).when(F.isnan(code), 0.9)
    part = part.when(finite, 0.25 + 0.5 * share).otherwise(F.when(code < 0, 0.1).otherwise(0.8))
    placed = ranged.join(F.broadcast(table), "_r").withColumn("_place", F.col("_below") + part)
    count = max(2, math.ceil(sum(crowded.values()) / ROWS_PER_RANGE))
    points = _cut_points(placed.filter("_crowded"), F.col("_place"), count)
    cut = _range_index(placed, F.col("_place"), points, "_cut")
    return cut.withColumn("_r", F.col("_r") + F.col("_cut")).drop("_below", "_crowded", "_low", "_high", "_place", "_cut")


def scan_row_number(df: DataFrame, name: str = "_ord", start: int = 0) -> DataFrame:
    """Consecutive row numbers in file order for a table read straight from files; no shuffle.

    ``monotonically_increasing_id`` holds the partition in its upper bits and the position in the
    lower 33 bits. One count per partition gives the offsets.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    counts = tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    rows, total = [], start
    for r in counts:
        rows.append((r.p, total))
        total += r.n
    position = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    if len(rows) <= 1:
        return tagged.withColumn(name, position + F.lit(start)).drop("_mid")
    offsets = df.sparkSession.createDataFrame(rows, "_part long, _off long")
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + position)
        .drop("_mid", "_part", "_off")
    )


def value_ranks(
    df: DataFrame,
    value: str,
    by: str | Iterable[str] | None = None,
    extra: dict[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Distinct non-null values with their counts and positions inside each group.

    Output: group columns, value, ``n`` (copies), ``before`` (rows with a smaller value) and
    ``total`` (rows of the group). ``extra`` adds more aggregates per distinct value.
    ``rows`` is the row count when the caller knows it. Copies are combined before the shuffle and a large group is cut
    into value ranges, so neither a hot value nor a hot group ends up in one task. The average rank
    of a value is ``before + (n + 1) / 2``.
    """
    keys = as_list(by)
    more = extra or {}
    present = df.filter(col(value).isNotNull())
    if not more:
        present = present.select(*[col(k) for k in keys], col(value))
    ranged, ranges = split_ranges(present, value, rows=rows)
    counts = ranged.groupBy(*[col(k) for k in keys], "_range", col(value)).agg(
        F.count(F.lit(1)).alias("n"), *[a.alias(name) for name, a in more.items()]
    )
    group = [col(k) for k in keys]
    inside = Window.partitionBy(*group, "_range").orderBy(col(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("n").over(inside))
    out = [*group, col(value), F.col("n"), *[F.col(name) for name in more]]
    if ranges == 1:
        whole = Window.partitionBy(*group, "_range")
        return placed.withColumn("total", F.sum("n").over(whole)).select(
            *out, (F.col("_upto") - F.col("n")).alias("before"), F.col("total")
        )
    cell = counts.groupBy(*group, "_range").agg(F.sum("n").alias("_cell"))
    along = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    # One row per (group, range), so these windows are small.
    whole = Window.partitionBy(*group) if keys else Window.partitionBy(F.lit(0))
    if not keys:
        along = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    cell = cell.withColumn("_off", F.sum("_cell").over(along) - F.col("_cell")).withColumn(
        "total", F.sum("_cell").over(whole)
    )
    a, b = placed.alias("a"), cell.alias("b")
    match = F.col("a._range") == F.col("b._range")
    for k in keys:
        match = match & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.join(b, match).select(
        *[F.col(f"a.`{k}`").alias(k) for k in keys],
        F.col(f"a.`{value}`").alias(value),
        *[F.col(f"a.{name}").alias(name) for name in ("n", *more)],
        (F.col("a._upto") - F.col("a.n") + F.col("b._off")).alias("before"),
        F.col("b.total").alias("total"),
    )


def average_ranks(df: DataFrame, value: str, by: str | Iterable[str] | None = None) -> DataFrame:
    """Distinct values with the average rank that ties share."""
    return value_ranks(df, value, by).withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2.0)


def group_quantiles(
    df: DataFrame, value: str, by: str | Iterable[str], probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; ``probs`` maps output name to probability."""
    # Own names inside, so that any column name can be a group key.
    keys = {k: f"_g{i}" for i, k in enumerate(as_list(by))}
    inner = df.select(*[col(k).alias(g) for k, g in keys.items()], col(value).alias("_value"))
    ranks = value_ranks(inner, "_value", keys.values())
    v = F.col("_value").cast("double")
    last = F.col("before") + F.col("n")
    out = []
    for name, p in probs.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        # The value at 0-based rank k is the one with before <= k < before + n.
        at_low = F.max(F.when((F.col("before") <= low) & (low < last), v))
        at_high = F.max(F.when((F.col("before") <= high) & (high < last), v))
        weight = F.max(position - low)
        out.append((at_low + (at_high - at_low) * weight).alias(name))
    return ranks.groupBy(*keys.values()).agg(*out).select(*[F.col(g).alias(k) for k, g in keys.items()], *probs)


def quantiles(df: DataFrame, columns: str | Iterable[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of whole columns, as driver-side numbers.

    One pass gives counts and mergeable sketches of distinct and of ordered values; the sketches of scan tasks are first
    merged into ``SKETCH_GROUPS`` and then into one. Columns with few distinct values then use the built-in exact
    percentile. For the others the sketch gives a bracket around each wanted rank: the rows below it are counted, only
    the values inside it are grouped and ranked, and a bracket that misses its rank is widened. The answer is exact
    while almost no row is shuffled.
    """
    names = as_list(columns)
    if not names:
        return {}
    values = df.select(*[col(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    indexes = range(len(names))
    around = sorted({min(max(p + s * d, 0.0), 1.0) for p in probs for s in REACHES for d in (-1, 1)})
    stats = _first_look(values, len(names), around)
    found: dict[int, list[float | None]] = {i: [None] * len(probs) for i in indexes if not stats[f"c{i}"]}
    small = [i for i in indexes if i not in found and stats[f"d{i}"] <= DISTINCT_IN_MEMORY]
    if small:
        row = values.agg(*[F.percentile(f"v{i}", list(probs)).alias(f"q{i}") for i in small]).first()
        found.update({i: list(row[f"q{i}"]) for i in small})
    large = [i for i in indexes if i not in found]
    if large:
        sketched = {i: dict(zip(around, stats[f"s{i}"], strict=True)) for i in large}
        found.update(_bracketed_quantiles(values, large, probs, stats, sketched))
    return {n: found[i] for i, n in enumerate(names)}


def _first_look(values: DataFrame, columns: int, around: Sequence[float]):
    """One row: count ``c``, estimated distinct values ``d`` and approximate quantiles ``s`` of each column."""
    part, whole = [], []
    points = ", ".join(f"{p!r}D" for p in around)
    for i in range(columns):
        part += [
            F.count(f"v{i}").alias(f"c{i}"), F.expr(f"hll_sketch_agg(xxhash64(v{i}))").alias(f"d{i}"),
            F.expr(f"kll_sketch_agg_double(v{i}, {SKETCH_SIZE})").alias(f"s{i}"),
        ]
        whole += [
            F.sum(f"c{i}").alias(f"c{i}"), F.expr(f"hll_sketch_estimate(hll_union_agg(d{i}))").alias(f"d{i}"),
            F.expr(f"kll_merge_agg_double(s{i}, {SKETCH_SIZE})").alias(f"s{i}"),
        ]
    groups = values.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(*part)
    read = [
        F.expr(f"CASE WHEN c{i} > 0 THEN kll_sketch_get_quantile_double(s{i}, array({points})) END").alias(f"s{i}") for i in range(columns)
    ]
    return groups.agg(*whole).select(*[f"{k}{i}" for i in range(columns) for k in "cd"], *read).first()


def _bracketed_quantiles(values: DataFrame, columns: list[int], probs, stats, sketched) -> dict[int, list[float]]:
    # One target per column and probability: (column, lower rank, upper rank, weight of the upper one).
    targets = []
    for i in columns:
        for p in probs:
            position = (stats[f"c{i}"] - 1) * p
            targets.append((i, p, math.floor(position), math.ceil(position), position - math.floor(position)))

    def ends(i: int, p: float, reach: float) -> tuple[float, float]:
        # Outside of all values the bracket is open; NaN sorts last.
        low = sketched[i][p - reach] if p - reach > 0 else -math.inf
        return low, sketched[i][p + reach] if p + reach < 1 else math.nan

    todo, found = list(range(len(targets))), {}
    for reach in REACHES:
        brackets = {t: ends(targets[t][0], targets[t][1], reach) for t in todo}
        counts = values.agg(
            *[F.count_if(F.col(f"v{targets[t][0]}") < brackets[t][0]).alias(f"l{t}") for t in todo],
            *[F.count_if(F.col(f"v{targets[t][0]}") <= brackets[t][1]).alias(f"h{t}") for t in todo],
        ).first()
        ready = [t for t in todo if counts[f"l{t}"] <= targets[t][2] and targets[t][3] < counts[f"h{t}"]]
        if ready:
            found.update(_values_at_ranks(values, targets, brackets, counts, ready))
        todo = [t for t in todo if t not in found]
        if not todo:
            break
    out: dict[int, list[float]] = {i: [] for i in columns}
    for t, target in enumerate(targets):
        out[target[0]].append(found[t])
    return out


def _values_at_ranks(values: DataFrame, targets, brackets, counts, ready: list[int]) -> dict[int, float]:
    held = {t: F.col(f"v{targets[t][0]}").between(*brackets[t]) for t in ready}
    tagged = [
        F.when(held[t], F.struct(F.lit(t).alias("t"), F.col(f"v{targets[t][0]}").alias("v"))) for t in ready
    ]
    # Nearly all rows lie outside every bracket and leave before the tags are made.
    near = values.filter(reduce(lambda a, b: a | b, held.values()))
    inside = near.select(F.explode(F.array_compact(F.array(*tagged))).alias("s")).select("s.t", "s.v")
    rows = sum(counts[f"h{t}"] - counts[f"l{t}"] for t in ready)
    ranks = value_ranks(inside, "v", ["t"], rows=rows)

    def per_target(numbers: dict[int, int]) -> Column:
        return F.create_map(*[x for t, v in numbers.items() for x in (F.lit(t), F.lit(v))])[F.col("t")]

    at = F.col("before") + per_target({t: counts[f"l{t}"] for t in ready})
    until = at + F.col("n")
    low = per_target({t: targets[t][2] for t in ready})
    high = per_target({t: targets[t][3] for t in ready})
    hits = ranks.groupBy("t").agg(
        F.max(F.when((at <= low) & (low < until), F.col("v"))).alias("a"),
        F.max(F.when((at <= high) & (high < until), F.col("v"))).alias("b"),
    )
    return {r["t"]: r["a"] + (r["b"] - r["a"]) * targets[r["t"]][4] for r in hits.collect()}


def evenly_downsample(
    df: DataFrame, max_points: int, order_by: str | Iterable[str], rows: int | None = None
) -> DataFrame:
    """``max_points`` rows at evenly spaced positions of the sorted table; all rows when it is shorter.

    Position k is floor(k * (n - 1) / (m - 1)). Whether a row number is one of them is a plain arithmetic test. Only the
    order columns are numbered; the keys found, at most ``max_points``, then pick their rows in a second scan, so no
    whole rows are sorted. Rows that share all order columns stand for each other.
    """
    n, keys = df.count() if rows is None else rows, as_list(order_by)
    if n <= max_points:
        return with_row_number(df, keys, "_pos", rows=n)
    numbered = with_row_number(df.select(*[col(k) for k in keys]), keys, "_pos", rows=n)
    if max_points == 1:
        chosen = numbered.filter(F.col("_pos") == 0)
    else:
        m1, n1 = max_points - 1, n - 1
        staged = numbered.withColumn("_k", F.expr(f"(_pos * {m1} + {n1 - 1}) div {n1}"))
        chosen = staged.filter(F.expr(f"(_k * {n1}) div {m1}") == F.col("_pos")).drop("_k")
    if set(df.columns) <= set(keys):
        return chosen.select(*[col(c) for c in df.columns], "_pos")
    wanted = chosen.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list("_pos")).alias("_at"))
    fixed_width = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if all(isinstance(df.schema[k].dataType, fixed_width) for k in keys):
        wanted = F.broadcast(wanted)
    match = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    same = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.col("_k0"))
    found = df.join(wanted, match).withColumn("_n", F.row_number().over(same))
    return found.filter(F.col("_n") <= F.size("_at")).select(*[col(c) for c in df.columns], F.get("_at", F.col("_n") - 1).alias("_pos"))


def preview(df: DataFrame, order_by: str | Iterable[str], rows: int = 10) -> DataFrame:
    """The first rows by the order columns (a top-k, not a full sort)."""
    return df.orderBy(*[col(k).asc_nulls_first() for k in as_list(order_by)]).limit(rows)
