"""Random forests grown in tasks: Spark bins the rows and draws the bags, a node that fits one task is finished there.

Spark's own forest splits the nodes of all trees level by level: each level is a pass over all rows, and the driver
holds every node as objects. Here a pass over all rows is made only for nodes of more rows than a task takes; below that
the rows of a node meet in one task, which grows the rest of its tree, and the nodes are written to the shared folder.
Bins, bags, gains and the choice among equal gains are Spark's, so the trees are the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import SparseVector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprep.storage import discard, materialize, remove, settings, shared_dir

# Rows of a node, and bytes of their bins, that one task finishes by itself.
NODE_ROWS = 2_000_000
NODE_BYTES = 64 << 20
# Cells of the histograms that are searched together, and bytes of histograms, rows or blocks that a task holds at a time.
CELLS = 1 << 16
HELD_BYTES = 64 << 20
# Most tasks that finish nodes.
TASKS = 2000
# Records that a task takes at a time.
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
# Gain of a split that is not allowed, and impurity below which a node is not searched, as in Spark.
NO_GAIN = -np.finfo(np.float64).max
PURE = np.finfo(np.float64).eps
BLOCKS = "tree int, node long, part int, block int, rows int, bins binary, labels binary, weights binary"
NODES = (
    "tree int, id long, feature int, threshold double, gain double, impurity double, prediction double, weight double, "
    "total double, squares double"
)
HISTOGRAMS = "tree int, node long, feature int, part int, flush int, sums binary"
SPLITS = "tree int, node long, feature int, bin int, gain double, own binary, left binary, right binary"
SAVED = (
    "struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
    "numCategories: int>>"
)


@dataclass
class Shape:
    """What every task knows of a forest; a feature of k thresholds has k + 1 bins."""

    trees: int
    thresholds: list[np.ndarray]
    depth: int
    least_rows: int
    least_gain: float
    rows: int

    @property
    def sizes(self) -> list[int]:
        return [len(t) + 1 for t in self.thresholds]

    @property
    def bin_type(self) -> np.dtype:
        return np.dtype(np.uint8 if max(self.sizes) <= 256 else np.int32)

    @property
    def node_rows(self) -> int:
        return max(1, min(NODE_ROWS, NODE_BYTES // (len(self.thresholds) * self.bin_type.itemsize)))


# --- rows: bins and bags from Spark's forest ---------------------------------------------------


def bagged_rows(made: RandomForestRegressor, data: DataFrame) -> tuple[DataFrame, Shape] | None:
    """(label and bins, how often each tree takes the row) per row, in the order and partitions of the table, and the shape.

    None for settings that are not met here: weights, categories, a choice of features per node.
    """
    spark = data.sparkSession
    jvm = spark.sparkContext._jvm
    made._transfer_params_to_java()
    java, frame = made._java_obj, data._jdf

    def module(name: str):
        return jvm.java.lang.Class.forName(f"{name}$").getField("MODULE$").get(None)

    impl, coders = "org.apache.spark.ml.tree.impl", "org.apache.spark.sql.catalyst.encoders.AgnosticEncoders"
    categories = module("org.apache.spark.ml.util.MetadataUtils").getCategoricalFeatures(
        frame.schema().apply(made.getFeaturesCol())
    )
    weighted = made.isDefined("weightCol") or made.getMinWeightFractionPerNode() > 0
    if weighted or made.getFeatureSubsetStrategy() != "all" or not categories.isEmpty():
        return None
    none = jvm.scala.Option.empty()
    rows = module("org.apache.spark.ml.util.DatasetUtils").extractInstances(java, frame, none)
    regression = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    strategy = java.getOldStrategy(categories, 0, regression, java.getOldImpurity())
    meta = module(f"{impl}.DecisionTreeMetadata").buildMetadata(rows, strategy, made.getNumTrees(), "all")
    splits = module(f"{impl}.RandomForest").findSplits(rows, meta, made.getSeed())
    points = module(f"{impl}.TreePoint").convertToTreeRDD(rows, splits, meta)
    bagger = module(f"{impl}.BaggedPoint")
    equal = getattr(bagger, "convertToBaggedRDD$default$5")()
    bags = bagger.convertToBaggedRDD(
        points, made.getSubsamplingRate(), made.getNumTrees(), made.getBootstrap(), equal, made.getSeed()
    )

    def coder(kind: str):
        return getattr(jvm.org.apache.spark.sql.catalyst.encoders, f"AgnosticEncoders${kind}")

    def record(name: str, **fields):
        empty = jvm.org.apache.spark.sql.types.Metadata.empty()
        made_of = [coder("EncoderField")(k, v, False, empty, none, none) for k, v in fields.items()]
        tag = module("scala.reflect.ClassTag").apply(jvm.java.lang.Class.forName(f"{impl}.{name}"))
        return coder("ProductEncoder")(tag, jvm.org.apache.spark.api.python.PythonUtils.toSeq(made_of), none)

    numbers = coder("ArrayEncoder")(module(f"{coders}$PrimitiveIntEncoder"), False)
    point = record("TreePoint", label=module(f"{coders}$PrimitiveDoubleEncoder"), binnedFeatures=numbers)
    bagged = record("BaggedPoint", datum=point, subsampleCounts=numbers)
    frame = DataFrame(spark._jsparkSession.createDataset(bags, bagged).toDF(), spark)
    shape = Shape(
        made.getNumTrees(), [np.array([s.threshold() for s in feature]) for feature in splits], made.getMaxDepth(),
        made.getMinInstancesPerNode(), made.getMinInfoGain(), meta.numExamples(),
    )
    return frame.select("datum.label", F.col("datum.binnedFeatures").alias("bins"), F.col("subsampleCounts").alias("taken")), shape


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BLOCKS = pa.schema([
    ("tree", pa.int32()), ("node", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()),
    ("bins", pa.binary()), ("labels", pa.binary()), ("weights", pa.binary()),
])
_HISTOGRAMS = pa.schema([
    ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("part", pa.int32()), ("flush", pa.int32()),
    ("sums", pa.binary()),
])
_SPLITS = pa.schema([
    ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()),
    ("own", pa.binary()), ("left", pa.binary()), ("right", pa.binary()),
])


def blocks_of(rows: DataFrame, shape: Shape) -> DataFrame:
    """The rows that each tree takes, packed by batches: bins by feature, labels, how often."""
    width, trees, kind = len(shape.thresholds), shape.trees, shape.bin_type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False)
            bins = np.ascontiguousarray(_lists(batch.column(1), width).T.astype(kind))
            taken = np.ascontiguousarray(_lists(batch.column(2), trees).T)
            out = []
            for tree in range(trees):
                own = np.flatnonzero(taken[tree])
                if len(own):
                    weights = taken[tree, own].astype(np.uint16)
                    out.append((tree, 1, part, block, len(own), bins[:, own].tobytes(), label[own].tobytes(), weights.tobytes()))
            if out:
                yield _records(out, _BLOCKS)

    return rows.mapInArrow(pack, BLOCKS)


@dataclass
class Rows:
    """Rows of nodes, in the order of the table within a node."""

    bins: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    @classmethod
    def unpacked(cls, bins: bytes, labels: bytes, weights: bytes, kind: np.dtype) -> Rows:
        y = np.frombuffer(labels, np.float64)
        return cls(np.frombuffer(bins, kind).reshape(-1, len(y)), y, np.frombuffer(weights, np.uint16))

    def take(self, index: np.ndarray) -> Rows:
        return Rows(self.bins.take(index, axis=1), self.labels.take(index), self.weights.take(index))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.bins.tobytes(), self.labels.tobytes(), self.weights.tobytes()

    def moments(self) -> list[np.ndarray]:
        """Weight, weighted label and weighted squared label of each row."""
        weight = self.weights.astype(np.float64)
        total = weight * self.labels
        return [weight, total, total * self.labels]


# --- splits ------------------------------------------------------------------------------------


def impurity_of(sums: np.ndarray) -> np.ndarray:
    """Variance from weight, sum and sum of squares (last axis); 0 without rows."""
    weight, total, squares = sums[..., 0], sums[..., 1], sums[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (squares - (total * total) / weight) / weight)


def mean_of(sums: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[..., 0] == 0, 0.0, sums[..., 1] / sums[..., 0])


def best_splits(bins: np.ndarray, own: np.ndarray | None, shape: Shape) -> tuple[np.ndarray, ...]:
    """(gain, bin, own, left, right sums) of the best split of one feature per node, from sums by (node, bin, moment).

    ``own`` are the nodes' sums as their parents left them; a root has those of its first split. The first of equal gains wins.
    """
    upto = bins.cumsum(1)
    left = upto[:, :-1]
    right = upto[:, -1:] - left
    if own is None:
        own = left[:, 0] + right[:, 0]
    lw, rw = left[..., 0], right[..., 0]
    every = lw + rw
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity_of(own)[:, None] - (lw / every) * impurity_of(left) - (rw / every) * impurity_of(right)
    gain[(lw < shape.least_rows) | (rw < shape.least_rows)] = NO_GAIN
    gain[gain < shape.least_gain] = NO_GAIN
    at = gain.argmax(1)
    node = np.arange(len(at))
    return gain[node, at], at, own, left[node, at], right[node, at]


def search(rows: Rows, at: np.ndarray, nodes: int, own: np.ndarray | None, shape: Shape) -> tuple[np.ndarray, ...]:
    """(feature, bin, gain, own, left, right sums) of the best split of each node; ``at`` is the node of each row, ascending."""
    feature, place = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
    gain = np.full(nodes, NO_GAIN)
    left, right = np.zeros((nodes, 3)), np.zeros((nodes, 3))
    known = np.zeros((nodes, 3)) if own is None else own
    moments = rows.moments()
    if own is None:
        known = np.stack([np.bincount(at, m, nodes) for m in moments], -1)
    step = max(1, CELLS // max(shape.sizes))
    starts = np.searchsorted(at, np.arange(0, nodes, step))
    for chunk, begin in enumerate(starts):
        first = chunk * step
        end = starts[chunk + 1] if chunk + 1 < len(starts) else len(at)
        count, here = min(step, nodes - first), slice(first, min(first + step, nodes))
        base, parts = at[begin:end] - first, [m[begin:end] for m in moments]
        mine = None if own is None else own[here]
        for f, size in enumerate(shape.sizes):
            if size == 1:
                continue
            cell = base * size + rows.bins[f, begin:end]
            sums = np.stack([np.bincount(cell, p, count * size) for p in parts], -1).reshape(count, size, 3)
            g, b, mine, l, r = best_splits(sums, mine, shape)
            better = g > gain[here]
            known[here] = mine
            for out, found in ((gain, g), (place, b), (feature, f), (left, l), (right, r)):
                out[here][better] = found[better] if isinstance(found, np.ndarray) else found
    return feature, place, gain, known, left, right


# --- the rest of a tree, in one task -----------------------------------------------------------


@dataclass
class Level:
    """Nodes of one depth; ``feature`` is -1 at leaves, and split nodes have the next level's nodes 2k and 2k + 1 as children."""

    ids: np.ndarray
    feature: np.ndarray
    place: np.ndarray
    gain: np.ndarray
    impurity: np.ndarray
    prediction: np.ndarray
    sums: np.ndarray


def grow(rows: Rows, node: int, own: np.ndarray | None, shape: Shape) -> list[Level]:
    """All nodes from ``node`` down, depth by depth; ``own`` are its sums, None for a root."""
    depth = int(node).bit_length() - 1
    ids, sums = np.array([node], np.int64), None if own is None else own[None]
    wanted = np.array([True])
    at = np.zeros(len(rows.labels), np.int64)
    levels = []
    while len(ids):
        nodes = int(wanted.sum())
        feature, place, gain, known, left, right = search(rows, at, nodes, None if sums is None else sums[wanted], shape)
        if sums is None:
            sums = known
        split = (gain > 0) & (depth < shape.depth)
        level = Level(
            ids, np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.int32), np.zeros(len(ids)), impurity_of(sums), mean_of(sums), sums
        )
        # A searched node without any allowed split has no impurity in Spark's model.
        level.impurity[np.flatnonzero(wanted)[gain == NO_GAIN]] = -1.0
        parents = np.flatnonzero(wanted)[split]
        level.feature[parents], level.place[parents], level.gain[parents] = feature[split], place[split], gain[split]
        levels.append(level)
        depth += 1
        ids = (2 * ids[parents][:, None] + np.arange(2)).ravel()
        sums = np.stack([left[split], right[split]], 1).reshape(-1, 3)
        wanted = (np.abs(impurity_of(sums)) >= PURE) & (depth < shape.depth)
        # Rows go on to the children that are searched, and stay in their order there.
        rank = np.cumsum(split) - 1
        kept = np.flatnonzero(split[at])
        node_of = at[kept]
        right_side = rows.bins[feature[node_of], kept] > place[node_of]
        child = 2 * rank[node_of] + right_side
        on = wanted[child]
        kept, child, right_side = kept[on], (np.cumsum(wanted) - 1)[child[on]], right_side[on]
        order = np.argsort(child, kind="stable")
        rows, at = rows.take(kept[order]), child[order]
    return pruned(levels)


def pruned(levels: list[Level]) -> list[Level]:
    """Leaves of one parent with the same prediction become that parent, as in Spark."""
    for upper, lower in reversed(list(zip(levels, levels[1:]))):
        parents = np.flatnonzero(upper.feature >= 0)
        pairs = np.arange(2 * len(parents)).reshape(-1, 2)
        same = (lower.feature[pairs] < 0).all(1) & (lower.prediction[pairs[:, 0]] == lower.prediction[pairs[:, 1]])
        upper.prediction[parents[same]] = lower.prediction[pairs[same, 0]]
        upper.feature[parents[same]] = -1
        lower.ids[pairs[same].ravel()] = 0
    return levels


def _node_table(tree: int, levels: list[Level], shape: Shape) -> pa.Table:
    """Nodes that pruning left; leaves have neither threshold nor gain."""
    ids, feature, place, gain, impurity, prediction, sums = (
        np.concatenate([getattr(x, name) for x in levels]) for name in ("ids", "feature", "place", "gain", "impurity", "prediction", "sums")
    )
    threshold = np.zeros(len(ids))
    for f, cuts in enumerate(shape.thresholds):
        of = feature == f
        threshold[of] = cuts[place[of]]
    leaf, kept = feature < 0, ids > 0
    columns = [
        np.full(len(ids), tree, np.int32), ids, feature, np.where(leaf, 0.0, threshold), np.where(leaf, -1.0, gain), impurity,
        prediction, *sums.T,
    ]
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.table({n: c[kept] for n, c in zip(names, columns, strict=True)})


def finish(blocks: DataFrame, known: dict[tuple[int, int], np.ndarray], shape: Shape) -> DataFrame:
    """The nodes of all subtrees: the rows of a node meet in one task. ``known`` are sums of nodes below the roots."""
    kind = shape.bin_type

    def subtree(key, table):
        tree, node = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("part", "ascending"), ("block", "ascending")])
        packed = zip(*(table.column(n) for n in ("bins", "labels", "weights")), strict=True)
        pieces = [Rows.unpacked(*(c.as_buffer() for c in row), kind) for row in packed]
        rows = Rows(
            np.concatenate([p.bins for p in pieces], 1), np.concatenate([p.labels for p in pieces]),
            np.concatenate([p.weights for p in pieces]),
        )
        return _node_table(tree, grow(rows, node, known.get((tree, node)), shape), shape)

    parts = min(len(known) or shape.trees, TASKS)
    return blocks.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(subtree, NODES)


# --- nodes of more rows than a task takes ------------------------------------------------------


def reached(bins: bytes, labels: bytes, weights: bytes, splits: dict[int, tuple[int, int]], kind: np.dtype) -> Iterator[tuple[int, Rows]]:
    """The rows of one block by the last node that the splits of its tree lead to."""
    stack = [(1, Rows.unpacked(bins, labels, weights, kind))]
    while stack:
        node, rows = stack.pop()
        if not len(rows.labels):
            continue
        if node not in splits:
            yield node, rows
            continue
        feature, place = splits[node]
        right = rows.bins[feature] > place
        stack += [(2 * node + 1, rows.take(np.flatnonzero(right))), (2 * node, rows.take(np.flatnonzero(~right)))]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        tree, part, block = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("tree", "part", "block"))
        packed = [batch.column(batch.schema.get_field_index(n)) for n in ("bins", "labels", "weights")]
        for i in range(batch.num_rows):
            yield tree[i], part[i], block[i], [c[i].as_buffer() for c in packed]


def routed(blocks: DataFrame, splits: dict[int, dict[int, tuple[int, int]]], wanted: set[tuple[int, int]], shape: Shape) -> DataFrame:
    """Blocks of the wanted nodes."""
    kind = shape.bin_type

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, part, block, packed in _batches(batches):
            out = [
                (tree, node, part, block, len(rows.labels), *rows.packed())
                for node, rows in reached(*packed, splits.get(tree, {}), kind) if (tree, node) in wanted
            ]
            if out:
                yield _records(out, _BLOCKS)

    return blocks.mapInArrow(route, BLOCKS)


def histograms(blocks: DataFrame, splits: dict[int, dict[int, tuple[int, int]]], wanted: set[tuple[int, int]], shape: Shape) -> DataFrame:
    """Sums by (node, feature, bin), of what a task holds at a time."""
    kind, sizes = shape.bin_type, shape.sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        ends = np.cumsum([0, *sizes])
        flush, most = 0, max(1, HELD_BYTES // int(24 * ends[-1]))
        at = TaskContext.get().partitionId()

        def handed() -> Iterator[pa.RecordBatch]:
            for (tree, node), sums in held.items():
                yield _records(
                    [(tree, node, f, at, flush, sums[ends[f]:ends[f + 1]].tobytes()) for f in range(len(sizes)) if sizes[f] > 1 or not f],
                    _HISTOGRAMS,
                )

        for tree, _, _, packed in _batches(batches):
            for node, rows in reached(*packed, splits.get(tree, {}), kind):
                if (tree, node) not in wanted:
                    continue
                sums = held.setdefault((tree, node), np.zeros((ends[-1], 3)))
                moments = rows.moments()
                for f, size in enumerate(sizes):
                    for k, m in enumerate(moments):
                        sums[ends[f]:ends[f + 1], k] += np.bincount(rows.bins[f], m, size)
            if len(held) > most:
                yield from handed()
                held, flush = {}, flush + 1
        yield from handed()

    return blocks.mapInArrow(count, HISTOGRAMS)


def large_splits(found: DataFrame, own: dict[tuple[int, int], np.ndarray | None], shape: Shape) -> list:
    """The best split of each node whose histograms are given."""

    def best(key, table):
        tree, node, feature = (k.as_py() for k in key)
        table = table.sort_by([("part", "ascending"), ("flush", "ascending")])
        sums = np.zeros((shape.sizes[feature], 3))
        for piece in table.column("sums"):
            sums += np.frombuffer(piece.as_buffer(), np.float64).reshape(-1, 3)
        mine = own[tree, node]
        if shape.sizes[feature] > 1:
            gain, place, mine, left, right = (x[0] for x in best_splits(sums[None], None if mine is None else mine[None], shape))
        else:
            gain, place, mine, left, right = NO_GAIN, 0, sums[0] if mine is None else mine, sums[0], sums[0]
        row = (tree, node, feature, int(place), float(gain), mine.tobytes(), left.tobytes(), right.tobytes())
        names = [c.split()[0] for c in SPLITS.split(", ")]
        return pa.table({n: pa.array([v]) for n, v in zip(names, row, strict=True)}).cast(_SPLITS)

    splits = found.groupBy("tree", "node", "feature").applyInArrow(best, SPLITS)
    first = F.max_by(F.struct("feature", "bin", "gain", "own", "left", "right"), F.struct("gain", -F.col("feature")))
    return splits.groupBy("tree", "node").agg(first.alias("best")).collect()


def _node_row(tree: int, node: int, sums: np.ndarray, split: tuple | None = None, gain: float = -1.0, impurity: float | None = None) -> tuple:
    feature, threshold = split or (-1, 0.0)
    own = float(impurity_of(sums)) if impurity is None else impurity
    return (tree, node, feature, float(threshold), float(gain), own, float(mean_of(sums)), *map(float, sums))


def split_large(blocks: DataFrame, shape: Shape) -> tuple[list[tuple], dict, dict]:
    """Nodes of more rows than a task takes, their splits by tree, and the sums of the nodes below that tasks finish."""
    nodes: list[tuple] = []
    splits: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(shape.trees)}
    known: dict[tuple[int, int], np.ndarray] = {}
    searched: dict[tuple[int, int], np.ndarray | None] = {(t, 1): None for t in range(shape.trees)}
    while searched:
        below: dict[tuple[int, int], np.ndarray | None] = {}
        for tree, node, best in large_splits(histograms(blocks, splits, set(searched), shape), searched, shape):
            own, *halves = (np.frombuffer(best[k], np.float64) for k in ("own", "left", "right"))
            depth = node.bit_length() - 1
            if best["gain"] <= 0 or depth == shape.depth:
                nodes.append(_node_row(tree, node, own, impurity=-1.0 if best["gain"] == NO_GAIN else None))
                continue
            feature, place = best["feature"], best["bin"]
            splits[tree][node] = feature, place
            nodes.append(_node_row(tree, node, own, (feature, shape.thresholds[feature][place]), best["gain"]))
            for child, sums in enumerate(halves, 2 * node):
                if abs(impurity_of(sums)) < PURE or depth + 1 == shape.depth:
                    nodes.append(_node_row(tree, child, sums))
                else:
                    (below if sums[0] > shape.node_rows else known)[tree, child] = sums
        searched = below
    return nodes, splits, known


def pruned_above(nodes: list[tuple], leaves: dict[tuple[int, int], float]) -> tuple[list[tuple], list[tuple[int, int]]]:
    """As ``pruned`` for the nodes that all tasks split; ``leaves`` are the subtrees of one node. Also gives what goes."""
    by_id = {n[:2]: n for n in nodes}
    ends = leaves | {n[:2]: n[6] for n in nodes if n[2] < 0}
    gone = []
    for tree, node in sorted((n[:2] for n in nodes if n[2] >= 0), key=lambda n: -n[1]):
        pair = [(tree, 2 * node), (tree, 2 * node + 1)]
        if all(c in ends for c in pair) and ends[pair[0]] == ends[pair[1]]:
            own = by_id[tree, node]
            ends[tree, node] = ends[pair[0]]
            by_id[tree, node] = (tree, node, -1, 0.0, -1.0, own[5], ends[pair[0]], *own[7:])
            gone += pair
    for pair in gone:
        by_id.pop(pair, None)
    return [*by_id.values()], gone


def batched(spark: SparkSession, record_bytes: int):
    """Jobs started inside take as many records of that size at a time as may be held, and no more than before."""
    records = max(1, HELD_BYTES // record_bytes)
    return settings(spark, {k: str(records) for k in BATCHES if records < int(spark.conf.get(k))})


def grown_nodes(rows: DataFrame, shape: Shape) -> DataFrame:
    """All nodes of all trees, written to the shared folder."""
    spark, blocks = rows.sparkSession, blocks_of(rows, shape)
    row_bytes = 4 * (len(shape.thresholds) + shape.trees)
    with batched(spark, row_bytes):
        if shape.rows <= shape.node_rows:
            return materialize(finish(blocks, {}, shape))
        block_rows = int(spark.conf.get(BATCHES[0]))
        blocks = materialize(blocks)
    with batched(spark, block_rows * (len(shape.thresholds) * shape.bin_type.itemsize + 10)):
        upper, splits, known = split_large(blocks, shape)
        lower = materialize(finish(routed(blocks, splits, set(known), shape), known, shape))
    discard(blocks)
    roots = spark.createDataFrame([*known] or [(-1, 0)], "tree int, id long")
    leaves = lower.filter("feature < 0").select("tree", "id", "prediction").join(F.broadcast(roots), ["tree", "id"])
    upper, gone = pruned_above(upper, {(r["tree"], r["id"]): r["prediction"] for r in leaves.collect()})
    if gone:
        lower = lower.join(F.broadcast(spark.createDataFrame(gone, "tree int, id long")), ["tree", "id"], "left_anti").select(lower.columns)
    return lower.unionByName(spark.createDataFrame(upper, NODES))


# --- the estimator and its model ---------------------------------------------------------------


def importances(nodes: DataFrame, features: int) -> SparseVector:
    """Shares of the features in the gain, each tree counting the same."""
    gains = nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    share = F.try_divide("gain", F.sum("gain").over(Window.partitionBy("tree")))
    found = {r[0]: r[1] for r in gains.withColumn("share", share).groupBy("feature").agg(F.sum("share")).collect() if r[1] is not None}
    total = sum(found.values())
    return SparseVector(features, {f: v / total for f, v in found.items()} if total else {})


class Forest(RandomForestRegressor):
    """Spark's random forest, grown in tasks."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        bagged = bagged_rows(self, dataset)
        if bagged is None:
            return super()._fit(dataset)
        rows, shape = bagged
        return self._copyValues(GrownForest(self, grown_nodes(rows, shape), len(shape.thresholds)))


class GrownForest(RandomForestRegressionModel):
    """A forest whose nodes are files; they become Spark's model when something other than the importances is asked for."""

    _loaded = _made = None

    def __init__(self, made: Forest, nodes: DataFrame, features: int):
        super().__init__(None)
        self._resetUid(made.uid)
        self._made, self._nodes, self._features = made, nodes, features
        self._importances = importances(nodes, features)

    @property
    def featureImportances(self) -> SparseVector:
        return self._importances

    @property
    def trees(self) -> list:
        """Made at each call: Spark reads a cached one when it lists the parameters."""
        return RandomForestRegressionModel.trees.func(self)

    @property
    def _java_obj(self):
        if self._loaded is None and self._made is not None:
            self._loaded = self._spark_model()
        return self._loaded

    @_java_obj.setter
    def _java_obj(self, value) -> None:
        self._loaded = value

    def __del__(self) -> None:
        if self._loaded is not None:
            super().__del__()

    def _spark_model(self):
        """Spark's model read from a folder of its own form: a forest of one row gives all but the nodes."""
        spark, made = self._nodes.sparkSession, self._made
        one = spark.createDataFrame([(0.0, SparseVector(self._features, {}))], [made.getLabelCol(), made.getFeaturesCol()])
        path = f"{shared_dir(spark)}/tabprep/{uuid.uuid4().hex}"
        RandomForestRegressor._fit(made, one).write().save(path)
        number = (F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1).alias("number")
        nodes = self._nodes.select("*", number)
        # Siblings follow each other.
        first = nodes.select("tree", F.expr("id div 2").alias("id"), F.col("number").alias("left")).filter("id > 0")
        first = first.groupBy("tree", "id").agg(F.min("left").alias("left"))
        leaf = F.col("feature") < 0
        child = F.when(leaf, -1).otherwise(F.col("left"))
        cut = F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold"))
        saved = F.struct(
            "number", "prediction", "impurity", F.array("weight", "total", "squares"), F.col("weight").cast("long"), "gain", child,
            F.when(leaf, -1).otherwise(child + 1), F.struct("feature", cut, F.lit(-1)),
        ).cast(SAVED)
        out = nodes.join(first, ["tree", "id"], "left").select(F.col("tree").alias("treeID"), saved.alias("nodeData"))
        out.write.mode("overwrite").parquet(f"{path}/data")
        loaded = RandomForestRegressionModel.load(path)
        remove(spark, path)
        java, loaded._java_obj = loaded._java_obj, None
        return java
