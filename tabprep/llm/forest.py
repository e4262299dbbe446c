"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.common import materialize

#: Vectors that the trees are fitted on at most; every vector is indexed.
SAMPLE_ROWS = 20_000
LEAF_ROWS = 64
#: Indexed rows and queries that meet in one task.
CELL_ROWS, QUERY_ROWS = 16_384, 2_048


@dataclass(frozen=True)
class Tree:
    """A full binary tree; node n splits at ``cuts[n]`` along ``normals[n]`` and has the children 2n and 2n + 1."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * self.normals[node]).sum(1) > self.cuts[node])
        return node - (1 << self.depth)


def fit_tree(x: np.ndarray, depth: int, seed: int) -> Tree:
    """Each node splits its sample at the median along the difference of two of its vectors, or a random direction."""
    rng = np.random.default_rng(seed)
    normals, cuts = np.zeros((1 << depth, x.shape[1])), np.zeros(1 << depth)
    node = np.ones(len(x), np.int64)
    for n in range(1, 1 << depth):
        inside = np.flatnonzero(node == n)
        way = rng.normal(size=x.shape[1])
        if len(inside) > 1:
            a, b = rng.choice(inside, 2, replace=False)
            if np.abs(x[a] - x[b]).max() > 1e-9:
                way = x[a] - x[b]
        normals[n] = way / np.linalg.norm(way)
        along = x[inside] @ normals[n]
        cuts[n] = np.median(along) if len(inside) else 0.0
        node[inside] = 2 * n + (along > cuts[n])
    return Tree(depth, normals, cuts)


def probes(query: np.ndarray, trees: list[Tree], sizes: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one priority queue over all trees, until the leaves hold ``wanted`` rows.

    A branch waits with the smallest margin on its way, so the most promising branch of any tree comes next.
    """
    waiting = [(-np.inf, t, 1) for t in range(len(trees))]
    margins = [tree.normals @ query - tree.cuts for tree in trees]
    found, held = [], 0.0
    while waiting and held < wanted:
        worst, t, node = heapq.heappop(waiting)
        if node >= 1 << trees[t].depth:
            leaf = node - (1 << trees[t].depth)
            if sizes[t][leaf]:
                found.append((t, leaf))
                held += sizes[t][leaf]
            continue
        margin = margins[t][node]
        heapq.heappush(waiting, (max(worst, -margin), t, 2 * node + 1))
        heapq.heappush(waiting, (max(worst, margin), t, 2 * node))
    return found


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, minus infinity left out."""
    n = int(np.isfinite(scores).sum())
    if n > k:
        floor = np.partition(scores, -k)[-k]
        places = np.flatnonzero(scores >= floor)
    else:
        places = np.flatnonzero(np.isfinite(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _calibrated(x: np.ndarray, trees: list[Tree], k: int, recall: float) -> float:
    """Smallest share of all rows, summed over trees, that reaches the recall on the sample against brute force."""
    sizes = [np.bincount(t.leaves(x), minlength=1 << t.depth) for t in trees]
    places = [t.leaves(x) for t in trees]
    some = np.linspace(0, len(x) - 1, min(len(x), 100)).astype(int)
    inner = x[:, :-1]
    for share in (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8, 1.2, 1.6, 2.0, 2.5, 3.0):
        if share >= len(trees):
            break
        hits = total = 0
        for i in some:
            scores = inner @ inner[i]
            scores[i] = -np.inf
            true = best(scores, np.arange(len(x)), k)
            seen = [np.isin(places[t], [leaf for s, leaf in found if s == t]) for found in [probes(np.append(inner[i], 0), trees, sizes, share * len(x))] for t in range(len(trees))]
            hits += np.any(seen, 0)[true].sum()
            total += len(true)
        if hits >= recall * max(total, 1):
            return share
    return float(len(trees))


def valid(embedding: str, size: int | None = None) -> Column:
    """Vectors with a direction: not null, all components finite, not all zero (and of the given size)."""
    v = F.col(embedding)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(fine & (F.size(v) == size if size else F.lit(True)), F.lit(False))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 4, recall: float = 0.95, seed: int = 7,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of each query with the largest inner product, ties to the smaller id.

    Inner products become distances by one more component, the length that a vector lacks to the longest one. Trees are
    fitted on at most ``SAMPLE_ROWS`` vectors, all vectors are indexed in every tree, and the searched share is the one
    that reaches ``recall`` on the sample. Leaves are grouped into cells that are cut into blocks of about ``CELL_ROWS``
    rows by a hash of the id, so a leaf of equal vectors is many blocks; a block meets blocks of queries.
    A query is no candidate of itself; an id that repeats is one vector, its best score counts. Vectors of another size
    than the most frequent one take no part, nor do null ids.
    """
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(valid("v") & F.col("vec_id").isNotNull())
    out = "query_id long, rank int, vec_id long, score double"
    common = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows, d = common["count"], common["d"]
    usable = usable.filter(F.size("v") == d)
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    longest = float(usable.agg(F.max(norm)).first()[0])
    part = usable.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()
    sample = np.stack(part["v"].to_numpy())

    def lifted(x):
        return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])

    depth = max(0, min(int(np.log2(max(1, rows / LEAF_ROWS))), int(np.log2(max(1, len(sample) / 16)))))
    forest = [fit_tree(lifted(sample), depth, seed + t) for t in range(trees)]
    share = _calibrated(lifted(sample), forest, k, recall)

    def index(frames):
        for frame in frames:
            if len(frame):
                x = lifted(np.stack(frame["v"].to_numpy()))
                for t, tree in enumerate(forest):
                    yield pd.DataFrame({"tree": t, "leaf": tree.leaves(x), "vec_id": frame["vec_id"], "v": frame["v"]})

    indexed = materialize(usable.mapInPandas(index, "tree int, leaf long, vec_id long, v array<double>"))
    counts = indexed.groupBy("tree", "leaf").count().collect()  # one row per leaf of the fitted trees
    sizes = [np.zeros(1 << depth) for _ in range(trees)]
    for t, leaf, n in counts:
        sizes[t][leaf] = n
    wide = max(0, depth - int(np.log2(max(1, rows / CELL_ROWS))))  # leaves of a cell, as a power of two
    blocks = {}
    for t in range(trees):
        for leaf, n in enumerate(sizes[t]):
            blocks[(t, leaf >> wide)] = blocks.get((t, leaf >> wide), 0) + n
    blocks = {c: max(1, int(-(-n // CELL_ROWS))) for c, n in blocks.items()}
    wanted = max(share * rows, (k + 1) * trees)
    chosen = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("q")).filter(valid("q", d) & F.col("query_id").isNotNull())
    chosen = chosen.groupBy("query_id").agg(F.min("q").alias("q"))
    query_blocks = max(1, -(-chosen.count() // QUERY_ROWS))

    def ask(frames):
        for frame in frames:
            made = []
            for query, q in zip(frame["query_id"], frame["q"], strict=True):
                cells: dict[tuple[int, int], list[int]] = {}
                for t, leaf in probes(np.append(q, 0.0), forest, sizes, wanted):
                    cells.setdefault((t, leaf >> wide), []).append(leaf)
                for (t, cell), leaves in cells.items():
                    made += [(t, cell, b, query, q, leaves) for b in range(blocks[(t, cell)])]
            yield pd.DataFrame(made, columns=["tree", "cell", "block", "query_id", "q", "leaves"])

    asked = chosen.mapInPandas(ask, "tree int, cell long, block long, query_id long, q array<double>, leaves array<long>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    number = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() if n > 1 for x in (f"{c[0]}-{c[1]}", n)]), F.concat_ws("-", "tree", "cell")) if any(n > 1 for n in blocks.values()) else F.lit(1)
    held = indexed.withColumn("cell", F.shiftright("leaf", wide)).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(number, F.lit(1))))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids, leaf = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy(), left["leaf"].to_numpy() & ((1 << wide) - 1)
        made = []
        for at in range(0, len(right), 64):
            some = right.iloc[at:at + 64]
            scores = np.stack(some["q"].to_numpy()) @ x.T
            for query, leaves, row in zip(some["query_id"], some["leaves"], scores, strict=True):
                probed = np.zeros(1 << wide, bool)
                probed[np.asarray(leaves) & ((1 << wide) - 1)] = True
                row[~probed[leaf] | (ids == query)] = -np.inf
                top = best(row, ids, k)
                made.append(pd.DataFrame({"query_id": query, "vec_id": ids[top], "score": row[top]}))
        return pd.concat(made)

    keys = ["tree", "cell", "block", "part"]
    met = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
