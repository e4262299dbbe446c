"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import materialize, text_slices, words_of
from tabprep.llm.components import components

SLICE_BYTES = 4_000_000
#: Size of the signatures and sets of one block of nodes that are compared inside a task, and of a task's share of
#: smaller meetings of blocks.
BLOCK_BYTES, CELL_BYTES = 8_000_000, 2_000_000
#: Texts per slice at most: a text's number takes the upper 12 bits of a key, the shingle's hash the rest.
_TEXTS = 4096
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_keys(text: pa.Array, k: int) -> np.ndarray:
    """Sorted distinct keys of the shingles of at most 4096 texts: number of the text, then 52 bits of the hash.

    A-Z are lower-cased. A text with fewer than k words, but at least one, has its whole sequence as its only shingle.
    """
    codes, offsets, words = words_of(pc.ascii_lower(text))
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    known = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)
    hashes = known[codes]
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    size = np.diff(offsets)[doc]
    place = np.arange(n) - offsets[doc]
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        shifted = np.concatenate([hashes[j:], np.zeros(min(j, n), np.uint64)])
        inside = place + j < size
        mixed = np.where(inside, (mixed ^ shifted) * _M1, mixed)
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(32)
    start = (place + k <= size) | ((place == 0) & (size < k))
    keys = (doc[start].astype(np.uint64) << np.uint64(52)) | (mixed[start] >> np.uint64(12))
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * 2 + 1


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature, bands): fingerprint of the set, MinHash values (16 bits each), band hashes.

    Documents without words have no bands and an empty signature.
    """
    flips, factors = _coefficients(bands * rows)

    def run(batches):
        for batch in batches:
            for at, (text,) in text_slices(batch, SLICE_BYTES, _TEXTS):
                yield one(batch.column(0).slice(at, len(text)), text)

    def one(ids, text):
        keys = shingle_keys(text, k)
        doc = (keys >> np.uint64(52)).astype(np.int64)
        count = np.bincount(doc, minlength=len(text))
        some = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[some]
        h = keys & np.uint64((1 << 52) - 1)
        set_a, set_b = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
        signature = np.zeros((len(text), bands * rows), "<u2")
        band = np.zeros((len(text), bands), np.uint64)
        if len(keys):
            set_a[some] = np.add.reduceat(h * _M1 ^ (h >> np.uint64(7)), starts)
            set_b[some] = np.bitwise_xor.reduceat((h + np.uint64(1)) * _M2 ^ ((h * _M1) >> np.uint64(23)), starts)
            x = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for j in range(bands * rows):
                least = np.minimum.reduceat((x ^ flips[j]) * factors[j], starts)
                signature[some, j] = least & 0xFFFF
                b = j // rows
                band[some, b] = (band[some, b] ^ least) * _M1
                band[some, b] ^= band[some, b] >> np.uint64(31)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)),
            pa.array(band[some].ravel().view(np.int64)),
        )
        signs = [s.tobytes() if c else b"" for s, c in zip(signature, count, strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(count), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(signs, pa.binary()), lists],
            names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
        )

    out = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, out)


@lru_cache
def least_matches(n: int, similarity: float, miss: float) -> int:
    """Fewest equal values among n with which a similarity of at least ``similarity`` keeps a posterior of ``miss``.

    With a flat prior the posterior after m of n is Beta(m + 1, n - m + 1), and its upper tail is a binomial sum.
    """
    tail, logs = 0.0, (math.log(similarity), math.log1p(-similarity))
    for m in range(n + 1):
        tail += math.exp(
            math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * logs[0] + (n + 1 - m) * logs[1]
        )
        if tail >= miss:
            return m
    return n


def _pruned(pairs: DataFrame, reps: DataFrame, similarity: float, miss: float, step: int) -> DataFrame:
    """Pairs that stay likely enough after each batch of ``step`` signature values."""
    sides = {
        s: reps.select(F.col("rep").alias(s), F.col("signature").alias(f"sign_{s}"), F.col("n_shingles").alias(f"n_{s}")) for s in "ab"
    }

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) if batch.num_rows
                    else np.zeros((0, 1), "<u2") for c in ("sign_a", "sign_b"))
            alive, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at in range(0, x.shape[1], step):
                same += (x[alive, at:at + step] == y[alive, at:at + step]).sum(1)
                fit = same >= least_matches(min(at + step, x.shape[1]), similarity, miss)
                alive, same = alive[fit], same[fit]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    joined = pairs.join(sides["a"], "a").join(sides["b"], "b")
    sized = joined.filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets share at least ``percent`` of their union."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    fits = reps.join(ids, "rep").select("doc_id", "rep", "set_a", "set_b", "n_shingles")
    texts = materialize(docs.select("doc_id", "text").join(fits.select("doc_id", "rep", "set_a"), "doc_id"))

    def run(batches):
        for batch in batches:
            good = []
            for _, (x, y) in text_slices(batch, SLICE_BYTES, _TEXTS, ("text_a", "text_b")):
                both = np.concatenate([shingle_keys(x, k), shingle_keys(y, k)])
                both.sort()
                common = np.bincount((both[:-1][both[1:] == both[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(x))
                total = np.bincount((both >> np.uint64(52)).astype(np.int64), minlength=len(x)) - common
                good.append((100 * common >= percent * total) & (total > 0))
            mask = pa.array(np.concatenate(good) if good else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    side = {s: texts.select(F.col("rep").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, miss: float = 1e-5, step: int = 30
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included), kept.

    Two documents are linked when they share at least ``percent`` % of the union of their distinct shingles. Documents
    with equal sets count as one node from the start. Candidates share a band. In each band every node first meets only
    the one there that shares bands with most others. Where a band then still holds several components, the next such
    node outside the first component meets all. At last the nodes outside the first component are compared with those of
    other components in blocks of bounded size inside tasks, so no link between components is lost and no pairs become
    rows. Candidates are pruned by the posterior of their similarity and the rest is compared on the full sets.

    A null or empty text has no shingles and no links. A row without id is its own component (null) and is kept.
    Rows that share an id are one node.
    """
    similarity = percent / 100
    found = materialize(sketches(docs, words, bands, rows))
    filled = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    key = ["set_a", "set_b", "n_shingles"]
    reps = materialize(
        filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    ).withColumn("doc_id", F.col("rep"))
    nodes = materialize(filled.join(reps.select(*key, "rep"), key).select("doc_id", "n_shingles", "rep"))
    # An id with several texts joins their nodes.
    several = nodes.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).filter("v <> most")
    links = nodes.join(several.select("doc_id", "v"), "doc_id").select(F.col("rep").alias("u"), "v").filter("u <> v").distinct()

    dealt = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    crowded = dealt.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(dealt.join(crowded, ["band", "hash"]))
    # An original shares more bands with its copies than they do with each other.
    known = shared.groupBy("rep").agg(F.sum("n").alias("near"))
    ranked = shared.join(known, "rep").select("band", "hash", "rep", F.struct("near", -F.col("rep")).alias("rank"))
    middle = ranked.groupBy("band", "hash").agg(F.max_by("rep", "rank").alias("first"))
    members = materialize(ranked.join(middle, ["band", "hash"]))

    def linked(pairs: DataFrame) -> DataFrame:
        likely = materialize(_pruned(pairs.distinct(), reps, similarity, miss, step))
        return _verified(likely, reps, docs, words, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    stars = members.filter("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    roots = components(links.union(linked(stars)))
    rooted = _rooted(members, roots)
    outside = rooted.filter("root <> first_root")
    if not outside.isEmpty():
        picked = outside.groupBy("band", "hash").agg(F.max_by(F.struct("rep", "root"), "rank").alias("p"))
        picked = picked.select("band", "hash", F.col("p.rep").alias("b"), F.col("p.root").alias("other"))
        met = rooted.join(picked, ["band", "hash"]).filter("root <> other AND rep <> first AND rep <> b AND b <> first")
        pairs = met.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b"))
        roots = components(roots.union(linked(pairs)))
        rooted = _rooted(members, roots)
        if not rooted.isEmpty():
            roots = components(roots.union(_linked_in_blocks(rooted, reps, docs, words, percent, miss, step)))
    named = nodes.join(roots.withColumnsRenamed({"u": "rep", "v": "root"}), "rep", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    rest = found.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    # A text without words of an id that has others belongs to their component.
    rest = rest.join(named.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("c")), F.col("doc_id") == F.col("id"), "left")
    rest = rest.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    every = named.unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _full_sets(reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, signature, bands, words): the whole set of shingles of each node, as sorted 8-byte numbers."""

    def run(batches):
        for batch in batches:
            for at, (text,) in text_slices(batch, SLICE_BYTES, _TEXTS):
                n, keys = len(text), shingle_keys(text, k)
                ends = np.searchsorted(keys >> np.uint64(52), np.arange(n + 1, dtype=np.uint64))
                h = keys & np.uint64((1 << 52) - 1)
                sets = [h[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                part = batch.slice(at, n).select(["rep", "signature", "bands"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], names=["rep", "signature", "bands", "words"])

    texts = docs.select("doc_id", "text").join(reps.select("doc_id", "rep", "signature", "bands"), "doc_id").drop("doc_id")
    return texts.mapInArrow(run, "rep long, signature binary, bands array<long>, words binary").dropDuplicates(["rep", "words"])


def _linked_in_blocks(rooted: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, miss: float, step: int) -> DataFrame:
    """Links (u, v) between different components, among the members of each band hash in ``rooted``.

    The members of a band hash are cut into blocks of about ``BLOCK_BYTES``, and so are those outside its first
    component; each block of these meets each block of all. The seats (a node in a meeting) are dealt to cells by meeting, of
    about ``CELL_BYTES`` each or one meeting. A task compares signatures and then full sets, one meeting at a time, and
    yields links only, at most one for each two components that it finds connected. Two nodes that share several bands are compared in the first.
    """
    sets = materialize(_full_sets(reps.join(rooted.select("rep").distinct(), "rep"), docs, k))
    outside = F.col("root") != F.col("first_root")
    weighed = rooted.join(reps.select("rep", (F.lit(1000) + 8 * F.col("n_shingles")).alias("w")), "rep")
    load = weighed.groupBy("band", "hash").agg(F.sum("w").alias("all_w"), F.sum(F.when(outside, F.col("w")).otherwise(0)).alias("out_w"))
    load = load.withColumn("wide", F.ceil(F.col("all_w") / BLOCK_BYTES))
    load = materialize(load.withColumn("high", F.when(F.col("wide") > 1, F.ceil(F.col("out_w") / BLOCK_BYTES)).otherwise(1)))
    total = load.agg(F.sum(F.col("all_w") * F.col("high") + F.when(F.col("wide") > 1, F.col("out_w") * F.col("wide")).otherwise(0))).first()[0]
    cells = max(1, -(-int(total or 0) // CELL_BYTES))
    one = F.col("wide") == 1
    across = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("high") - 1),
        lambda o: F.struct(o.alias("o"), F.pmod(F.xxhash64("rep", F.lit(1)), "wide").alias("a"), (one & outside).alias("left"), F.lit(True).alias("right")),
    )
    down = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("wide") - 1),
        lambda a: F.struct(F.pmod(F.xxhash64("rep", F.lit(2)), "high").alias("o"), a.alias("a"), F.lit(True).alias("left"), F.lit(False).alias("right")),
    )
    seats = weighed.join(load, ["band", "hash"]).select(
        "band", "rep", "root", "hash", outside.alias("outside"),
        F.explode(F.when(outside & ~one, F.concat(across, down)).otherwise(across)).alias("seat"),
    )
    seats = seats.select("rep", "band", "root", "outside", "seat.left", "seat.right", F.xxhash64("band", "hash", "seat.o", "seat.a").alias("meeting"))
    seats = seats.withColumn("cell", F.pmod("meeting", F.lit(cells)))
    similarity = percent / 100

    def links(table: pa.Table) -> pa.Table:
        rep, band, root, outside, left, right, meeting = (
            table.column(c).to_numpy() for c in ("rep", "band", "root", "outside", "left", "right", "meeting")
        )
        root = root.copy()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(rep), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        words = table.column("words")
        sizes = pc.binary_length(words).to_numpy().astype(np.int64) // 8
        starts_of = np.zeros(len(rep), np.int64)
        found = []
        order = np.argsort(meeting, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(meeting[order])) + 1):
            # The sets of one meeting as numbers from 0, one after the other.
            joined = b"".join(w.as_buffer() for chunk in words.take(pa.array(rows)).chunks for w in chunk)
            known, codes = np.unique(np.frombuffer(joined, np.uint64), return_inverse=True)
            codes, marked = codes.astype(np.int32), np.zeros(len(known), bool)
            del joined, known
            starts_of[rows] = np.cumsum(sizes[rows]) - sizes[rows]
            others, earlier = rows[right[rows]], band[rows[0]]
            for i in rows[left[rows]]:
                alive = others[(root[others] != root[i]) & ~(outside[others] & (rep[others] > rep[i]))]
                alive = alive[np.minimum(sizes[alive], sizes[i]) >= similarity * np.maximum(sizes[alive], sizes[i])]
                same = np.zeros(len(alive), np.int64)
                for at in range(0, signature.shape[1], step):
                    to = min(at + step, signature.shape[1])
                    same += (signature[alive, at:to] == signature[i, at:to]).sum(1)
                    fit = same >= least_matches(to, similarity, miss)
                    alive, same = alive[fit], same[fit]
                alive = alive[~(bands[alive, :earlier] == bands[i, :earlier]).any(1)]
                if not len(alive):
                    continue
                starts = np.cumsum(sizes[alive]) - sizes[alive]
                places = np.arange(sizes[alive].sum()) + np.repeat(starts_of[alive] - starts, sizes[alive])
                own = codes[starts_of[i]:starts_of[i] + sizes[i]]
                marked[own] = True
                common = np.add.reduceat(marked[codes[places]].astype(np.int64), starts)
                marked[own] = False
                for j in alive[100 * common >= percent * (sizes[alive] + sizes[i] - common)]:
                    if root[j] != root[i]:
                        found.append((rep[i], rep[j]))
                        root[root == root[j]] = root[i]
        pa.default_memory_pool().release_unused()
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return seats.join(sets, "rep").groupBy("cell").applyInArrow(links, "u long, v long")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Band members with the root of their component and of the first member's, of bands with several components."""
    with_root = members.join(roots.withColumnsRenamed({"u": "rep", "v": "root"}), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    with_root = materialize(with_root)
    mixed = with_root.groupBy("band", "hash").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", "rank").alias("first_root"), F.count("*").alias("n")
    ).filter("low <> high AND n > 2").select("band", "hash", "first_root")
    return materialize(with_root.join(mixed, ["band", "hash"]))
