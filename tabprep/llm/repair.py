"""Token-id files compressed by a Re-Pair grammar per shard, with random access to each document."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, size_slices, text_column
from tabprep.llm.encoding import SLICE_BYTES, Units
from tabprep.storage import shared_dir

#: Text per shard and the ids after which a task starts another shard.
CHARS_PER_SHARD = 16_000_000
IDS_PER_SHARD = 8_000_000
#: A rule is three numbers in the file, so a pair found fewer than four times does not pay for one.
LEAST, FALL = 4, 4
#: Symbols of at most so many ids are written out before decoding.
SHORT = 256
#: Ids decoded at once; a longer document by itself.
IDS_AT_ONCE = 500_000
_BIN_BITS = 20
#: Numbers of pairs: a document ends after the place; the pair is too rare for a rule. Others follow.
LAST, RARE = 0, 1
FORMAT = (
    "first_id long, last_id long, shard long, n_ids long, terminals long, rule_left array<int>, rule_right array<int>, "
    "rule_length array<int>, doc_ids array<long>, doc_symbols array<int>, width int, symbols binary"
)


def _apart(pairs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions to count, so that a pair of twins does not overlap itself: every second one of a run."""
    again = np.concatenate([[False], (pairs[1:] == pairs[:-1]) & (np.diff(at) == 1)])
    if not again.any():
        return np.ones(len(at), bool)
    place = np.arange(len(at))
    return (place - np.maximum.accumulate(np.where(again, 0, place))) % 2 == 0


def _numbered(symbols: np.ndarray, at: np.ndarray, weights: np.ndarray | None, least: int, first: int):
    """Numbers from ``first`` of the pairs at ``at``, RARE if found fewer than ``least`` times; the pairs and their counts."""
    one, two = symbols[at], symbols[at + 1]
    # Bins of pairs drop most rare ones before the exact count; 32 bits a pair, and a table of flags that stays in cache.
    bins = one.view(np.uint32) * np.uint32(0x9E3779B1)
    bins += two.view(np.uint32)
    bins *= np.uint32(0x85EBCA77)
    bins >>= np.uint32(32 - _BIN_BITS)
    weights = None if weights is None else weights[at]
    some = np.flatnonzero((np.bincount(bins, weights=weights, minlength=1 << _BIN_BITS) >= least)[bins])
    code, known = pd.factorize((one[some].astype(np.int64) << 32) | two[some])
    often = np.bincount(code, weights=None if weights is None else weights[some], minlength=len(known))
    enough = often >= least
    codes = np.full(len(at), RARE, np.int32)
    codes[some] = np.where(enough, first - 1 + np.cumsum(enough), RARE).astype(np.int32)[code]
    return codes, known[enough], often[enough]


def _rounds(symbols: np.ndarray, lengths: np.ndarray, length_of: np.ndarray, least: int, weights: np.ndarray | None = None):
    """Replace pairs until none is found ``least`` times: (left, right, length of all symbols, symbols, new lengths).

    ``length_of`` has the ids of each symbol so far; ``weights`` count a place more than once. Every place keeps the number
    of its pair. A count never grows after its pair was numbered, since all later pairs hold a new symbol: a round counts
    pairs again only where the last count reaches the floor, and numbers only new ones. Changes ``symbols``.
    """
    code = np.full(len(symbols), RARE, np.int32)
    code[np.cumsum(lengths) - 1] = LAST
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pairs, often = np.zeros(2, np.int64), np.zeros(2, np.int64)
    fresh, floor = np.flatnonzero(code != LAST), None
    while True:
        if len(fresh):
            code[fresh], known, found = _numbered(symbols, fresh, weights, least, len(pairs))
            pairs, often = np.concatenate([pairs, known]), np.concatenate([often, found])
            fresh = fresh[:0]
        if floor is None:
            floor = max(least, int(often.max()) // FALL)
        asked = often >= floor
        at = np.flatnonzero(asked[code])
        mine = code[at]
        counted = _apart(mine, at)
        at, mine = at[counted], mine[counted]
        heavy = None if weights is None else weights[at]
        often[asked] = np.bincount(mine, weights=heavy, minlength=len(often))[asked]
        hit = (often >= floor)[mine]
        if not hit.any():
            if floor == least:
                break
            floor = max(least, floor // FALL)
            continue
        at, mine = at[hit], mine[hit]
        chosen = np.flatnonzero(often >= floor)
        chosen = chosen[np.lexsort((pairs[chosen], -often[chosen]))]
        rank = np.zeros(len(often), np.int32)
        rank[chosen] = np.arange(len(chosen), dtype=np.int32)
        mine = rank[mine]
        next_to = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~next_to | (mine[1:] < mine[:-1])
        wins[:-1] &= ~next_to | (mine[:-1] < mine[1:])
        to, mine = at[wins], mine[wins]
        new = np.bincount(mine, weights=None if weights is None else weights[to], minlength=len(chosen)) >= floor
        symbol_of = (len(length_of) - 1 + np.cumsum(new)).astype(np.int32)
        to, mine = to[new[mine]], mine[new[mine]]
        symbols[to] = symbol_of[mine]
        code[to] = np.where(code[to + 1] == LAST, LAST, RARE)
        keep = np.ones(len(symbols), bool)
        keep[to + 1] = False
        symbols, code = symbols[keep], code[keep]
        weights = None if weights is None else weights[keep]
        to -= np.arange(len(to))
        before = to - 1
        before = before[np.concatenate([to[:1] > 0, before[1:] != to[:-1]])]
        fresh = np.concatenate([to, before])
        fresh = fresh[code[fresh] != LAST]
        left.append(pairs[chosen[new]] >> 32)
        right.append(pairs[chosen[new]] & 0xFFFFFFFF)
        length_of = np.concatenate([length_of, length_of[left[-1]] + length_of[right[-1]]])
        floor = max(least, floor // FALL)
    return np.concatenate(left), np.concatenate(right), length_of, symbols, np.diff(np.flatnonzero(code == LAST), prepend=-1)


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST):
    """Re-Pair of one shard: (terminals, left, right, expansion length, symbols, symbols of each document).

    Each round counts the adjacent pairs inside documents, without overlap, and replaces those that occur at least
    ``floor`` times by new nonterminals; where two such pairs share a symbol the more frequent one has it. The floor
    falls by ``FALL`` each round down to ``least``, where rounds go on until no pair occurs that often.
    """
    symbols = ids.astype(np.int32)
    terminals = int(symbols.max()) + 1 if len(symbols) else 0
    left, right, length_of, symbols, per_doc = _rounds(symbols, lengths, np.ones(terminals, np.int64), least)
    return terminals, *(r.astype(np.int32) for r in (left, right, length_of[terminals:])), symbols, per_doc


def compress_units(codes: np.ndarray, per_doc: np.ndarray, flat: np.ndarray, sizes: np.ndarray, least: int = LEAST):
    """``compress`` of documents of ``per_doc`` units each; unit i is the ``sizes[i]`` next ids of ``flat``, at least one.

    Rounds first run inside the distinct units, each counted as often as it is found, and then on the documents, where
    repeated units are single symbols by then. The end is the same: no pair occurs ``least`` times.
    """
    often = np.bincount(codes, minlength=len(sizes))
    used = np.flatnonzero(often)
    symbols, per_unit = _ranges(flat, sizes, used).astype(np.int32), sizes[used]
    terminals = int(symbols.max()) + 1 if len(symbols) else 0
    weights = np.repeat(often[used].astype(np.float64), per_unit)
    left, right, length_of, symbols, per_unit = _rounds(symbols, per_unit, np.ones(terminals, np.int64), least, weights)
    number = np.zeros(len(sizes), np.int32)
    number[used] = np.arange(len(used))
    codes = number[codes]
    lengths = np.diff(np.concatenate([[0], np.cumsum(per_unit[codes])])[np.concatenate([[0], np.cumsum(per_doc)])])
    more_left, more_right, length_of, symbols, per_doc = _rounds(_ranges(symbols, per_unit, codes), lengths, length_of, least)
    rules = np.concatenate([left, more_left]), np.concatenate([right, more_right]), length_of[terminals:]
    return terminals, *(r.astype(np.int32) for r in rules), symbols, per_doc


def _ranges(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of the coded ranges of ``flat`` in turn; ranges of ``sizes`` follow each other."""
    starts, each = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(each)
    return flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]


@dataclass
class Expansions:
    """What each symbol stands for: short ones written out in ``flat``, longer ones as their two halves."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    start: np.ndarray
    flat: np.ndarray


def expansions(terminals: int, left, right, size) -> Expansions:
    """Table for ``decode``. Rules only use earlier symbols; symbols of more than ``SHORT`` ids are not written out."""
    left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
    length = np.concatenate([np.ones(terminals, np.int64), np.asarray(size, np.int64)])
    room = np.where(length > SHORT, 0, length)
    start = np.cumsum(room) - room
    flat = np.empty(int(room.sum()), "<u4")
    flat[:terminals] = np.arange(terminals)
    starts, rooms = start.tolist(), length.tolist()
    view = memoryview(flat)
    for rule, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), terminals):
        if rooms[rule] <= SHORT:
            to, n, m = starts[rule], rooms[a], rooms[b]
            view[to:to + n] = view[starts[a]:starts[a] + n]
            view[to + n:to + n + m] = view[starts[b]:starts[b] + m]
    return Expansions(terminals, left, right, length, start, flat)


def decode(symbols: np.ndarray, table: Expansions) -> np.ndarray:
    """Ids of any run of symbols, such as those of one document. Long symbols are halved until all are short."""
    symbols = np.asarray(symbols, np.int64)
    while (long := table.length[symbols] > SHORT).any():
        rule = np.where(long, symbols - table.terminals, 0)
        halves = np.stack([np.where(long, table.left[rule], symbols), np.where(long, table.right[rule], -1)], 1).ravel()
        symbols = halves[halves >= 0]
    each = table.length[symbols]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return table.flat[np.repeat(table.start[symbols] - (ends - each), each) + np.arange(total)]


def _shard_row(shard: int, docs: list, n_ids: int, grammar: tuple) -> dict:
    terminals, left, right, size, symbols, per_doc = grammar
    width = 2 if terminals + len(left) <= 1 << 16 else 4
    known = [d for d in docs if d is not None]
    return {
        "first_id": min(known, default=None), "last_id": max(known, default=None), "shard": shard, "n_ids": n_ids,
        "terminals": terminals, "rule_left": left, "rule_right": right, "rule_length": size, "doc_ids": docs,
        "doc_symbols": per_doc.astype(np.int32), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes(),
    }


def write_ids(docs: DataFrame, path: str, tokenizer: str, byte_level: bool = False, end_id: int = 2) -> None:
    """Encode every text, end each with ``end_id`` and write shards in ascending doc_id order.

    Null texts are empty, null ids come first, and repeated ids are ordered by their text. The rows are cut into
    ranges of doc_id of about ``CHARS_PER_SHARD`` of text; a task holds one shard of at most ``IDS_PER_SHARD`` ids and
    one more document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-chars // CHARS_PER_SHARD))

    def encode(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        names, codes, per_doc, held = [], [], [], 0
        units = Units(tokenizer, byte_level, end_id)

        def flush():
            nonlocal names, codes, per_doc, held, made
            grammar = compress_units(np.concatenate(codes), np.concatenate(per_doc), *units.ids())
            row = _shard_row((part << 32) + made, names, held, grammar)
            names, codes, per_doc, held, made = [], [], [], 0, made + 1
            units.release()
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            doc_ids, text = batch.column(0).to_pylist(), text_column(batch)
            for at, to in doc_slices(text, SLICE_BYTES):
                new, sizes, n_ids = units.code(text.slice(at, to - at))
                if held and held + n_ids > IDS_PER_SHARD:
                    yield flush()
                    new, sizes, n_ids = units.code(text.slice(at, to - at))
                names += doc_ids[at:to]
                codes.append(new)
                per_doc.append(sizes)
                held += n_ids
        if held:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranges = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    ranges.mapInArrow(encode, FORMAT).write.mode("overwrite").parquet(path)


def _arrow_schema() -> pa.Schema:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [pa.int64()] * 5 + [ints] * 3 + [longs, ints, pa.int32(), pa.binary()]
    return pa.schema(list(zip([f.split()[0] for f in FORMAT.split(", ")], kinds, strict=True)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(FORMAT).parquet(path)

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                left, right, size, per_doc = (
                    row[name].values.to_numpy() for name in ("rule_left", "rule_right", "rule_length", "doc_symbols")
                )
                table = expansions(row["terminals"].as_py(), left, right, size)
                symbols = np.frombuffer(row["symbols"].as_buffer(), f"<u{row['width'].as_py()}").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(per_doc)])
                n, crc = np.diff(np.concatenate([[0], np.cumsum(table.length[symbols])])[ends]), []
                for first, last in size_slices(n, IDS_AT_ONCE):
                    ids = decode(symbols[ends[first]:ends[last]], table)
                    to = np.cumsum(n[first:last])
                    crc += [crc32(ids[a:b]) for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        row["doc_ids"].values, pa.array([row["shard"].as_py()] * len(n), pa.int64()),
                        pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "shard", "inside", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(unpack, "doc_id long, shard long, inside long, n_tokens long, ids_crc32 long")
    # One row per shard: the ids before it. Shard numbers follow the order of doc_id.
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("shard", "n_ids").withColumn("before", F.coalesce(before, F.lit(0))).drop("n_ids")
    return docs.join(starts, "shard").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def id_file_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tabprep/ids-{uuid.uuid4().hex}"
