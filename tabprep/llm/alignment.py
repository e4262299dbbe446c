"""Alignment of two tokenizers over the same texts, by Arrow columns from the tokens to the corpus counts."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, materialize, sums, worker_store

SLICE_BYTES = 2_500_000
#: Units whose ids each worker keeps; beyond it units are encoded again in each slice. Not a cap on what is encoded.
CACHED_UNITS = 100_000
#: Most frequent id pairs that go to every task (about 17 bytes each); rarer pairs are joined by shuffle.
LOOKUP_ROWS = 1_000_000
#: Pairs that a task counts before it sends their partial counts.
PARTIAL_ROWS = 1_000_000
#: Units of one text that are written out at once for its digest.
WRITTEN_UNITS = 500_000
#: White space beside a blank, in ASCII for the quick test and in Unicode for the cut.
_BESIDE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = f"{_BESIDE} | {_BESIDE}|^ | $"
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_NO_BINARY, _NO_STRING = pa.scalar(b"", pa.large_binary()), pa.scalar("", pa.large_string())

COLUMNS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_STAGE = (
    "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a array<int>, b array<int>, links array<long>"
)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """A tokenizer's ids of units (a blank goes before each unit) and the bytes of its tokens."""

    encode: object
    token_bytes: pa.Array
    decimals: pa.Array


def _ids(units: pa.Array, vocabularies: tuple[Vocabulary, Vocabulary]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each vocabulary: ids of all units one after the other, and the first place of each unit (one more than units)."""
    cache, keys = worker_store("alignment units").setdefault(vocabularies, {}), units.to_pylist()
    found = [cache.get(k) for k in keys]
    missing = [i for i, ids in enumerate(found) if ids is None]
    for at in range(0, len(missing), 5_000):
        some = missing[at:at + 5_000]
        words = [keys[i] for i in some]
        for i, *ids in zip(some, *(v.encode(words) for v in vocabularies), strict=True):
            found[i] = tuple(array("i", x).tobytes() for x in ids)
        if len(cache) < CACHED_UNITS:
            cache.update((keys[i], found[i]) for i in some if len(keys[i]) < 64)
    out = []
    for side in (0, 1):
        mine = [f[side] for f in found]
        sizes = np.fromiter(map(len, mine), np.int64, len(mine)) // 4
        out.append((np.frombuffer(b"".join(mine), np.int32), np.concatenate([[0], np.cumsum(sizes)])))
    return out


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes in turn for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _made(token_bytes: list[bytes], encode) -> Vocabulary:
    return Vocabulary(
        encode, pa.array(token_bytes, pa.large_binary()), pa.array([str(i) for i in range(len(token_bytes))], pa.large_string())
    )


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens inside texts are plain text."""
    store = worker_store(f"alignment {path}")
    if "v" not in store:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        of, entries = byte_characters(), tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            spelled[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()

        def encode(units):
            return [e.ids for e in tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]

        store["v"] = _made(spelled, encode)
    return store["v"]


def pieces(path: str) -> Vocabulary:
    """A sentencepiece vocabulary with byte fallback, which puts the blank before a unit itself."""
    store = worker_store(f"alignment {path}")
    if "v" not in store:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [
            bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ]
        store["v"] = _made(spelled, lambda units: model.encode(units, num_threads=1))
    return store["v"]


def units_of(text: pa.Array) -> pa.LargeListArray:
    """Each text cut at single blanks between two characters that are no white space.

    Neither tokenizer has a token across such a blank: a byte-level one starts a new word there, and a piece holds its
    blanks in front. So units are encoded alone, each with its blank before it, and no group spans two of them.
    """
    odd = pc.match_substring_regex(text, _ODD)
    plain = pc.split_pattern(text.filter(pc.invert(odd)), " ").cast(pa.large_list(pa.large_string()))
    if not pc.any(odd, min_count=0).as_py():
        return plain
    cut = pa.array([_SINGLE_BLANK.split(t) for t in text.filter(odd).to_pylist()], pa.large_list(pa.large_string()))
    at = odd.to_numpy(zero_copy_only=False)
    place = np.empty(len(at), np.int64)
    place[~at], place[at] = np.arange(len(plain)), len(plain) + np.arange(len(cut))
    return pa.concat_arrays([plain, cut]).take(pa.array(place))


def _grouped(keys: dict, values: dict | None = None) -> pa.Table:
    """Counts (``n``) or sums of ``links`` by the key columns."""
    table = pa.table(keys | (values or {})).group_by(list(keys), use_threads=False)
    found = table.aggregate([("links", "sum")] if values else [([], "count_all")])
    return found.rename_columns([*keys, "links" if values else "n"])


def _joined(lists: pa.LargeListArray, separator: str) -> pa.Array:
    return pc.binary_join(lists, pa.scalar(separator, pa.large_string()))


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


@dataclass
class Aligned:
    """Distinct units of some texts: counts of each, its groups as text, and (unit, a, b, links) in total."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    written: pa.Array
    pairs: pa.Table


def _ends(lists: pa.LargeListArray, vocabulary: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """Unit and end of each token in bytes from its unit's start: a cumulative sum that starts anew with each unit."""
    unit = pc.list_parent_indices(lists)
    size = pc.binary_length(vocabulary.token_bytes.take(lists.flatten()))
    total = pc.cumulative_sum(size.cast(pa.int64())).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], total])[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]
    return unit, total - before[unit.to_numpy(zero_copy_only=False)]


def align_units(units: pa.Array, a: Vocabulary, b: Vocabulary) -> Aligned:
    """Groups and links of distinct units; a unit whose joined token bytes differ from it is not sound and has none."""
    listed = []
    blank = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, _NO_STRING).cast(pa.large_binary())
    sound = np.ones(len(units), bool)
    for vocabulary, (ids, offsets) in zip((a, b), _ids(units, (a, b)), strict=True):
        spelled = pc.binary_join(_lists(offsets, vocabulary.token_bytes.take(pa.array(ids))), _NO_BINARY)
        sound &= pc.equal(spelled, blank).to_numpy(zero_copy_only=False)
        listed.append(_lists(offsets, pa.array(ids)))
    keep = pa.array(np.flatnonzero(sound))
    lists_a, lists_b = (one.take(keep) for one in listed)
    (unit_a, end_a), (unit_b, end_b) = _ends(lists_a, a), _ends(lists_b, b)
    left = pa.table({"unit": unit_a, "end": end_a, "at_a": np.arange(len(end_a))})
    right = pa.table({"unit": unit_b, "end": end_b, "at_b": np.arange(len(end_b))})
    both = left.join(right, keys=["unit", "end"], join_type="inner", use_threads=False)
    groups, tables, texts = [], [], []
    for lists, name, vocabulary, id_name in ((lists_a, "at_a", a, "a"), (lists_b, "at_b", b, "b")):
        ids = lists.flatten()
        closes = np.zeros(len(ids), np.int64)
        closes[both[name].to_numpy()] = 1
        group = np.cumsum(closes) - closes  # both tokenizers close the same groups in the same order
        bounds = np.concatenate([[0], np.flatnonzero(closes) + 1])
        texts.append(_joined(_lists(bounds, vocabulary.decimals.take(ids)), ","))
        tables.append(_grouped({"group": group, id_name: ids}))
        groups.append((group, bounds))
    one, other = tables
    linked = one.rename_columns(["group", "a", "n_a"]).join(other.rename_columns(["group", "b", "n_b"]), keys="group", join_type="inner", use_threads=False)
    unit_of_group = unit_a.to_numpy(zero_copy_only=False)[groups[0][1][1:] - 1] if len(end_a) else np.zeros(0, np.int64)
    unit_of_group = np.flatnonzero(sound)[unit_of_group]
    links = pc.multiply(linked["n_a"], linked["n_b"])
    pairs = _grouped({"unit": unit_of_group[linked["group"].to_numpy()], "a": linked["a"], "b": linked["b"]}, {"links": links})
    counts = [np.where(sound, pc.list_value_length(one).to_numpy(zero_copy_only=False), 0) for one in listed]
    n_groups = np.bincount(unit_of_group, minlength=len(units))
    per_group = np.diff(groups[0][1]) * np.diff(groups[1][1])
    n_links = np.zeros(len(units), np.int64)
    np.add.at(n_links, unit_of_group, per_group)
    lines = pc.binary_join_element_wise(*texts, pa.scalar("|", pa.large_string()))
    written = _joined(_lists(np.concatenate([[0], np.cumsum(n_groups)]), lines), ";")
    return Aligned(sound, *counts, n_groups, n_links, written, pairs)


def _digest(written: pa.Array, codes: np.ndarray) -> str:
    """SHA-256 of the units' groups, separated by ``;``, a bounded part of a long text at a time."""
    found = hashlib.sha256()
    for at in range(0, len(codes), WRITTEN_UNITS):
        some = written.take(pa.array(codes[at:at + WRITTEN_UNITS]))
        if at:
            found.update(b";")
        found.update(_joined(_lists(np.array([0, len(some)]), some), ";")[0].as_buffer())
    return found.hexdigest()


def align_texts(text: pa.Array, a: Vocabulary, b: Vocabulary) -> dict[str, pa.Array]:
    """The columns after ``doc_id`` of the written stage, one row for each text."""
    n = len(text)
    filled = pc.not_equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    lists = units_of(text.filter(pa.array(filled)))
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:][filled] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = np.cumsum(offsets)
    doc = np.flatnonzero(filled)[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    units = align_units(coded.dictionary, a, b)
    sound = filled & (sums(~units.sound[codes], offsets) == 0)
    out = {
        name: pa.array(np.where(sound, sums(values[codes], offsets), 0).astype(np.int64))
        for name, values in (("n_a", units.n_a), ("n_b", units.n_b), ("n_groups", units.n_groups), ("n_links", units.n_links))
    }
    if len(codes) <= WRITTEN_UNITS:
        whole = _joined(_lists(offsets, units.written.take(pa.array(codes))), ";")
        digests = [hashlib.sha256(line.as_buffer()).hexdigest() if good else "" for line, good in zip(whole, sound, strict=True)]
    else:
        digests = [_digest(units.written, codes[offsets[i]:offsets[i + 1]]) if sound[i] else "" for i in range(n)]
    used = sound[doc]
    # One number stands for a (document, unit) or (document, pair), which Acero hashes faster than two columns.
    width = len(units.n_a) + 1
    times = _grouped({"key": doc[used] * width + codes[used]})
    key = times["key"].to_numpy()
    times = pa.table({"doc": key // width, "unit": key % width, "n": times["n"]})
    pair = pc.add(pc.shift_left(units.pairs["a"].cast(pa.int64()), 32), units.pairs["b"].cast(pa.int64())).combine_chunks().dictionary_encode()
    rows = pa.table({"unit": units.pairs["unit"], "pair": pair.indices.cast(pa.int64()), "links": units.pairs["links"]})
    held = times.join(rows, keys="unit", join_type="inner", use_threads=False)
    width = len(pair.dictionary) + 1
    key = held["doc"].to_numpy() * width + held["pair"].to_numpy()
    pairs = _grouped({"key": key}, {"links": pc.multiply(held["links"], held["n"])})
    key = pairs["key"].to_numpy()
    order = np.argsort(key // width, kind="stable")
    key = key[order]
    code = pair.dictionary.to_numpy(zero_copy_only=False)[key % width] if len(key) else key
    sizes = np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=n))])
    out["groups_sha256"] = pa.array(digests, pa.string())
    links = pairs["links"].to_numpy()[order]
    for name, values, kind in (("a", code >> 32, pa.int32()), ("b", code & 0xFFFFFFFF, pa.int32()), ("links", links, pa.int64())):
        out[name] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values).cast(kind))
    return out


def _stage(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    def run(batches):
        a, b = byte_level(a_path), pieces(b_path)
        for batch in batches:
            whole = pc.fill_null(batch.column(2).cast(pa.large_string()), "")
            for at, to in doc_slices(whole, SLICE_BYTES):
                part = align_texts(whole.slice(at, to - at), a, b)
                given = [batch.column(i).slice(at, to - at) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*given, *part.values()], names=["key", "doc_id", *part])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, _STAGE))


def pair_counts(stage: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents link the ids, and whether no other B id of this A id has more.

    Tasks count the pairs of their documents, Spark merges the counts; an A id has no more B ids than the vocabulary.
    """

    def run(batches):
        held = None

        def packed(table):
            return pa.RecordBatch.from_arrays([table[c].combine_chunks() for c in ("a", "b", "docs")], names=["a", "b", "docs"])

        for batch in batches:
            found = _grouped({"a": batch.column(0).flatten(), "b": batch.column(1).flatten()}).rename_columns(["a", "b", "docs"])
            if held is not None:
                both = pa.concat_tables([held, found]).group_by(["a", "b"], use_threads=False).aggregate([("docs", "sum")])
                found = both.rename_columns(["a", "b", "docs"])
            held = found
            if len(held) >= PARTIAL_ROWS:
                yield packed(held)
                held = None
        if held is not None and len(held):
            yield packed(held)

    merged = stage.select("a", "b").mapInArrow(run, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return merged.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def align(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", lookup_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Per document: tokens of both vocabularies, groups, links, links to the A id's most frequent partner, summed counts.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a sentencepiece model; both see a blank
    before the text. A group ends where tokens of both end, its A and B tokens are all linked, and a pair's count is the
    number of documents (rows of the table) that link it. Null and empty texts, and texts that a vocabulary does not
    spell byte by byte, have zeros and an empty digest. Rows with a null or repeated id are documents like the others;
    among equally frequent partners all are the most frequent. Other columns are not read, whatever their names.

    Tasks look the ``lookup_rows`` most frequent pairs up; the documents' rarer pairs are joined by shuffle.
    """
    spark = docs.sparkSession
    stage = _stage(docs, a_path, b_path, doc_id, text)
    pairs = materialize(pair_counts(stage))
    n = pairs.count()
    frequent, rare = pairs, None
    if n > lookup_rows:
        cut = pairs.agg(F.percentile_approx("docs", 1 - lookup_rows / n, 10_000)).first()[0]
        while pairs.filter(F.col("docs") > cut).count() > 2 * lookup_rows:
            cut *= 2
        frequent, rare = pairs.filter(F.col("docs") > cut), pairs.filter(F.col("docs") <= cut)
    local = frequent.toPandas()
    code = (local["a"].to_numpy(np.int64) << 32) | local["b"].to_numpy(np.int64)
    order = np.argsort(code)
    known = spark.sparkContext.broadcast((code[order], local["docs"].to_numpy(np.int64)[order], local["best"].to_numpy(bool)[order]))

    def looked_up(batch):
        """Offsets of the documents' pairs, their links, whether each pair is known, and its place."""
        a, b, links = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "links"))
        sizes = pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy().astype(np.int64)
        codes = known.value[0]
        if not len(codes):
            return sizes, links.flatten().to_numpy(), np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64), wanted
        place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return sizes, links.flatten().to_numpy(), codes[place] == wanted, place, wanted

    def score(batches):
        for batch in batches:
            sizes, links, found, place, _ = looked_up(batch)
            _, docs_of, best = known.value
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            hit = np.where(found, links, 0)
            none = len(docs_of) == 0
            n_best = sums(hit * (0 if none else best[place]), offsets)
            count_sum = sums(hit * (0 if none else docs_of[place]), offsets)
            names = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(n_best.astype(np.int64)), pa.array(count_sum.astype(np.int64))],
                names=[*names, "n_best", "count_sum"],
            )

    kinds = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = stage.mapInArrow(score, kinds)
    if rare is not None:

        def unknown(batches):
            for batch in batches:
                sizes, links, found, _, wanted = looked_up(batch)
                key = np.repeat(batch.column(batch.schema.get_field_index("key")).to_numpy(), sizes)
                left = wanted[~found]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[~found]), "a": pa.array((left >> 32).astype(np.int32)),
                    "b": pa.array((left & 0xFFFFFFFF).astype(np.int32)), "links": pa.array(links[~found]),
                })

        rest = stage.select("key", "a", "b", "links").mapInArrow(unknown, "key long, a int, b int, links long").join(rare, ["a", "b"])
        rest = rest.groupBy("key").agg(
            F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum")
        )
        scored = scored.join(rest, "key", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        })
    return scored.select(*[c.split()[0] for c in COLUMNS.split(", ")])
