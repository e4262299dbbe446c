"""Token-id files and packing against direct encoding and brute force."""

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabprep.llm import encoding, packing, repair

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "one", " lead", "trail ", "two  spaces", "line\nbreak", "a\n\nb", "tab\tbed", "it's we'll, don't.", "Ünïcode ß,. ǅ", "!!! ??? ###$$$", "\n", " ",
    "end <|endoftext|> of <|ENDOFTEXT|>", "éa, x y z w", "CAPS, Words. 12,34.5", "x " * 3000, "ΣΑΣ Σ, 中文 字,", "mixed\r\nends", "a . b , c", "q\x1cr",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", 7), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, length int")


def _ids(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(("path", "byte_level"), [(WORD, False), (BYTE, True)])
def test_ids_equal_direct_encoding(path, byte_level):
    text = pa.array([t or "" for t in TEXTS], pa.large_string())
    got = []
    for _, ids, lengths in encoding.encoded(text, path, byte_level, 2):
        got += np.split(ids, np.cumsum(lengths)[:-1])
    for mine, text in zip(got, TEXTS, strict=True):
        assert mine.tolist() == _ids(path, text, 2).tolist(), text


def test_words_beyond_the_cache_are_encoded(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_WORDS", 0)
    text = pa.array(["zzyx qwrt zzyx, plugh."], pa.large_string())
    ((_, ids, _),) = encoding.encoded(text, WORD, False, 2)
    assert ids.tolist() == _ids(WORD, "zzyx qwrt zzyx, plugh.", 2).tolist()


def _most_often(symbols, per_doc):
    """Largest number of places of one pair inside documents, without overlap."""
    found, at = Counter(), 0
    for n in per_doc.tolist():
        last = {}
        for i in range(at, at + n - 1):
            pair = (int(symbols[i]), int(symbols[i + 1]))
            if last.get(pair) != i - 1:
                found[pair] += 1
                last[pair] = i
        at += n
    return max(found.values(), default=0)


@pytest.mark.parametrize("least", [2, 4])
@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed, least, monkeypatch):
    monkeypatch.setattr(repair, "SHORT", 3)
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 60)
    ids = rng.integers(0, 1 + 3 * seed, int(lengths.sum())).astype(np.uint32)
    if seed == 5:  # copies of whole documents
        lengths, ids = np.tile(lengths, 5), np.tile(ids, 5)
    terminals, left, right, size, symbols, per_doc = repair.compress(ids, lengths, least)
    table = repair.expansions(terminals, left, right, size)
    assert repair.decode(symbols, table).tolist() == ids.tolist()
    assert len(left) and len(symbols) < len(ids) and _most_often(symbols, per_doc) < least
    starts, ends = np.cumsum(per_doc) - per_doc, np.cumsum(per_doc)
    first = np.cumsum(lengths) - lengths
    for d in (0, 17, 59):  # random access to one document
        assert repair.decode(symbols[starts[d]:ends[d]], table).tolist() == ids[first[d]:first[d] + lengths[d]].tolist()
    if seed == 5:
        assert per_doc.max() == 1


def test_grammar_of_a_long_run():
    ids, lengths = np.full(5000, 7, np.uint32), np.array([4999, 1])
    terminals, left, right, size, symbols, per_doc = repair.compress(ids, lengths)
    assert per_doc[0] < 16 and repair.decode(symbols, repair.expansions(terminals, left, right, size)).tolist() == ids.tolist()


def test_id_files(spark, docs, monkeypatch):
    monkeypatch.setattr(repair, "CHARS_PER_SHARD", 2000)
    path = repair.id_file_folder(spark)
    repair.write_ids(docs, path, WORD)
    assert spark.read.parquet(path).count() > 1
    rows = sorted(repair.read_ids(spark, path).collect(), key=lambda r: r.start)
    want, at = [(None, "no id")] + sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda x: x[0]), 0
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    for row, (_, text) in zip(rows, want, strict=True):
        ids = _ids(WORD, text, 2)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), crc32(ids))
        at += len(ids)
    empty = repair.id_file_folder(spark)
    repair.write_ids(docs.limit(0), empty, WORD)
    assert repair.read_ids(spark, empty).count() == 0


def _naive(lengths, capacity):
    rooms, where = [], []
    for size in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms[rooms.index(min(fit))] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 8, 100])
def test_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    lengths = rng.integers(1, capacity + 1, 300)
    window, offset = packing.best_fit_decreasing(lengths, capacity)
    rooms = []
    for w in range(window.max() + 1):
        inside = np.flatnonzero(window == w)
        inside = inside[np.argsort(offset[inside])]
        assert offset[inside].tolist() == (np.cumsum(lengths[inside]) - lengths[inside]).tolist()
        rooms.append(capacity - lengths[inside].sum())
    assert sorted(rooms) == _naive(lengths.tolist(), capacity)


def test_pack(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_CELL", 10)
    rows = packing.pack(docs, BYTE, capacity=64).toPandas()
    assert len(rows[rows.doc_id.eq(3)]) == 2 and rows.doc_id.isna().sum() == 1
    for doc, text in enumerate(TEXTS):
        ids = _ids(BYTE, text, 0)
        mine = rows[rows.doc_id.eq(doc)].drop_duplicates("start").sort_values("start")
        assert mine.doc_tokens.eq(len(ids)).all() and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            assert r.ids_crc32 == crc32(ids[r.start:r.start + r.length])
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 64
    assert packing.pack(docs.limit(0), BYTE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTE, capacity=0)


def test_encoding_gives_back_what_each_slice_took(monkeypatch):
    class Pool:
        given_back = 0

        def release_unused(self):
            Pool.given_back += 1

    text = pa.array([f"some words {i} of a text" for i in range(50)], pa.large_string())
    ((_, whole, sizes),) = encoding.encoded(text, BYTE, True, 0)
    monkeypatch.setattr(encoding, "SLICE_BYTES", 200)
    monkeypatch.setattr(encoding.pa, "default_memory_pool", Pool)
    found = list(encoding.encoded(text, BYTE, True, 0))
    assert len(found) > 3 and Pool.given_back == len(found)
    assert (np.concatenate([f[1] for f in found]) == whole).all() and (np.concatenate([f[2] for f in found]) == sizes).all()


def test_words_of_letters_are_encoded_as_one_text(monkeypatch):
    store, real = encoding._load(WORD)
    asked = []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **options)

    texts = ["Some wörds of letters and Überraschung, ΣΑΣ 中文", "and2 don't qwrtz. letters ǅ éa", *(t or "" for t in TEXTS)]
    for name, value in {"tokenizer": Spy(), "words": pa.array([], pa.large_string()), "flat": np.zeros(0, "<u4"), "sizes": np.zeros(0, np.int64)}.items():
        monkeypatch.setitem(store, name, value)
    for ends in (store["ends"], np.ones_like(store["ends"])):  # the second cannot tell words apart: they are encoded one by one
        monkeypatch.setitem(store, "ends", ends)
        monkeypatch.setitem(store, "words", pa.array([], pa.large_string()))
        monkeypatch.setitem(store, "flat", np.zeros(0, "<u4"))
        monkeypatch.setitem(store, "sizes", np.zeros(0, np.int64))
        asked.clear()
        ((_, ids, lengths),) = encoding.encoded(pa.array(texts, pa.large_string()), WORD, False, 2)
        for mine, text in zip(np.split(ids, np.cumsum(lengths)[:-1]), texts, strict=True):
            assert mine.tolist() == _ids(WORD, text, 2).tolist(), text
        assert ("letters" in asked) == bool(ends.all()) and any(" letters " in t for t in asked)
        asked.clear()
        ((_, again, _),) = encoding.encoded(pa.array(texts, pa.large_string()), WORD, False, 2)
        assert again.tolist() == ids.tolist() and not any(asked)


def test_pairs_are_binned_in_32_bits(monkeypatch):
    """Of a shard only pairs in crowded bins get 64 bits; symbols, which are half as large, take part whole."""
    rng = np.random.default_rng(1)
    ids, wide = rng.integers(0, 40_000, 100_000).astype(np.uint32), []
    ids[:600] = np.tile([5, 9, 11], 200)
    counted = repair._apart
    monkeypatch.setattr(repair, "_apart", lambda pairs, at: wide.append(len(pairs)) or counted(pairs, at))

    class Numpy:
        def __getattr__(self, name):
            return getattr(np, name)

        @staticmethod
        def bincount(values, **options):
            if options.get("minlength") == 1 << repair._BIN_BITS:
                assert values.dtype == np.uint32
            return np.bincount(values, **options)

    monkeypatch.setattr(repair, "np", Numpy())
    terminals, left, right, size, symbols, _ = repair.compress(ids, np.array([100_000]))
    assert wide[0] < 1000
    assert repair.decode(symbols, repair.expansions(terminals, left, right, size)).tolist() == ids.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_grammar_of_units(seed):
    """Units found often become one symbol before the documents' pairs are counted; the end is that of a grammar of ids."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 80)
    flat, full = rng.integers(0, 9, int(sizes.sum())).astype(np.uint32), np.flatnonzero(sizes)
    per_doc = rng.integers(1, 30, 60)
    codes = rng.choice(full, int(per_doc.sum()), p=(w := 1 / np.arange(1, len(full) + 1)) / w.sum())
    pieces = np.split(flat, np.cumsum(sizes)[:-1])
    docs = [np.concatenate([pieces[c] for c in d]) for d in np.split(codes, np.cumsum(per_doc)[:-1])]
    terminals, left, right, size, symbols, each = repair.compress_units(codes, per_doc, flat, sizes)
    table = repair.expansions(terminals, left, right, size)
    at = np.cumsum(each)[:-1]
    for got, want in zip(np.split(symbols, at), docs, strict=True):
        assert repair.decode(got, table).tolist() == want.tolist()
    assert len(left) and _most_often(symbols, each) < repair.LEAST


def test_rounds_number_only_new_pairs(monkeypatch):
    """Places are looked at again where a neighbour was replaced, not in every round."""
    rng, looked = np.random.default_rng(2), []
    ids = np.minimum(rng.zipf(1.3, 50_000), 3000).astype(np.uint32)
    real = repair._numbered
    monkeypatch.setattr(repair, "_numbered", lambda symbols, at, *rest: looked.append(len(at)) or real(symbols, at, *rest))
    terminals, left, right, size, symbols, _ = repair.compress(ids, np.array([50_000]))
    assert repair.decode(symbols, repair.expansions(terminals, left, right, size)).tolist() == ids.tolist()
    assert len(looked) > 4 and sum(looked) < len(ids) + 2 * (len(ids) - len(symbols))


@pytest.mark.parametrize(("path", "byte_level"), [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("cached", [0, 400_000])
def test_units_equal_direct_encoding(path, byte_level, cached, monkeypatch):
    monkeypatch.setattr(encoding, "CACHED_WORDS", cached)
    units = encoding.Units(path, byte_level, 2)
    for texts in (TEXTS, ["signs%%% after,$$$ wörds!? it's.** <|endoftext|>.", "", "x" * 50], TEXTS[::-1]):
        codes, per_doc, n_ids = units.code(pa.array([t or "" for t in texts], pa.large_string()))
        flat, sizes = units.ids()
        got = np.split(repair._ranges(flat, sizes, codes), np.cumsum(sizes[codes])[np.cumsum(per_doc) - 1][:-1])
        assert n_ids == sum(map(len, got))
        for mine, text in zip(got, texts, strict=True):
            assert mine.tolist() == _ids(path, text, 2).tolist(), text
        units.release()
        assert byte_level or len(encoding._load(path)[0]["words"]) <= cached


@pytest.mark.parametrize(("path", "byte_level"), [(WORD, False), (BYTE, True)])
def test_id_files_of_many_shards_in_a_task(spark, docs, path, byte_level, monkeypatch):
    """A shard that is full is written before the slice that did not fit, whose units are coded anew."""
    monkeypatch.setattr(repair, "IDS_PER_SHARD", 40)
    monkeypatch.setattr(repair, "SLICE_BYTES", 30)
    monkeypatch.setattr(repair, "IDS_AT_ONCE", 10)
    folder = repair.id_file_folder(spark)
    repair.write_ids(docs, folder, path, byte_level)
    rows = sorted(repair.read_ids(spark, folder).collect(), key=lambda r: r.start)
    want, at = [(None, "no id")] + sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda x: x[0]), 0
    for row, (doc, text) in zip(rows, want, strict=True):
        ids = _ids(path, text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), crc32(ids))
        at += len(ids)
    assert spark.read.parquet(folder).count() > 3
