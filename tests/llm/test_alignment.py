"""Cross-tokenizer alignment against direct encoding of whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabprep.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words, and punctuation... don't! 12345 x=y;", None, "", " ", "   ", "\n", "lead  double  blanks ", "  two before",
    "tabs\tand\nlines\n\nhere \n there", "naïve café — “quotes” … €5  nbsp 　wide  line", "日本語のテキスト 中文 한국어",
    "emoji 👩‍👩‍👧 flags 🇫🇷 x", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ marks a blank here", "a\x00b \x1c c \x85 d", "combining é ́x",
    "the the the the", "the the the the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " + "=" * 300, "http://example.org/a_b?c=d#e --- ###",
    "\r\nCRLF\r\n", "x" * 5000, "word " * 3000, "Ünïcödé " * 50,
]


def direct(texts):
    """The contract in plain loops over whole texts."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    of, entries = alignment.byte_characters(), {i: t for t, i in tokenizer.get_vocab().items()}
    docs = []
    for text in texts:
        groups = []
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(of[c] for c in entries[i])) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, found = 0, []
                    for i, x in side:
                        at += len(x)
                        found.append((at, i))
                    ends.append(found)
                common, start = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}), 0
                for end in common:
                    groups.append([[i for e, i in side if start < e <= end] for side in ends])
                    start = end
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(x, y) for a, b in groups for x in a for y in b})
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    for groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(line.encode()).hexdigest() if groups else "",
        )


def test_byte_characters():
    of = alignment.byte_characters()
    assert sorted(of.values()) == list(range(256)) and of["Ġ"] == 32 and of["Ċ"] == 10 and of["a"] == 97


def test_units_join_to_their_text():
    texts = [t for t in TEXTS if t]
    lists = alignment.units_of(pa.array(texts, pa.large_string())).to_pylist()
    assert [" ".join(u) for u in lists] == texts
    assert lists[texts.index("lead  double  blanks ")] == ["lead  double  blanks "]


@pytest.mark.parametrize("lookup_rows", [alignment.LOOKUP_ROWS, 40, 1])
def test_against_direct_encoding(spark, lookup_rows):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(None, "the end", "", 0), (3, "the start of the end", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n_a int").repartition(5)
    got = alignment.align(docs, A, B, lookup_rows=lookup_rows).collect()
    want = [(r[0], *v) for r, v in zip(rows, direct([r[1] for r in rows]))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert [c for c in alignment.align(docs, A, B).columns] == [c.split()[0] for c in alignment.COLUMNS.split(", ")]


def test_small_parts(monkeypatch):
    text = pa.array([t or "" for t in TEXTS], pa.large_string())
    whole = alignment.align_texts(text, alignment.byte_level(A), alignment.pieces(B))
    monkeypatch.setattr(alignment, "WRITTEN_UNITS", 7)
    monkeypatch.setattr(alignment, "CACHED_UNITS", 3)
    alignment.worker_store("alignment units").clear()
    for i in range(len(TEXTS)):
        alone = alignment.align_texts(text.slice(i, 1), alignment.byte_level(A), alignment.pieces(B))
        for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
            assert alone[name][0] == whole[name][i]
        links = [Counter(dict(zip(zip(r["a"][k].as_py(), r["b"][k].as_py()), r["links"][k].as_py()))) for r, k in ((alone, 0), (whole, i))]
        assert links[0] == links[1] and sum(links[0].values()) == whole["n_links"][i].as_py()


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, "")], schema), A, B).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query_on_the_smallest_table(spark):
    from tabprep.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_arrow_alignment"](spark, folder).collect()}
    assert got == dict(zip([r.doc_id for r in rows], direct([r.text for r in rows])))
