"""The pipeline's stages in turn on the smallest tables, and each stage's decisions against brute force."""

import re
from collections import Counter
from zlib import crc32

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabprep.llm import mixing, ranking
from tabprep.llm.common import materialize, table

FOLDER = "/root/testdata/sf0.001"
#: Columns of ``documents`` that the stages read, and names that the stages use for themselves.
SCHEMA = "text string, doc_id long, lang string, _rows int, _rule_kept boolean, kept boolean, score double, copies int, _copies int, component_id long"
EXTRA = (3, False, False, 0.25, 9, 8, -1)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _texts():
    rng = np.random.default_rng(4)
    plain = [[f"word{x}" for x in rng.integers(0, 4000, 120)] for _ in range(12)]
    texts = [" ".join(w) for w in plain]
    texts += [" ".join([*plain[0][:60], "changed", *plain[0][61:]]), " ".join(plain[1]).upper(), " ".join(plain[2][:80])]
    texts += [" ".join(plain[3][:30] * 3 + plain[4]), " ".join(plain[5][:10] * 9), "too short", "", None, " ".join(plain[6] * 2)]
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 90_000, 30_000))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(t, i, "en" if i % 3 else "de", *EXTRA) for i, t in enumerate(texts)]
    rows += [(texts[7], 7, "en", *EXTRA), (texts[8], None, None, *EXTRA), (None, None, "de", *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


def _same_columns(out, docs):
    assert out.columns == docs.columns
    assert {tuple(r)[3:] for r in out.collect()} <= {EXTRA}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, FOLDER))
        assert docs.columns == columns and 0 < docs.count() < before
        assert docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    docs = materialize(corpus_pipeline.mix_languages(spark, docs, FOLDER))
    assert docs.columns == columns
    packed = corpus_pipeline.pack(spark, docs, FOLDER)
    assert packed.filter("start = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").isEmpty()


def test_quality_keeps_what_scores_well(spark, docs):
    """Passing is the logistic of the weighted features against the threshold, worked out here row by row."""
    out = corpus_pipeline.quality(spark, docs, FOLDER)
    _same_columns(out, docs)
    model = ranking.fit(docs, table(spark, FOLDER, "labels"))
    import pyarrow as pa

    rows = docs.select("doc_id", "text").collect()
    x = ranking.text_features(pa.array([r.text or "" for r in rows], pa.large_string()))
    z = x @ np.array(model.weights) - model.threshold
    want = Counter((r.doc_id, r.text) for r, v in zip(rows, z, strict=True) if v >= -1e-12)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def _repetition_verdict(text):
    w = words(text)
    n = len(w)

    def twice(size):
        seen = Counter(tuple(w[i:i + size]) for i in range(n - size + 1))
        return [i for i in range(n - size + 1) if seen[tuple(w[i:i + size])] > 1]

    near = {j for i in twice(3) for j in range(i, i + 3)}
    covered = {j for i in twice(8) for j in range(i, i + 8)}
    longest = next((k for k in range(n - 1, 7, -1) if twice(k)), 0) if covered else 0
    return n >= 50 and 100 * len(near) <= 50 * n and len(covered) <= 0.3 * n and longest <= 0.2 * n


def test_rules_against_brute_force(spark, docs):
    out = corpus_pipeline.repetition_rules(spark, docs, FOLDER)
    _same_columns(out, docs)
    want = Counter((r.doc_id, r.text) for r in docs.collect() if _repetition_verdict(r.text))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want and 0 < sum(want.values()) < docs.count()


def test_one_of_each_against_brute_force(spark, docs):
    out = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    _same_columns(out, docs)
    sets = {}
    for r in docs.filter("doc_id IS NOT NULL").collect():
        w = words((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = [r.doc_id for r in out.collect()]
    assert sorted(d for d in got if d is not None) == sorted(d for d, r in root.items() if d == r) and got.count(None) == 2
    assert len(set(root.values())) < len(root)


def test_mixing_copies_by_rate(spark, docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", {"en": 0.5, "de": 0.5})
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs.select("doc_id"))
    out = corpus_pipeline.mix_languages(spark, docs, FOLDER)
    _same_columns(out, docs)
    labelled = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id", "lang AS domain")
    rated = mixing.mixing_rates(docs, labelled, {"en": 0.5, "de": 0.5}).filter("doc_id IS NOT NULL").groupBy("doc_id").agg({"rate": "sum", "*": "count"}).collect()
    made = Counter(r.doc_id for r in out.collect())
    for r in rated:
        assert abs(made[r.doc_id] - r["sum(rate)"]) < r["count(1)"] + 1e-6


def test_packing_against_direct_encoding(spark, docs):
    pieces = corpus_pipeline.pack(spark, docs, FOLDER).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for doc_id, text in {r for r in rows if r[0] is not None}:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = pieces[pieces.doc_id.eq(doc_id)].sort_values(["start", "sequence_id"])
        copies = sum(d == doc_id for d, _ in rows)
        assert mine.length.sum() == copies * len(ids) and mine.doc_tokens.eq(len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == crc32(ids[p.start:p.start + p.length])
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024
    assert pieces[pieces.start.eq(0)].shape[0] == len(rows)


def test_stages_on_an_empty_table(spark, docs):
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0, name
