"""The operators on small fixtures, against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tabprep.llm import deobfuscation, forest, maxent, mixing, near, preference, ranking, repetition
from tabprep.llm.components import components

ROWS = [
    (1, "alpha beta gamma delta " * 20, "en"), (2, None, "en"), (3, "", "de"), (4, "word", None), (5, "word", "en"),
    (6, " ".join(f"w{i}" for i in range(3000)), "en"), (7, "Line one here\nLine one here\nother &&& line", "de"),
    (7, "Line one here\nLine one here\nother &&& line", "de"), (None, "no id at all", "en"), (8, "same same same same", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 5, True) for r in ROWS], "doc_id long, text string, lang string, n_words int, kept boolean")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repetition(text, least):
    w = words(text)
    n, best, cover, windows = len(w), 0, set(), set()
    for size in range(n - 1, 2, -1):
        times = Counter(tuple(w[i:i + size]) for i in range(n - size + 1))
        for i in range(n - size + 1):
            if times[tuple(w[i:i + size])] > 1:
                if size >= least:
                    cover.update(range(i, i + size))
                    best = max(best, size)
                if size == 3:
                    windows.update(range(i, i + 3))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(windows), len(cover), best


@pytest.mark.parametrize("seed", range(6))
def test_repetition_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 2 + seed, rng.integers(0, 40))) for _ in range(20)] + ["a b c d e f " * 6, "x", ""]
    got = np.stack(repetition._measures(pa.array(texts, pa.large_string()), 4), 1)
    assert got.tolist() == [list(brute_repetition(t, 4)) for t in texts]


def test_repetition_query(docs):
    rows = repetition.apply_rules(docs, prefix="m_").collect()
    assert len(rows) == len(ROWS) and sum(r.doc_id == 7 for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[1].m_n_words == 80 and by[1].m_base_failed and not by[1].m_kept and by[6].m_kept and by[2].m_n_words == 0
    with pytest.raises(ValueError):
        repetition.apply_rules(docs)
    assert repetition.apply_rules(docs.select("doc_id", "text").limit(0)).count() == 0


def test_repetition_rejects_what_the_base_passes(spark):
    fresh = [f"u{i}" for i in range(100)]
    copied = fresh[:25] + fresh[50:100] + fresh[:25]
    several = fresh[:9] + fresh[10:19] + fresh[36:] + fresh[10:19] + fresh[:9]
    one_word = fresh[:40] + ["same"] * 25 + fresh[40:75]
    few = fresh[:10] + fresh[20:100] + fresh[:10]
    texts = {1: copied, 2: several, 3: one_word, 4: few, 5: fresh}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.covered_words, r.longest_repeat, r.base_failed, r.kept) for r in repetition.apply_rules(docs).collect()}
    for i, t in texts.items():
        n, *_, cover, best = brute_repetition(" ".join(t), 8)
        assert got[i] == (n, cover, best, False, cover <= 0.3 * n and best <= 0.2 * n)
    assert [got[i][4] for i in sorted(texts)] == [False, False, False, True, True]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (2, 1), (8, 8)] + [(i + 1, i) for i in range(20, 40)]
    found = {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {2: 1, 3: 1, 4: 1, 5: 1, 9: 8, **{i: 20 for i in range(21, 41)}}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 500, 80)]
    rows = [(100 - i, " ".join(base[:40 + i] if i % 3 else base[i // 2:])) for i in range(40)]
    rows += [(200 + i, " ".join(f"q{x}" for x in rng.integers(0, 50, 30))) for i in range(20)]
    rows += [(300, rows[0][1]), (301, "one"), (302, "ONE"), (303, ""), (304, None), (None, "one"), (305, "x y"), (305, "one")]
    got = near.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int"), words=2)
    got = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = words((t or "").lower())
        sets[i] = (d, {tuple(w[j:j + 2]) for j in range(max(1, len(w) - 1))} if w else set())
    root = {d: d for d, _ in sets.values() if d is not None}

    def top(x):
        return x if root[x] == x else top(root[x])

    for d, s in sets.values():
        for e, t in sets.values():
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    assert {d: r.component_id for d, r in got.items()} == {d: top(d) for d in root}
    assert got[303].n_shingles == 0 and got[301].n_shingles == 1 and got[302].kept is False


def test_pruning_bound():
    for n in (30, 150):
        m = near.least_matches(n, 0.8, 1e-5)
        assert 0.4 * n < m < 0.8 * n


def test_ranking(spark):
    good = [(i, f"A plain sentence with number of words {i} in it, and more.", 1) for i in range(60)]
    bad = [(100 + i, f"buy!! $$$ NOW {i}### *** " * 8, 0) for i in range(20)]
    docs = spark.createDataFrame(good + bad + [(500, None, 1)], "doc_id long, text string, quality int")
    model = ranking.fit(docs, docs.select("doc_id", "quality").union(docs.selectExpr("null", "7").limit(1)))
    rows = model.score(docs).collect()
    assert all((r.score >= 0.7) == (r.quality == 1) for r in rows if r.doc_id != 500)
    assert model.score(docs, only_passing=True).columns == docs.columns
    empty = ranking.fit(docs, docs.select("doc_id", "quality").limit(0))
    assert empty.score(docs).filter("score >= 0.69").count() == 81


def test_deobfuscation(spark):
    clean = [(i, f"you are an owner and we read page {i} today by the nice river what", 0) for i in range(60)]
    bad = [(100 + i, f"you are an idiot and we read page {i} today", 1) for i in range(30)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    model = deobfuscation.fit(docs, docs.select("doc_id", "toxic"))
    for written in ("1d10t", "iiidiiiooot", "i.d.i.o.t", "IDIOT!!!", "id!ot"):
        probe = spark.createDataFrame([(1, f"what an {written} today"), (2, "what a nice river"), (3, None), (4, "i d i o t"), (5, "")], "doc_id long, text string")
        got = {r.doc_id: r.score >= 0.7 for r in model.score(probe).collect()}
        assert got == {1: True, 2: False, 3: False, 4: True, 5: False}, written
    nothing = deobfuscation.fit(docs, docs.select("doc_id", "toxic").limit(0))
    assert nothing.score(docs).filter("score >= 0.7").count() == 0


def test_deobfuscation_at_edges_apart_and_doubled(spark):
    clean = [(i, f"you are an owner and we read page {i} today by the nice river what", 0) for i in range(60)]
    bad = [(100 + i, f"you are an {('idiot', 'scum', 'ass')[i % 3]} and we read page {i} today", 1) for i in range(60)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    model = deobfuscation.fit(docs, docs.select("doc_id", "toxic"))
    disguised = ["!diot", "$cum", "a$$", "($cum!)", "i d ! o t", "! d i o t !", "$ c u m", "a s s", "a $ $", "@ $ $", "iidiiott", "sccuumm"]
    harmless = ["river!", "nice!!", "(today)", "$page", "owner$", "read|", "what?!", "! ! !", "a b", "well", "good!"]
    probe = [(i, f"what an {w} today") for i, w in enumerate(disguised + harmless)]
    got = {r.doc_id: r.score >= 0.7 for r in model.score(spark.createDataFrame(probe, "doc_id long, text string")).collect()}
    assert [w for i, w in enumerate(disguised + harmless) if got[i]] == disguised


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, [1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.search(data, data.filter("vec_id % 20 = 0"), k=5, recall=0.97).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(400), -s))[:5]
        part = part.sort_values("rank")
        assert np.allclose(part.score, s[part.vec_id]) and len(part) == 5
        hits += len(set(true) & set(part.vec_id))
    assert got.query_id.nunique() == 20 and hits >= 90
    assert forest.search(data.limit(0), data).count() == 0


def test_preference(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"),
        (1, "rejected", 2, None, None), (2, "chosen", 0, "user", "x"), (3, "chosen", 0, "a", "s"), (3, "rejected", 0, "a", "s"),
    ]
    got = {r.pair_id: r for r in preference.preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|user|>\nhi\n" and got[1].chosen == "<|assistant|>\nyes\n"
    a, b = map(int, got[1].chosen_mask.split("-"))
    assert got[1].chosen[a:b] == "yes\n" and got[1].rejected == "<|assistant|>\nno\n<||>\n\n"
    assert got[2].n_common == 0 and got[2].chosen == "<|user|>\nx\n" and got[2].rejected == "" and got[3].chosen == "" and got[3].n_common == 1


def test_mixing_against_numpy(spark):
    rows = [(i, ("aaa abab " if i % 4 else "zzz zyzy ") * (1 + i % 5), "a" if i % 4 else "z") for i in range(80)] + [(None, None, None), (99, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.mixing_rates(docs, docs.select("doc_id", "domain"), {"a": 0.5, "z": 0.5}).toPandas()
    p, n, r = got[["p_a", "p_z"]].to_numpy(), got.n_tokens.to_numpy(float), got.rate.to_numpy()
    reached = (p * (n * r)[:, None]).sum(0) / n.sum()
    assert np.allclose(reached, 0.5, atol=1e-3) and (r >= 0).all() and len(got) == 82
    assert sorted(n) == sorted(len(words(t)) for _, t, _ in rows)
    assert set(mixing.mix(docs, docs.select("doc_id", "domain"), {"a": 0.5, "z": 0.5}).columns) == set(docs.columns)


def test_language_model(spark):
    rows = [(i, " ".join(["The cat sat down." if i % 2 else "a dog ran off!"] * (i % 7))) for i in range(40)] + [(None, None), (77, "unseen thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tabprep.llm.common import crc_remainder

    got = {r.doc_id: r for r in maxent.score(docs, crc_remainder("doc_id", 7) == 2).collect()}
    import zlib

    counts = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*words((t or "").lower()), None])
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        tokens = [*words((t or "").lower()), None]
        assert got[d].n_tokens == len(tokens) and got[d].train_tokens == n and got[d].n_known == sum(w in counts for w in tokens)
        assert np.isclose(got[d].base_score, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_links_between_components_in_blocks(spark, monkeypatch):
    """Nodes just below the bound to the middle of their group, with few links among themselves, over many small blocks."""
    monkeypatch.setattr(near, "BLOCK_BYTES", 40_000)
    rng = np.random.default_rng(8)
    base = [f"t{x}" for x in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(120, 3 + i % 4, replace=False):
            copy[at] = f"n{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    called = []
    blocks = near._linked_in_blocks
    monkeypatch.setattr(near, "_linked_in_blocks", lambda *a: called.append(blocks(*a)) or called[-1])
    got = {r.doc_id: r.component_id for r in near.near_duplicates(docs, words=2).collect()}
    sets = [{*zip(t.split(), t.split()[1:], strict=False)} for _, t in rows]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < 150
    assert called[0].count() > 0


def test_character_shares(spark):
    texts = ["abba äöä ß", "", "ABBA", "é́é 中文 🇫🇷 z\n\tz", "x" * 100]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows.select("i", *[s.alias(f"x{k}") for k, s in enumerate(mixing._shares(rows["text"]))]).collect()
    for r in got:
        t = texts[r.i]
        assert list(r[1:]) == pytest.approx([t.count(c) / max(len(t), 1) for c in mixing.CHARACTERS])


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"ein kleiner Text über {i}" if i % 2 else f"a small text of {i}", "de" if i % 2 else "en", 7, "kept", 1.5) for i in range(40)]
    rows += [(100, None, None, 7, "kept", 1.5), (101, "", None, 7, "kept", 1.5), (None, "no id", None, 7, "kept", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, _copies int, _clean string, _n_tokens double")
    out = mixing.mix(docs, docs.select("doc_id", "domain"), {"en": 0.5, "de": 0.5})
    assert out.columns == docs.columns
    found = out.collect()
    assert {(r._copies, r._clean, r._n_tokens) for r in found} == {(7, "kept", 1.5)}
    rated = {r.doc_id: r.copies for r in mixing.mixing_rates(docs, docs.select("doc_id", "domain"), {"en": 0.5, "de": 0.5}).collect()}
    assert len(found) == pytest.approx(sum(rated.values()), abs=4)
    assert mixing.mix(docs.limit(0), docs.select("doc_id", "domain"), {"en": 1.0}).count() == 0


def test_slices_of_text_hold_their_own_rows():
    import pyarrow as pa
    import pyarrow.compute as pc

    from tabprep.llm.common import text_slices, words_of

    for missing in (7, 10**9):
        texts = [None if i % missing == 3 else "é" * (i % 6) + f"W{i} x" for i in range(500)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        found = []
        for _, (part,) in text_slices(batch, 200, 13):
            codes, offsets, known = words_of(pc.ascii_lower(part))
            known = known.to_pylist()
            found += [[known[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert found == [(t or "").replace("W", "w").split() for t in texts]


def test_preference_pairs_from_tables_with_any_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (2, 0, "user", None), (None, 0, "assistant", "x")]
    kinds = "conv_id long, turn int, role string, text string, _id int, _last string, side int, _end int, _other int, pair_id int"
    turns = spark.createDataFrame([(*r, 5, "kept", 6, 7, 8, 9) for r in rows], kinds)
    got = sorted((r.pair_id or 0, r.side, r.turn, r.text or "") for r in preference.own_reply_pairs(turns).collect())
    assert [g for g in got if g[0] == 1] == [
        (1, "chosen", 0, "hi"), (1, "chosen", 1, "a"), (1, "chosen", 2, "more"), (1, "chosen", 3, "b"),
        (1, "rejected", 0, "hi"), (1, "rejected", 1, "a"), (1, "rejected", 2, "more"), (1, "rejected", 3, "a"),
    ]
    assert [g[3] for g in got if g[0] == 0] == ["x", ""] and len(got) == 12
    assert preference.own_reply_pairs(turns.limit(0)).count() == 0


def _best_spelling(written, model, gaps):
    """All paths through the lattice, one after the other."""
    paths = [(0.0, "  ", "")]
    for k, options in enumerate(deobfuscation.lattice(written)):
        longer = []
        for score, state, text in paths:
            starts = [(score, state, text)]
            if gaps and k:
                starts.append((score + model.log(state, " "), "  ", text + " "))
            for value, at, so_far in starts:
                for letters, cost in options:
                    total, now = value + cost, at
                    for letter in letters:
                        total += model.log(now, letter)
                        now = now[1] + letter
                    longer.append((total, now, so_far + letters))
        paths = longer
    return max(score + model.log(state, " ") for score, state, _ in paths), {s + model.log(t, " "): x for s, t, x in paths}


def _letters():
    grams = Counter()
    for word in "you are an idiot and we read the page today by a nice river what scum all ill".split():
        edged = f"  {word} "
        for i in range(2, len(edged)):
            for k in (0, 1, 2):
                grams[edged[i - 2:i + 1][k:]] += 1
    return deobfuscation.LetterModel(dict(grams))


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("held", [1, 3, 256])
def test_decoding_against_all_paths(gaps, held):
    model, rng = _letters(), np.random.default_rng(held)
    for written in ["1d10t", "!d!ot", "$cum", "a11", "", "...", *("".join(rng.choice(list("idot10!$.a"), rng.integers(1, 7))) for _ in range(40))]:
        best, texts = _best_spelling(written, model, gaps)
        got = deobfuscation.decode(written, model, gaps, held)
        assert got in {t for s, t in texts.items() if s >= best - 1e-9}, written


def test_decoding_of_long_words_is_cut_where_paths_meet():
    model, rng = _letters(), np.random.default_rng(2)
    word = "".join(rng.choice(list("idot10!$.a3rv4"), 3000))
    for gaps in (False, True):
        assert len({deobfuscation.decode(word, model, gaps, held) for held in (1, 50, 256, 10**9)}) == 1
    kept = []
    settled = deobfuscation._settled
    deobfuscation._settled = lambda back, best: kept.append(len(back)) or settled(back, best)
    try:
        deobfuscation.decode(word * 5, model)
    finally:
        deobfuscation._settled = settled
    assert kept and max(kept) <= 512  # back pointers held at once, whatever the length


def test_toxicity_of_long_null_and_empty_texts(spark):
    rows = [(i, f"you are an {'idiot' if i % 2 else 'owner'} and we read page {i}", i % 2) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, "x1" * 30_000, 0), (3, rows[3][1], 1), (None, "no id", 0)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, toxic int, y int, half string")
    model = deobfuscation.fit(docs, docs.select("doc_id", "toxic"))
    found = model.score(docs).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert not [r.doc_id for r in found if r.doc_id in (100, 101, 102) and r.score >= 0.7]
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    assert model.score(docs.limit(0)).count() == 0


def test_models_learn_from_all_labelled_documents(spark):
    from tabprep.llm import common

    docs = spark.range(20_500).selectExpr("id AS doc_id", "'a b' AS text")
    labels = spark.range(20_500).selectExpr("id AS doc_id", "id % 2 AS quality").union(spark.sql("SELECT 7L, 0L UNION ALL SELECT 3L, 9L UNION ALL SELECT null, 1L"))
    rows = common.labelled(docs, labels, "quality")
    assert rows.count() == 20_500 and rows.filter("y = 1").count() == 10_250


def test_labels_meet_features_and_no_text_is_shuffled(spark, monkeypatch):
    from tabprep.llm import common

    rows = [(i, f"plain words number {i} here" if i % 3 else f"buy!! $$$ {i} ###", int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (3, "again", 1), (None, "no id", 0), (90, None, 1)], "doc_id long, text string, quality int")
    seen = []
    monkeypatch.setattr(ranking, "labelled", lambda docs, *rest: seen.append(docs.columns) or common.labelled(docs, *rest))
    model = ranking.fit(docs, docs.select("doc_id", "quality"))
    assert seen == [["doc_id", "features"]]
    whole, measured = model.score(docs).select("doc_id", "score"), model.score_measured(ranking.measured(docs))
    order = lambda d: sorted(((-1 if r.doc_id is None else r.doc_id), r.score) for r in d.collect())
    assert np.allclose(order(whole), order(measured))


def test_labelled_texts_are_filtered_before_the_shuffle(spark, tmp_path, monkeypatch):
    from tabprep.llm import common
    from tabprep.storage import settings

    spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/docs")
    spark.range(0, 3000, 10).selectExpr("id AS doc_id", "CAST(id % 20 = 0 AS INT) AS toxic").write.parquet(f"{tmp_path}/labels")
    docs, labels = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/labels")
    plans, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = common.labelled_texts(docs, labels, "toxic")
    assert "might_contain" in plans[-1]
    assert sorted(found.collect()) == [(i, f"text {i}", int(i % 20 == 0)) for i in range(0, 3000, 10)]
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") != "0"


def test_language_model_tells_words_of_one_class_apart(spark):
    from pyspark.sql import functions as F

    assert maxent.word_class("xabc") == maxent.word_class("yabc") and maxent.word_class("dog") != maxent.word_class("cat")
    rows = [(i, "xabc dog" if i % 2 else "yabc cat") for i in range(400)]
    rows += [(i, f"{'xabc' if i % 2 else 'yabc'} of {'dog' if i % 2 else 'cat'}") for i in range(400, 800)]
    asked = {1000: "xabc dog", 1001: "xabc cat", 1002: "yabc cat", 1003: "yabc dog", 1004: "xabc of dog", 1005: "xabc of cat"}
    docs = spark.createDataFrame([*rows, *asked.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in maxent.score(docs, F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001] + 0.1 and got[1002] > got[1003] + 0.1
    assert got[1004] > got[1005] + 0.1


def test_training_steps_reduce_only_buckets_of_many_tokens(monkeypatch):
    """Sums of buckets are those of adding token by token, and a bucket of one token is not reduced."""
    rng = np.random.default_rng(3)
    off = rng.normal(size=(200, maxent.CLASSES)).astype(np.float32)
    rows = np.stack([rng.integers(0, 5, 200), rng.integers(0, 400, 200), np.arange(1000, 1200)], 1)
    want = np.zeros((1200, maxent.CLASSES), np.float32)
    for row, o in zip(rows, off, strict=True):
        for b in row:
            want[b] += o
    reduced = []

    class Add:
        @staticmethod
        def reduceat(values, starts):
            reduced.append(len(starts))
            return np.add.reduceat(values, starts)

    class Numpy:
        add = Add

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(maxent, "np", Numpy())
    bucket, total = maxent.bucket_sums(off, rows)
    assert bucket.tolist() == sorted({*rows.ravel().tolist()}) and np.allclose(total, want[bucket], atol=1e-4)
    assert sum(reduced) == (np.bincount(rows.ravel()) > 1).sum() < len(bucket) // 2


def test_classes_are_those_of_each_word(monkeypatch):
    import pyarrow as pa

    known = ["cat", "at", "", "ünä", "xünä", "中文字", "a中文字", "the", "bathe", "🇫🇷z"]
    of, asked = maxent.word_class, []
    monkeypatch.setattr(maxent, "word_class", lambda w: asked.append(w) or of(w))
    _, _, hashes = maxent.coded(np.arange(len(known)), np.array([0, len(known)]), pa.array(known, pa.large_string()))
    assert (hashes & maxent.CLASSES - 1).tolist() == [*map(of, known), 0]
    assert len(asked) == len(set(w[-3:] for w in known)) < len(known)
    assert len(maxent.coded(np.zeros(0, int), np.array([0, 0]), pa.array([], pa.large_string()))[2]) == 1
