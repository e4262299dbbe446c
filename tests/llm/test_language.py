"""Codewords, letter n-grams and decoding against plain versions; held-out accuracy; odd tables."""

import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tabprep.llm import language


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6, 7, 12, 40])
def test_codewords(k):
    codes = language.codewords(k)
    assert codes.shape[0] == k
    if k > 1:
        columns = {tuple(c ^ c[0]) for c in codes.T}
        assert len(columns) == codes.shape[1] and all(0 < c.sum() < k for c in codes.T)
        apart = min(int((a != b).sum()) for a, b in combinations(codes, 2))
        assert apart == language.least_distance(codes) and apart >= (1 if k < 4 else codes.shape[1] / 5)


def plain_grams(text):
    """Number of n-grams of each run of letters and marks, and how often each (n, gram) is there."""
    found = Counter()
    for word in text.split():
        word = unicodedata.normalize("NFC", word.lower())
        runs = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in word).split()
        padded = f" {' '.join(runs)} " if runs else ""
        for n in language.ORDERS:
            for i in range(len(padded) - n + 1):
                gram = padded[i:i + n]
                if (n == 1 and gram != " ") or (n > 1 and " " not in gram[1:-1]):
                    found[gram] += 1
    return found


def test_letter_grams_against_brute_force():
    texts = ["Ab, cd's x", "", "123 !!", "É́té été ÉTÉ", "日本語 テキスト a", "a b\nc\td", "no " * 50]
    grams = language.letter_grams(pa.array(texts, pa.large_string()))
    assert grams.letters.tolist() == [True, False, False, True, True, True, True]
    seen = {}
    for i, t in enumerate(texts):
        plain = plain_grams(t)
        assert grams.per_text[i] == sum(plain.values())
        times = np.zeros(language.BUCKETS)
        for w in grams.codes[grams.offsets[i]:grams.offsets[i + 1]]:
            times += np.bincount(grams.bucket[grams.word == w], minlength=language.BUCKETS)
        assert sorted(times[times > 0]) == sorted(plain.values())  # no two grams of these texts share a bucket
        for gram in plain:
            one = language.letter_grams(pa.array([gram], pa.large_string())) if gram.strip() == gram and len(gram) == 1 else None
            if one is not None:
                seen.setdefault(gram, int(one.bucket[0]))
    assert len(set(seen.values())) == len(seen)


def test_fit_logistic():
    z = np.linspace(-3, 3, 61)
    p = 1 / (1 + np.exp(-(2 * z - 1)))
    a, c, sure = language.fit_logistic(z, 1000 * p, 1000 * (1 - p))
    assert a == pytest.approx(2, rel=0.02) and c == pytest.approx(-1, rel=0.02) and 0.05 < sure < 1
    a, _, sure = language.fit_logistic(z, np.where(z > 0.05, 10, 0.0), np.where(z < -0.05, 10, 0.0))
    assert 2 < a < 1000 and sure > 0.85  # the counts keep the scale finite


def test_decode_against_brute_force():
    codes = language.codewords(5)
    rng = np.random.default_rng(2)
    bits = codes.shape[1]
    plan = language.LanguageCodes(tuple("abcde"), codes, np.zeros((1, bits)), rng.uniform(0.5, 2, bits), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
    z = rng.normal(size=(50, bits))
    best, score, close = plan.decode(z)
    for i in range(50):
        loss = [sum(w * np.log1p(np.exp(-(1 if c else -1) * (a * x + o))) for w, c, a, x, o in zip(plan.sure, word, plan.scale, z[i], plan.offset)) for word in codes]
        shares = np.exp(-(np.array(loss) - min(loss)) / language.least_distance(codes))
        shares /= shares.sum()
        assert best[i] == int(np.argmin(loss)) and score[i] == pytest.approx(shares.max())
        assert close[i] == (sorted(shares)[-2] >= 0.5 * shares.max())
    flipped = 2.0 * codes - 1
    flipped[:, 0] *= -1  # one wrong bit is corrected
    sure = language.LanguageCodes(plan.languages, codes, plan.weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    assert sure.decode(20 * flipped)[0].tolist() == [0, 1, 2, 3, 4]


SYLLABLES = {"aa": ["ba", "do", "ki", "lu"], "bb": ["shr", "ent", "ing", "ow"], "cc": ["ñez", "ció", "gue", "ras"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def plan(spark):
    rng = np.random.default_rng(4)
    rows = [(i, made(rng, lang, int(rng.integers(3, 60))), lang, 0.5) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa", 0.1), (501, "", "bb", 0.1), (502, "123", "zz", 0.1), (503, "ba do", None, None)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3))


def test_predicts_texts_not_seen(spark, plan):
    assert plan.languages == ("aa", "bb", "cc")  # no letter under zz, so it is not learned
    rng = np.random.default_rng(5)
    rows = [(i, made(rng, lang, 8), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(900, made(rng, "bb", 400_000), "bb"), (901, made(rng, "cc", 6).upper(), "cc")]
    got = plan.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= len(rows) - 1
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.score for r in got]) > 0.9


def test_predicts_odd_texts(spark, plan):
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "ba do ki"), (4, "ba do ki"), (None, "shrent"), (6, "日本"), (7, "ba shr")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, score string, `a``b` int")
    with pytest.raises(ValueError):
        plan.predict(docs)
    got = plan.predict(docs, prefix="p_").collect()
    assert len(got) == len(rows) and got[0].score == "x"
    by = {r.doc_id: r for r in got}
    assert [by[i].p_lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by[i].p_score for i in (1, 2, 3)] == [0.0] * 3
    assert by[4].p_lang_pred == "aa" and by[None].p_lang_pred == "bb" and by[6].p_lang_pred in plan.languages
    assert plan.predict(docs.limit(0), prefix="p_").count() == 0


def test_few_languages(spark):
    schema = "text string, lang string"
    none = language.fit(spark.createDataFrame([], schema))
    docs = spark.createDataFrame([("some text",), ("?",)], "text string")
    assert [(r.lang_pred, r.score) for r in none.predict(docs).collect()] == [("und", 0.0)] * 2
    one = language.fit(spark.createDataFrame([("abc def", "xx")] * 3, schema))
    assert [(r.lang_pred, r.score) for r in one.predict(docs).collect()] == [("xx", 1.0), ("und", 0.0)]
    two = language.fit(spark.createDataFrame([("abab abab", "xx"), ("zyzy zzyy", "yy")] * 5, schema))
    assert [r.lang_pred for r in two.predict(spark.createDataFrame([("ab",), ("zy",)], "text string")).collect()] == ["xx", "yy"]
    many = [("".join(chr(97 + (3 * k + j) % 26) for j in (0, 1, 2, 1)) + f" {chr(97 + k)}{chr(97 + k)}q", f"l{k:02}") for k in range(20)]
    plan = language.fit(spark.createDataFrame(many * 4, schema))
    got = plan.predict(spark.createDataFrame(many, schema)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 19


def test_query_is_right_on_held_out_documents(spark):
    from tabprep.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op12_output_codes_language"](spark, folder).join(docs, "doc_id").collect()
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean(held) > 0.95
