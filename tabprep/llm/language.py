"""Language identification by error-correcting output codes over letter n-grams."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, materialize, sums, text_column, words_of

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SLICE_BYTES = 4_000_000
#: Documents that the bits are calibrated on at most (in expectation, by a hash of the text); all others are counted too.
CALIBRATION_ROWS = 20_000
#: Languages with all their codewords (2 ** (K - 1) - 1 bits); beyond it codewords are drawn.
EXHAUSTIVE = 6
#: Share of a language's probability that is spread over all buckets.
SMOOTHING = 0.02
#: Unit of the integers in which documents' n-gram shares are added up.
UNIT = 1 << 30
BINS = 400


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of bits for each language: all dichotomies of a few, otherwise the drawn code with the widest distance.

    Every bit parts the languages, no two bits do so alike, and two languages differ in as many bits as possible.
    """
    if languages <= EXHAUSTIVE:
        bits = max(0, (1 << languages - 1) - 1) if languages else 0
        return ((np.arange(1, bits + 1)[None, :] >> np.arange(languages)[:, None]) & 1).astype(np.int8)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, widest = None, -1
    for _ in range(100):
        drawn = rng.integers(0, 2, (languages, 2 * width), dtype=np.int8)
        drawn ^= drawn[:1]  # a bit and its opposite are the same question
        drawn = np.unique(drawn[:, drawn.any(0)], axis=1)
        drawn = drawn[:, rng.permutation(drawn.shape[1])[:width]]
        distance = least_distance(drawn)
        if distance > widest:
            best, widest = drawn, distance
    return best


def least_distance(codes: np.ndarray) -> int:
    """Fewest bits in which two codewords differ; 0 for fewer than two."""
    if len(codes) < 2:
        return 0
    signs = 2.0 * codes - 1
    apart = (codes.shape[1] - signs @ signs.T) / 2
    return int(apart[~np.eye(len(codes), dtype=bool)].min())


@dataclass(frozen=True)
class Grams:
    """N-grams of the distinct letter runs of some texts: ``bucket`` and ``word`` of each, and the words of each text."""

    bucket: np.ndarray
    word: np.ndarray
    words: int
    codes: np.ndarray
    offsets: np.ndarray
    letters: np.ndarray

    @property
    def per_word(self) -> np.ndarray:
        return np.bincount(self.word, minlength=self.words).astype(float)

    @property
    def per_text(self) -> np.ndarray:
        return sums(self.per_word[self.codes], self.offsets)


def letter_grams(text: pa.Array) -> Grams:
    """N-grams of ``ORDERS`` letters of whole texts, in lower case and composed form, words with a blank on each side."""
    codes, offsets, words = words_of(text)
    has_letter = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    plain = pc.utf8_lower(words)
    apart = pc.match_substring_regex(plain, r"\p{M}")  # letters with marks of their own are few; only these need Python
    if pc.any(apart, min_count=0).as_py():
        composed = [unicodedata.normalize("NFC", w) for w in plain.filter(apart).to_pylist()]
        plain = pc.replace_with_mask(plain, apart, pa.array(composed, pa.large_string()))
    runs = pc.utf8_trim(pc.replace_substring_regex(plain, r"[^\p{L}\p{M}]+", " "), " ").dictionary_encode()
    runs, place = runs.dictionary, runs.indices.to_numpy(zero_copy_only=False)
    sizes = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    padded = np.where(sizes > 0, sizes + 2, 0)
    blank = pa.scalar(" ", pa.large_string())
    joined = pc.binary_join_element_wise(blank, runs.filter(pa.array(sizes > 0)), blank, pa.scalar("", pa.large_string()))
    spelled = pa.array(joined, pa.large_string())
    chars = np.frombuffer("".join(spelled.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(runs)), padded)
    space = chars == 32
    bucket, owner = [], []
    value = np.zeros(len(chars), np.uint64)
    inside = np.ones(len(chars), bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:]
            # Same word, and blanks at the ends only.
            inside = inside[:m] & (word[n - 1:] == word[:m])
            if n > 2:
                inside &= ~space[n - 2:-1]
            if n in ORDERS:
                at = np.flatnonzero(inside & ~space[:m] if n == 1 else inside)
                mixed = (value[at] ^ (value[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                bucket.append((mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
                owner.append(word[at])
    none = np.zeros(0, np.int64)
    return Grams(
        np.concatenate([none, *bucket]), np.concatenate([none, *owner]), len(runs), place[codes], offsets,
        sums(has_letter[codes], offsets) > 0,
    )


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, half, bucket, share): shares of n-grams summed over texts, each text weighing 1; bucket -1 counts texts."""

    def run(batches):
        found: dict[tuple[str, int], np.ndarray] = {}

        def rows():
            for (lang, half), total in found.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(at), pa.string()), "half": pa.array([half] * len(at), pa.int32()),
                    "bucket": pa.array(at - 1, pa.int32()), "share": pa.array(total[at]),
                })
            found.clear()

        for batch in batches:
            whole = text_column(batch)
            langs = batch.column(1).dictionary_encode()
            names, key = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            key = key * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            for at, to in doc_slices(whole, SLICE_BYTES):
                grams = letter_grams(whole.slice(at, to - at))
                each = grams.per_text
                weight = np.repeat(UNIT / np.maximum(each, 1), np.diff(grams.offsets))
                of = np.repeat(key[at:to], np.diff(grams.offsets))
                for k in np.unique(key[at:to][each > 0]):
                    mine = of == k
                    words = np.bincount(grams.codes[mine], weights=weight[mine], minlength=grams.words)
                    share = np.bincount(grams.bucket, weights=words[grams.word], minlength=BUCKETS)
                    total = found.setdefault((names[k // 2], int(k % 2)), np.zeros(BUCKETS + 1, np.int64))
                    total[1:] += np.rint(share).astype(np.int64)
                    total[0] += int((each[key[at:to] == k] > 0).sum())
                if len(found) > 64:
                    yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "lang string, half int, bucket int, share long").groupBy("lang", "half", "bucket").agg(F.sum("share").alias("share"))


def bit_weights(shares: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log odds of each bucket for each bit, between the mean n-gram distributions of the languages on either side."""
    total = np.maximum(shares.sum(1, keepdims=True), 1e-300)
    p = (1 - SMOOTHING) * shares / total + SMOOTHING / shares.shape[1]
    side = codes.T / np.maximum(codes.sum(0), 1)[:, None]
    other = (1 - codes).T / np.maximum((1 - codes).sum(0), 1)[:, None]
    return (np.log(side @ p) - np.log(other @ p)).T.astype(np.float32)


def margins(grams: Grams, weights: np.ndarray) -> np.ndarray:
    """Sum of the log odds of a text's n-grams over the root of their number, for each bit."""
    out = np.zeros((len(grams.offsets) - 1, weights.shape[1]))
    for b in range(weights.shape[1]):
        words = np.bincount(grams.word, weights=weights[grams.bucket, b], minlength=grams.words)
        out[:, b] = sums(words[grams.codes], grams.offsets)
    return out / np.sqrt(1 + grams.per_text)[:, None]


def fit_logistic(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray, steps: int = 100) -> tuple[float, float, float]:
    """Scale and offset of a margin, and how sure the bit is (1 less its mean loss in bits), from counted margins.

    Targets are moved off 0 and 1 by the counts, so that separable bits keep a finite scale.
    """
    good, bad = ones.sum(), zeros.sum()
    if not good or not bad:
        return 1.0, 0.0, 1.0
    n = ones + zeros
    target = (ones * (good + 1) / (good + 2) + zeros / (bad + 2)) / np.maximum(n, 1)
    a, c = 1.0, 0.0

    def loss(a, c):
        u = a * z + c
        return float((n * (np.logaddexp(0, u) - target * u)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -500, 500)))
        g = np.array([(n * (p - target) * z).sum(), (n * (p - target)).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-9 * n.sum() * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * step[0], c - size * step[1]) > loss(a, c):
            size /= 2
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(size * step).max() < 1e-6:
            break
    if a <= 0:  # no better than chance
        return 1.0, 0.0, 0.05
    sure = 1 - loss(a, c) / n.sum() / np.log(2)
    return float(a), float(c), float(np.clip(sure, 0.05, 1))


@dataclass(frozen=True)
class LanguageCodes:
    """Learned languages, their codewords, and a calibrated n-gram classifier for each bit."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    offset: np.ndarray
    sure: np.ndarray
    ambiguous_ratio: float = 0.5

    def decode(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share among all, and whether the next one comes close.

        The distance of a codeword is the sum of its bits' logistic losses, each weighed by how sure the bit is. Shares
        are those of exp(-distance / least Hamming distance), since redundant bits repeat the same evidence.
        """
        u = z * self.scale + self.offset
        signs = 2.0 * self.codes - 1
        # log(1 + exp(-s u)) = log(1 + exp(u)) - u [s = 1]
        high = np.logaddexp(0, u) * self.sure
        distance = high.sum(1)[:, None] - (u * self.sure) @ ((signs + 1) / 2).T
        shares = np.exp(-(distance - distance.min(1, keepdims=True)) / max(1, least_distance(self.codes)))
        shares /= shares.sum(1, keepdims=True)
        best = shares.argmax(1)
        score = shares[np.arange(len(shares)), best]
        rest = shares.copy()
        rest[np.arange(len(shares)), best] = 0
        return best, score, rest.max(1) >= self.ambiguous_ratio * score

    def predict(self, docs: DataFrame, prefix: str = "") -> DataFrame:
        """All columns and ``lang_pred``, ``score`` (0 to 1), ``ambiguous``, with the prefix before these three.

        A text that is null, empty or without a letter is ``und`` with score 0, as is every text where nothing was
        learned; one learned language is always right, with score 1. A column that would be overwritten is refused.
        """
        added = [prefix + c for c in ("lang_pred", "score", "ambiguous")]
        if set(added) & set(docs.columns):
            raise ValueError(f"columns {added} would be overwritten; choose another prefix")
        names = pa.array([*self.languages, UNKNOWN], pa.string())
        given, plain = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # any name may be in the table
        place = plain[given.index("text")]

        def run(batches):
            for batch in batches:
                text = text_column(batch, place)
                for at, to in doc_slices(text, SLICE_BYTES):
                    grams = letter_grams(text.slice(at, to - at))
                    known = grams.letters & (grams.per_text > 0) & (len(self.languages) > 0)
                    best, score, close = np.full(to - at, len(self.languages)), np.zeros(to - at), np.zeros(to - at, bool)
                    if known.any():
                        found = self.decode(margins(grams, self.weights))
                        best, score, close = (np.where(known, a, b) for a, b in zip(found, (best, score, close), strict=True))
                    part = batch.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, names.take(pa.array(best)), pa.array(score), pa.array(close.astype(bool))],
                        names=[*given, *added],
                    )

        kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.toDF(*plain).mapInArrow(run, f"{kinds}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` boolean")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", calibration_rows: int = CALIBRATION_ROWS) -> LanguageCodes:
    """Learn from every document with a language and a letter.

    N-gram shares are counted over all of them, per language and half (by a hash of the text); each document weighs the
    same. The driver gets one row per language and bucket, whatever the number of documents. Bits are calibrated on about
    ``calibration_rows`` documents, each scored with the other half's weights (where that half has its language), as
    counts of margins per bit. Repeated rows
    count as often as they occur; a language whose documents hold no letter is not learned, and ties go to the
    language that comes first by name.
    """
    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = known.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    counted = materialize(_counts(known))
    languages = [r[0] for r in counted.filter("bucket = -1").select("lang").distinct().orderBy("lang").collect()]
    texts = counted.filter("bucket = -1").agg(F.sum("share")).first()[0] or 0
    shares = np.zeros((2, len(languages), BUCKETS))
    place = {name: i for i, name in enumerate(languages)}
    if languages:
        table = counted.filter("bucket >= 0").toPandas()
        shares[table["half"], table["lang"].map(place), table["bucket"]] = table["share"] / UNIT
    codes = codewords(len(languages))
    weights = bit_weights(shares.sum(0), codes)
    bits = codes.shape[1]
    if not bits:
        return LanguageCodes(tuple(languages), codes, weights, np.ones(0), np.zeros(0), np.ones(0))
    halves = [bit_weights(shares[1 - h], codes) for h in range(2)]
    judged = [np.append(shares[1 - h].any(1), False) for h in range(2)]  # languages that the other half has seen
    kept = min(1.0, calibration_rows / max(1, texts))
    some = known.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40)) < int(kept * (1 << 40)))

    def margin_counts(batches):
        total = np.zeros((bits, 2, BINS + 1), np.int64)
        for batch in batches:
            whole = text_column(batch)
            own = np.array([place.get(v, -1) for v in batch.column(1).to_pylist()])
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for at, to in doc_slices(whole, SLICE_BYTES):
                grams = letter_grams(whole.slice(at, to - at))
                for h in range(2):
                    mine = (half[at:to] == h) & judged[h][own[at:to]] & (grams.per_text > 0)
                    if mine.any():
                        z = margins(grams, halves[h])[mine]
                        spot = np.rint((z / (1 + np.abs(z)) + 1) * BINS / 2).astype(int)
                        for b in range(bits):
                            np.add.at(total[b], (codes[own[at:to][mine], b], spot[:, b]), 1)
        where = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "bit": pa.array(where[0], pa.int32()), "y": pa.array(where[1], pa.int32()),
            "spot": pa.array(where[2], pa.int32()), "n": pa.array(total[where]),
        })

    counts = np.zeros((bits, 2, BINS + 1))
    found = some.mapInArrow(margin_counts, "bit int, y int, spot int, n long").groupBy("bit", "y", "spot").agg(F.sum("n").alias("n")).toPandas()
    counts[found["bit"], found["y"], found["spot"]] = found["n"]
    t = np.clip(np.arange(BINS + 1) / (BINS / 2) - 1, -0.999, 0.999)
    z = t / (1 - np.abs(t))
    lines = np.array([fit_logistic(z, counts[b, 1], counts[b, 0]) for b in range(bits)])
    return LanguageCodes(tuple(languages), codes, weights, lines[:, 0], lines[:, 1], lines[:, 2])
