"""Toxicity scores of texts restored from disguised spelling by a noisy-channel decoder."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, labelled, labelled_texts, materialize, sorted_distinct, text_column, words_of
from tabprep.llm.ranking import best_threshold, fit_weights, preference_pairs, strength

#: Letters that the language model tells apart, the most frequent ones; and features with a weight at most.
LETTERS, FEATURES = 64, 400
SLICE_BYTES = 4_000_000
N_SIGNS = 6
#: Signs and the letters that they may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
#: Log probabilities of the channel: a letter written as a sign, a letter repeated, a sign that is no letter, and a
#: sign at the edge of a word that only surrounds it.
_LEET, _REPEATED, _SIGN, _NOISE = math.log(0.1), math.log(0.3), math.log(1e-6), math.log(1e-3)
_EDGE = " .,;:!?\"'()[]{}<>#*%&$|-_=~^`/\\"
#: What is dropped at the edges of a word before decoding: no sign that may stand for a letter.
_OUTER = "".join(c for c in _EDGE if c not in LEET)
_SIGNS = "[" + re.escape("".join(LEET)) + "]"
_SPACED = r"^\pL{1,2}([.\-_*]\pL{1,2}){2,}$"
_DISGUISED = rf"\pL.*{_SIGNS}|{_SIGNS}.*\pL"


@dataclass
class LetterModel:
    """Interpolated letter trigrams of plain words; a word starts and ends with a space."""

    counts: dict[str, int]
    memory: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.context, self.total = Counter(), 0
        for gram, n in self.counts.items():
            if len(gram) > 1:
                self.context[gram[:-1]] += n
            else:
                self.total += n
        self.total = self.total or 1

    def log(self, before: str, letter: str) -> float:
        """Log probability of a letter after the two before it."""
        gram = before + letter
        if gram not in self.memory:
            p = 0.05 * (self.counts.get(letter, 0) + 0.01) / (self.total + 1)
            for weight, g in ((0.25, gram[1:]), (0.7, gram)):
                seen = self.context.get(g[:-1], 0)
                p += weight * self.counts.get(g, 0) / seen if seen else 0
            self.memory[gram] = math.log(p)
        return self.memory[gram]


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """For each run of one sign the letters it may stand for, with the channel's log probability. No letter: not said."""
    steps = []
    first, last = len(written) - len(written.lstrip(_EDGE)), len(written.rstrip(_EDGE))
    for run in re.finditer(r"(.)\1*", written, re.DOTALL):
        sign, n = run[1], len(run[0])
        outside = run.end() <= first or run.start() >= last
        if outside and sign not in LEET:
            options = [("", 0.0)]
        elif sign in LEET:
            options = [(letter * k, _LEET + _REPEATED * (n > k)) for letter in LEET[sign] for k in {1, min(n, 2)}]
            options.append(("", _NOISE) if outside else (run[0], _SIGN * n))
        elif sign in ".-_*":
            options = [("", 0.0)]
        else:
            options = [(sign * k, _REPEATED * (n > k)) for k in {1, min(n, 2)}]
        steps.append(options)
    return steps


def _traced(back: list[dict], state: str) -> list[str]:
    """What the best path to a state spells, step by step."""
    found = []
    for step in reversed(back):
        state, letters = step[state]
        found.append(letters)
    return found[::-1]


def _settled(back: list[dict], best: dict[str, float]) -> tuple[int, str]:
    """The last step before which all best paths are in one state, and that state; step 0 if there is none."""
    states = set(best)
    for k in range(len(back) - 1, -1, -1):
        states = {back[k][s][0] for s in states}
        if len(states) == 1:
            return k, states.pop()
    return 0, ""


def decode(written: str, model: LetterModel, gaps: bool = False, held: int = 256) -> str:
    """Most probable plain spelling by Viterbi over the lattice; a state is the last two letters.

    With ``gaps`` each sign was a word of its own, and a space may stand between any two. Back pointers of about
    ``held`` steps are kept: what all best paths share is spelled and let go, so a long word costs time by its
    length and no more memory than its paths stay apart. Of equally good spellings the later one by letters is taken.
    """
    best, back, sure, limit = {"  ": 0.0}, [], [], held
    for k, options in enumerate(lattice(written)):
        new: dict[str, float] = {}
        step: dict[str, tuple[str, str]] = {}
        for state, score in best.items():
            starts = [(state, score, "")]
            if gaps and k:
                starts.append(("  ", score + model.log(state, " "), " "))
            for at, value, lead in starts:
                for letters, cost in options:
                    total, now = value + cost, at
                    for letter in letters:
                        total += model.log(now, letter)
                        now = now[1] + letter
                    if now not in new or total > new[now]:
                        new[now], step[now] = total, (state, lead + letters)
        best = new
        back.append(step)
        if len(back) >= limit:
            cut, state = _settled(back, best)
            sure += _traced(back[:cut], state) if cut else []
            back = back[cut:]
            limit = max(held, 2 * len(back))
    ended = {state: score + model.log(state, " ") for state, score in best.items()}
    most = max(ended.values())
    return "".join(sure) + max("".join(_traced(back, state)) for state, score in ended.items() if score == most)


def restore(text: pa.Array, model: LetterModel, store: dict) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Plain words of each text: (row, code, words). Signs at the edges of a word are dropped, disguised words decoded.

    A sign at an edge may be a letter or not, and a doubled letter may be meant: such a word stays beside its decoding.
    """
    codes, offsets, words = words_of(text)
    low = pc.utf8_lower(words)
    plain, bare = pc.utf8_trim(low, _EDGE), pc.utf8_trim(low, _OUTER)
    letters = sorted({*"abcdefghijklmnopqrstuvwxyz", *(g for g in model.counts if len(g) == 1 and g.isalpha())})

    def repeated(times):
        return pc.match_substring_regex(plain, "|".join(re.escape(c * times) for c in letters))

    sure = pc.or_(pc.or_(pc.match_substring_regex(plain, _DISGUISED), pc.match_substring_regex(plain, _SPACED)), repeated(3))
    maybe = pc.or_(pc.match_substring_regex(bare, _DISGUISED), repeated(2))
    sure = sure.to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(sure | maybe.to_numpy(zero_copy_only=False))
    known = plain.to_pylist()
    written = bare.to_pylist()
    other, extra = np.full(len(known), -1), []
    for i in odd.tolist():
        word = written[i] or known[i]
        if word not in store:
            if len(store) > 100_000:
                store.clear()
            store[word] = decode(word, model)
        if sure[i]:
            known[i] = store[word]
        elif store[word] != known[i]:
            other[i] = len(known) + len(extra)
            extra.append(store[word])
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    single = (pc.utf8_length(bare).to_numpy(zero_copy_only=False) == 1)[codes]
    near = single & np.concatenate([[False], single[:-1] & (row[1:] == row[:-1])])
    starts = np.flatnonzero(single & ~near)
    ends = np.flatnonzero(single & ~np.concatenate([near[1:], [False]])) + 1
    second = other[codes]
    rows, more = [row, row[second >= 0]], [codes, second[second >= 0]]
    apart_row, apart = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= 3:  # letters written apart
            word = "".join(written[codes[i]] for i in range(a, b))
            if (word, "apart") not in store:
                store[word, "apart"] = decode(word, model, gaps=True)
            for part in store[word, "apart"].split():
                apart_row.append(row[a])
                apart.append(part)
    rows.append(np.array(apart_row, row.dtype))
    more.append(len(known) + len(extra) + np.arange(len(apart)))
    return np.concatenate(rows), np.concatenate(more), known + extra + apart


def _features(word: str) -> list[str]:
    """The word and its strings of four and five letters, its edges marked; some may come twice."""
    edged = f"^{word}$"
    n = len(edged)
    return [edged[i:i + 4] for i in range(n - 3)] + [edged[i:i + 5] for i in range(n - 4)] + [edged]


def word_features(word: str) -> set[str]:
    return set(_features(word))


def _letter_counts(docs: DataFrame) -> dict[str, int]:
    """Counts of letters, pairs and triples in words of letters only."""

    def run(batches):
        for batch in batches:
            text = text_column(batch)
            for at, to in doc_slices(text, SLICE_BYTES):
                codes, _, words = words_of(text.slice(at, to - at))
                times, total = np.bincount(codes, minlength=len(words)).tolist(), Counter()
                for word, n in zip(pc.utf8_trim(pc.utf8_lower(words), _EDGE).to_pylist(), times, strict=True):
                    if word.isalpha() and len(word) > 1:
                        edged = f"  {word} "
                        for i in range(2, len(edged)):
                            total[edged[i - 2:i + 1]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    grams = materialize(docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    letters = {r[0] for r in grams.groupBy(F.substring("gram", 3, 1).alias("l")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "l").limit(LETTERS).collect()} | {" "}
    inside = F.size(F.filter(F.split("gram", ""), lambda c: ~c.isin(*letters) & (c != ""))) == 0
    counts: Counter = Counter()
    for gram, n in grams.filter(inside).collect():  # at most (LETTERS + 1) ** 3 rows
        for k in (0, 1, 2):
            counts[gram[k:]] += n
    return dict(counts)


def _word_weights(docs: DataFrame, model: LetterModel) -> dict[str, float]:
    """Log odds of features between labels, cross-fitted: chosen on one half of the documents, weighed on the other.

    Counts are taken a standard deviation to the safe side, so that what few documents hold by chance weighs little.
    """

    def run(batches):
        store: dict = {}
        for batch in batches:
            text, y = text_column(batch), np.array(batch.column("y").to_pylist())
            half = np.array(batch.column("half").to_pylist())
            for at, to in doc_slices(text, SLICE_BYTES):
                row, codes, words = restore(text.slice(at, to - at), model, store)
                numbers: dict[str, int] = defaultdict(count().__next__)
                lists = [[numbers[f] for f in _features(w)] if w else [] for w in words]
                size = np.array([len(x) for x in lists], np.int64)
                flat = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
                start = np.cumsum(size) - size
                pairs = sorted_distinct(row.astype(np.int64) * len(words) + codes)
                row, code = pairs // len(words), pairs % len(words)
                each = size[code]
                ends = np.cumsum(each)
                feature = flat[np.repeat(start[code] - (ends - each), each) + np.arange(int(each.sum()))]
                width = len(numbers) + 1
                seen = sorted_distinct(np.repeat(row, each) * width + feature)
                cell = (2 * half + y)[at:to][seen // width]
                table = np.bincount(cell * width + seen % width, minlength=4 * width).reshape(4, width)[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(list(numbers)), *[pa.array(t.astype(np.int64)) for t in table]], names=["f", "n0", "p0", "n1", "p1"])

    halves = docs.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))
    size = {(r[0], r[1]): r[2] for r in halves.groupBy("half", "y").count().collect()}
    counts = halves.select("text", "y", "half").mapInArrow(run, "f string, n0 long, p0 long, n1 long, p1 long")
    total = counts.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")])

    def odds(h):
        good, bad = size.get((h, 0), 0), size.get((h, 1), 0)
        p, n = F.col(f"p{h}"), F.col(f"n{h}")
        return F.log((p - F.sqrt(p) + 0.1) / (bad + 1)) - F.log((n + F.sqrt(n) + 0.5) / (good + 1))

    chosen = [odds(h) > 1.0 for h in (0, 1)]
    weight = (F.when(chosen[0], odds(1)).otherwise(0.0) + F.when(chosen[1], odds(0)).otherwise(0.0)) / 2
    rated = total.select("f", weight.alias("w"), (F.col("p0") + F.col("p1")).alias("p")).filter(F.col("w") > 1.0)
    top = rated.orderBy(F.desc(F.col("w") * F.col("p")), "f").limit(FEATURES)
    return {f: w for f, w, _ in top.collect()}


@dataclass
class Toxicity:
    letters: LetterModel
    words: dict[str, float]
    weights: tuple[float, ...] = (0.0,) * N_SIGNS
    threshold: float = 1.0
    passing: float = 0.7

    def signs(self, text: pa.Array, store: dict) -> np.ndarray:
        """For each text: weight of its strongest word, sum and number of weighed words, both also by its length."""
        if not self.words:
            return np.zeros((len(text), N_SIGNS))
        row, codes, words = restore(text, self.letters, store)
        strings = pa.array([f"^{w}$" for w in words], pa.large_string())
        pattern = "|".join(re.escape(f) for f in self.words)
        found = np.flatnonzero(pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False))
        worth = np.zeros(len(words))
        for i in found.tolist():
            worth[i] = max((self.words.get(f, 0.0) for f in word_features(words[i])), default=0.0)
        strongest = np.zeros(len(text))
        np.maximum.at(strongest, row, worth[codes])
        hit = worth[codes] > 0
        pairs = np.unique(row[hit].astype(np.int64) * max(len(words), 1) + codes[hit])
        of, value = pairs // max(len(words), 1), worth[pairs % max(len(words), 1)]
        total, number = np.bincount(of, value, len(text)), np.bincount(of, minlength=len(text))
        long = np.sqrt(1 + np.bincount(row, minlength=len(text)) / 100)
        return np.stack([strongest, total, number, total / long, number / long, strongest > 0], 1)

    def probability(self, signs: np.ndarray) -> np.ndarray:
        z = signs @ np.array(self.weights) - self.threshold + math.log(self.passing / (1 - self.passing))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def measured(self, docs: DataFrame) -> DataFrame:
        """doc_id and the signs as ``features`` of every document, written once."""

        def run(batches):
            store: dict = {}
            for batch in batches:
                text = text_column(batch)
                for at, to in doc_slices(text, SLICE_BYTES):
                    found = self.signs(text.slice(at, to - at), store)
                    part = batch.column("doc_id").slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([part, pa.array(found.tolist(), pa.list_(pa.float64()))], names=["doc_id", "features"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>"))

    def fit_measured(self, rows: DataFrame, labels: DataFrame, label: str = "toxic") -> Toxicity:
        """Weights of the signs, learned from all labelled documents among those whose signs are known."""
        if not self.words:
            return self
        seen = materialize(labelled(rows, labels, label, "features"))
        weights = fit_weights(materialize(preference_pairs(seen)), N_SIGNS, ridge=1e-2)
        threshold = best_threshold(seen.select("y", strength(weights).alias("s")))
        return Toxicity(self.letters, self.words, tuple(weights.tolist()), threshold, self.passing)

    def score_measured(self, rows: DataFrame) -> DataFrame:
        """doc_id and score of documents whose signs are known."""

        def run(batches):
            for batch in batches:
                p = self.probability(batch.column("features").flatten().to_numpy().reshape(-1, N_SIGNS))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        """All columns and the score in 0 to 1. Null texts count as empty."""
        if column in docs.columns:
            raise ValueError(f"column {column} would be overwritten")

        def run(batches):
            store: dict = {}
            for batch in batches:
                text = text_column(batch)
                for at, to in doc_slices(text, SLICE_BYTES):
                    value = self.probability(self.signs(text.slice(at, to - at), store))
                    part = batch.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, column])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{kinds}, `{column}` double")


def learn_words(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Toxicity, DataFrame]:
    """Letters and words that tell the labels apart, from all labelled documents; and these documents, written once."""
    known = labelled_texts(docs, labels, label)
    letters = LetterModel(_letter_counts(known))
    return Toxicity(letters, _word_weights(known, letters)), known


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Toxicity:
    """Learn letters, words and their weights from all labelled documents.

    Without both labels, or without a word that tells them apart, no document passes.
    """
    model, known = learn_words(docs, labels, label)
    return model.fit_measured(model.measured(known), labels, label)
