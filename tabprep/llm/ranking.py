"""Quality scores of documents learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, labelled, materialize, sums, text_column, words_of

SLICE_BYTES = 4_000_000
#: Patterns counted in words; their shares of all word characters are features.
_COUNTED = (r"[#*$%&|<>]", r"\p{Lu}", r"\p{Nd}", "!", r"\|", r"[.,;:?]", r"[@~^_=+\\/{}\[\]]", r"(.)", r"[^\x00-\x7F]")
N_FEATURES = len(_COUNTED) + 7
#: Quantiles of the labelled scores that are tried as threshold.
QUANTILES = 400


def text_features(text: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers for each whole text, all of about unit size; an empty text has zeros."""
    codes, offsets, words = words_of(text)
    n = np.diff(offsets).astype(float)
    some = np.maximum(n, 1)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    chars = np.maximum(sums(size[codes], offsets), 1)
    columns = []
    for pattern in _COUNTED:
        if pattern == "(.)":  # long words
            columns.append(sums((size > 20)[codes], offsets) / some)
        else:
            found = pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
            columns.append(sums(found[codes], offsets) / chars)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    width = len(words) + 1
    distinct = np.bincount(np.unique(doc * width + codes) // width, minlength=len(n))
    lines = pc.split_pattern(text, "\n")
    line_doc = np.repeat(np.arange(len(n)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten().dictionary_encode()
    width = len(flat.dictionary) + 1
    own = np.unique(line_doc * width + flat.indices.to_numpy(zero_copy_only=False)) // width
    n_lines = np.maximum(np.bincount(line_doc, minlength=len(n)), 1)
    repeated = 1 - distinct / some
    columns += [
        np.where(n > 0, repeated, 0), np.where(n > 0, repeated / np.log2(2 + n), 0), np.log10(1 + n) / 4,
        1 / (1 + n), chars / some / 10 * (n > 0), 1 - np.bincount(own, minlength=len(n)) / n_lines,
        np.minimum(some / n_lines, 200) / 100 * (n > 0),
    ]
    return np.stack(columns, 1)


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            text = text_column(batch)
            for at, to in doc_slices(text, SLICE_BYTES):
                rows = text_features(text.slice(at, to - at))
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                part = batch.select(keep).slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*keep, "features"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, features array<double>")


@dataclass(frozen=True)
class Ranking:
    """Weights of the features and the score from which a document counts as good."""

    weights: tuple[float, ...]
    threshold: float
    passing: float = 0.7

    def probability(self, features: np.ndarray) -> np.ndarray:
        """In 0 to 1 and rising with the document's strength; ``passing`` at the threshold."""
        z = features @ np.array(self.weights) - self.threshold + math.log(self.passing / (1 - self.passing))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, docs: DataFrame, column: str = "score", only_passing: bool = False) -> DataFrame:
        """All columns and the score, or only the columns of the documents that pass. Null texts count as empty."""
        if not only_passing and column in docs.columns:
            raise ValueError(f"column {column} would be overwritten")

        def run(batches):
            for batch in batches:
                text = text_column(batch)
                for at, to in doc_slices(text, SLICE_BYTES):
                    p = self.probability(text_features(text.slice(at, to - at)))
                    part = batch.slice(at, to - at)
                    if only_passing:
                        yield part.filter(pa.array(p >= self.passing))
                    else:
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, column])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, kinds if only_passing else f"{kinds}, `{column}` double")

    def score_measured(self, rows: DataFrame) -> DataFrame:
        """doc_id and score of documents whose features are known."""

        def run(batches):
            for batch in batches:
                p = self.probability(batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Differences better minus worse: each labelled document meets one of the other label.

    Documents are dealt to buckets by a hash, one document of each label stands for its bucket, and each document is
    compared with the one that stands for the other label in its bucket. So there are about as many pairs as documents.
    """
    fewer = min((r["count"] for r in rows.groupBy("y").count().collect()), default=0)
    buckets = max(1, fewer // 4)
    dealt = rows.withColumns({
        "own": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets)),
        "meets": F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(buckets)),
    })
    stand = dealt.groupBy(F.col("own").alias("meets"), (1 - F.col("y")).alias("y")).agg(
        F.min_by("features", F.xxhash64("doc_id", F.lit(3))).alias("other")
    )
    met = dealt.join(stand, ["meets", "y"])
    return met.select(F.zip_with("features", "other", lambda a, b: (a - b) * F.when(F.col("y") == 1, 1.0).otherwise(-1.0)).alias("d"))


def fit_weights(pairs: DataFrame, d: int = N_FEATURES, steps: int = 10, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps on the logistic loss of ``d`` feature differences; tasks send sums, the driver solves for the weights."""
    weights = np.zeros(d)

    def totals(w, scale):
        def run(frames):
            g, h, n = np.zeros(d), np.zeros((d, d)), 0
            for frame in frames:
                x = np.stack(frame["d"].to_numpy()) / scale if len(frame) else np.zeros((0, d))
                p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
                g += x.T @ p
                h += x.T @ (x * (p * (1 - p))[:, None])
                n += len(x)
            yield pd.DataFrame({"i": np.arange(d + d * d + 1), "v": np.concatenate([g, h.ravel(), [n]])})

        found = pairs.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(d + d * d + 1)
        for i, v in found:
            flat[i] = v
        return flat[:d], flat[d:-1].reshape(d, d), flat[-1]

    _, h, n = totals(weights, np.ones(d))
    if not n:
        return weights
    scale = np.sqrt(4 * np.diag(h) / n)
    scale[scale < 1e-9] = 1
    for _ in range(steps):
        g, h, _ = totals(weights, scale)
        step = np.linalg.solve(h / n + ridge * np.eye(d), g / n - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights / scale


def best_threshold(scored: DataFrame) -> float:
    """The quantile of the labelled scores that parts the labels best; the middle where several do as well."""
    cuts = scored.agg(F.percentile_approx("s", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()[0]
    if not cuts:
        return 0.0
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array([F.lit(c) for c in cuts]), lambda c: c <= F.col("s")))
    counts = np.zeros((len(cuts) + 1, 2))
    for at, y, n in scored.groupBy(place.alias("at"), "y").count().collect():
        counts[at, y] = n
    good, bad = counts[:, 1].sum() or 1, counts[:, 0].sum() or 1
    # Scores from cuts[i] on pass.
    gain = counts[::-1, 1].cumsum()[::-1][1:] / good - counts[::-1, 0].cumsum()[::-1][1:] / bad
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    first, last = int(best[0]), int(best[-1])
    below = cuts[first - 1] if first else cuts[first]
    return (below + cuts[last]) / 2


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and features of every document, written once. Labels meet these few numbers, so no text is shuffled."""
    return materialize(_with_features(docs, ["doc_id"]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", passing: float = 0.7) -> Ranking:
    """Learn from all labelled documents. Without both labels every document gets the passing score."""
    return fit_measured(measured(docs), labels, label, passing)


def fit_measured(rows: DataFrame, labels: DataFrame, label: str = "quality", passing: float = 0.7) -> Ranking:
    """The same for documents whose features are known."""
    rows_seen = materialize(labelled(rows, labels, label, "features"))
    weights = fit_weights(materialize(preference_pairs(rows_seen)))
    return Ranking(tuple(weights.tolist()), best_threshold(rows_seen.select("y", strength(weights).alias("s"))), passing)


def strength(weights: np.ndarray):
    """Weighted sum of the column ``features``."""
    terms = F.zip_with("features", F.array([F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
