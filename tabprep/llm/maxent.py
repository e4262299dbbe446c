"""A class-factored maximum-entropy language model on hashed n-gram and skip features of classes and of words."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import materialize, text_slices, words_of

#: Word classes (0 is the end of a text) and buckets of the features of two classes.
CLASSES, BUCKETS = 64, 1024
#: Text of a batch, whose vocabulary is held at once, and vocabulary rows handed on together.
SLICE_BYTES, ROWS_AT_ONCE = 8_000_000, 50_000
_END = np.int64(-(1 << 62))
#: Last bits of a word's hash, its class among them, that features of words are made of; buckets of these features.
WORD_BITS, WORD_BUCKETS = 20, 1 << 14
#: Tokens of a training step on features of words, and its rate.
STEP_TOKENS, RATE = 512, 0.5
#: Tokens whose buckets are held at once; whole steps.
MANY_TOKENS = 128 * STEP_TOKENS
#: Blocks of weights: bias, class before, class two before (skip), both together.
_ROWS = 1 + 2 * CLASSES + BUCKETS


def word_class(word: str) -> int:
    """Words with the same last three characters share a class."""
    return 1 + zlib.crc32(word[-3:].encode()) % (CLASSES - 1)


def coded(codes: np.ndarray, offsets: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with an end after each text, ends of the texts, and hashes of the words and the end, classes in the last bits."""
    known = words.to_pylist()
    hashes = pd.util.hash_array(np.array(known, dtype=object), categorize=False).view(np.int64) if known else np.zeros(0, np.int64)
    last = pc.utf8_slice_codeunits(words, -3).dictionary_encode()  # classes of distinct endings
    of = np.fromiter(map(word_class, last.dictionary.to_pylist()), np.int32, len(last.dictionary))
    classes = np.append(of[last.indices.to_numpy(zero_copy_only=False)], np.int32(0))
    codes = np.insert(codes, offsets[1:], len(known)).astype("<i4")
    return codes, offsets[1:] + np.arange(1, len(offsets)), np.append(hashes, _END) & -CLASSES | classes


def tokenized(docs: DataFrame, held_out: Column) -> DataFrame:
    """Written once: documents as codes into the vocabulary of their batch, each batch's vocabulary, and class counts.

    Row kinds: 0 a document (``codes`` of its words, then its end), 1 a word of a batch's vocabulary (its code, hash
    with the class in its last bits, and training count), 2 how often three classes in a row (``hash`` is their cell) occur in a task's training
    documents. Every row but that of a document is a few numbers, and a batch is about ``SLICE_BYTES`` of text.
    """
    schema = pa.schema([
        ("batch", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()),
        ("code", pa.int32()), ("hash", pa.int64()), ("n", pa.int64()),
    ])

    def rows(number: int, kind: int, size: int, **values) -> pa.RecordBatch:
        values |= {"batch": np.full(size, number), "kind": np.full(size, kind, np.int32)}
        return pa.RecordBatch.from_arrays(
            [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(size, f.type) for f in schema], schema=schema
        )

    def numbered(number, kind, **values):
        size = len(values["hash"])
        for at in range(0, size, ROWS_AT_ONCE):
            part = {k: v[at:at + ROWS_AT_ONCE] for k, v in values.items()}
            yield rows(number, kind, len(part["hash"]), **part)

    def run(batches):
        from pyspark import TaskContext

        number, triples = TaskContext.get().partitionId() << 32, np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for at, (text,) in text_slices(batch, SLICE_BYTES, batch.num_rows):
                n_docs = len(text)
                codes, ends, hashes = coded(*words_of(pc.ascii_lower(text)))
                classes = (hashes & CLASSES - 1).astype(np.int32)
                held = batch.column("held_out").slice(at, n_docs)
                train = ~np.repeat(held.to_numpy(zero_copy_only=False).astype(bool), np.diff(np.concatenate([[0], ends])))
                one, two = before(classes[codes], ends)
                cell = (two.astype(np.int64) * CLASSES + one) * CLASSES + classes[codes]
                triples += np.bincount(cell[train], minlength=CLASSES**3)
                counts = np.bincount(codes[train], minlength=len(hashes))
                starts = np.concatenate([[0], ends[:-1]])
                # All lower halves, then all upper halves, which are mostly equal and shrink when written.
                halves = codes.view("<u2").reshape(-1, 2).T.copy()
                parts = [halves[:, a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield rows(number, 0, n_docs, doc_id=batch.column("doc_id").slice(at, n_docs), held_out=held, codes=parts)
                yield from numbered(number, 1, code=np.arange(len(hashes)), hash=hashes, n=counts)
                number += 1
                pa.default_memory_pool().release_unused()
        used = np.flatnonzero(triples)
        yield from numbered(number, 2, hash=used, n=triples[used])

    kinds = "batch long, kind int, doc_id long, held_out boolean, codes binary, code int, hash long, n long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return materialize(texts.mapInArrow(run, kinds))


def before(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token; 0 before the start of a text."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    starts = ends[:-1]
    one[starts[starts < len(classes)]] = 0
    two[starts[starts < len(classes)]] = 0
    second = starts + 1
    two[second[second < len(classes)]] = 0
    return one, two


def contexts(word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Class of each token, context of classes (two before * CLASSES + one before), words one and two before; 32 bits each."""
    cls = word & CLASSES - 1
    one, two = before(cls, ends)
    two *= CLASSES
    two += one
    return cls, two, before(word, ends)


def context_rows(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Weight rows of a context's active features."""
    both = (two.astype(np.int64) * CLASSES + one) * 2654435761 % (1 << 32) % BUCKETS
    return np.stack([np.zeros(len(one), np.int64), 1 + one, 1 + CLASSES + two, 1 + 2 * CLASSES + both], 1)


def word_rows(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Buckets of a context's features of words: the word before, the one two before (skip) and both (n-gram)."""
    one, two = one.astype(np.int64), two.astype(np.int64)
    keys = np.stack([one, two + (1 << WORD_BITS), (two + 2 << WORD_BITS) + one], 1).astype(np.uint64)
    keys = (keys ^ keys >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)
    return (keys >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64)


def log_classes(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log probability of each class in the contexts (two before * CLASSES + one before)."""
    z = weights[context_rows(contexts // CLASSES, contexts % CLASSES)].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(triples: DataFrame, steps: int = 20, rate: float = 0.15, ridge: float = 1e-6) -> np.ndarray:
    """Gradient steps (Adam) on the likelihood of all class triples (cell, n); tasks send gradients, the driver adds them.

    ``triples`` has at most CLASSES ** 3 rows whatever the corpus, in a fixed number of tasks.
    """
    weights = np.zeros((_ROWS, CLASSES))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    dealt = materialize(triples.repartition(8, F.floor(F.col("cell") / CLASSES)))

    def gradient(w):
        def run(frames):
            g, n = np.zeros_like(w), 0
            for frame in frames:
                cell, count = frame["cell"].to_numpy(), frame["n"].to_numpy()
                context, place = np.unique(cell // CLASSES, return_inverse=True)
                seen = np.zeros((len(context), CLASSES))
                np.add.at(seen, (place, cell % CLASSES), count)
                off = seen - seen.sum(1, keepdims=True) * np.exp(log_classes(w, context))
                for rows in context_rows(context // CLASSES, context % CLASSES).T:
                    np.add.at(g, rows, off)
                n += int(count.sum())
            yield pd.DataFrame({"g": [g.astype("<f8").tobytes()], "n": [n]})

        parts = dealt.mapInPandas(run, "g binary, n long").collect()
        total = sum(p["n"] for p in parts) or 1
        return sum(np.frombuffer(p["g"]).reshape(w.shape) for p in parts) / total

    for step in range(1, steps + 1):
        g = gradient(weights) - ridge * weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return weights


def class_scores(table: np.ndarray, base: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all classes; those whose exponentials do not fit single precision are cut to what does."""
    z = table.take(rows[:, 0], 0)
    z += base
    for more in rows.T[1:]:
        z += table.take(more, 0)
    np.minimum(z, 80, out=z)
    return np.maximum(z, -80, out=z)


def bucket_sums(off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of ``rows`` and the sum of ``off`` over the tokens of each; most have one token, taken as it is."""
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    in_order, token = flat[order], order // rows.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    sizes = np.diff(starts, append=len(flat))
    total, many = off.take(token[starts], 0), sizes > 1
    if many.any():
        n = sizes[many]
        total[many] = np.add.reduceat(off.take(token[np.repeat(many, sizes)], 0), np.cumsum(n) - n)
    return in_order[starts], total


def learn_words(table: np.ndarray, spread: np.ndarray, base: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step on the features ``rows`` of tokens whose classes score ``base`` without them.

    A bucket's rate falls with the root of its squared gradients so far (AdaGrad, one rate for all classes of a bucket).
    """
    off = class_scores(table, base, rows)
    np.exp(off, out=off)
    off *= (-1 / np.einsum("ij->i", off))[:, None]
    off[np.arange(len(classes)), classes] += 1
    bucket, g = bucket_sums(off, rows)
    so_far = spread[bucket] + np.einsum("ij,ij->i", g, g)
    spread[bucket] = so_far
    g *= (RATE / (1 + np.sqrt(so_far)))[:, None]
    g += table.take(bucket, 0)
    table[bucket] = g


def train_words(docs: DataFrame, held_out: Column, base: np.ndarray) -> np.ndarray:
    """Weights of the features of words (bucket, class), on top of the log probabilities ``base`` of classes in class contexts.

    Every task goes once through its training texts in steps of ``STEP_TOKENS`` tokens; the weights of a bucket are the
    mean over the tasks, each counted by its tokens with that bucket. So every text takes part, and what is shuffled is a
    table of fixed size per task.
    """
    base = base.astype(np.float32)

    def run(batches):
        table, spread = np.zeros((WORD_BUCKETS, CLASSES), np.float32), np.zeros(WORD_BUCKETS, np.float32)
        seen = np.zeros(WORD_BUCKETS, np.int64)
        for batch in batches:
            for _, (text,) in text_slices(batch, SLICE_BYTES, batch.num_rows):
                codes, ends, hashes = coded(*words_of(pc.ascii_lower(text)))
                cls, context, (w1, w2) = contexts((hashes & (1 << WORD_BITS) - 1).astype(np.int32)[codes], ends)
                for i in range(0, len(cls), STEP_TOKENS):
                    if i % MANY_TOKENS == 0:
                        rows = word_rows(w2[i:i + MANY_TOKENS], w1[i:i + MANY_TOKENS])
                        seen += np.bincount(rows.ravel(), minlength=WORD_BUCKETS)
                    some, at = slice(i, i + STEP_TOKENS), i % MANY_TOKENS
                    learn_words(table, spread, base.take(context[some], 0), rows[at:at + STEP_TOKENS], cls[some])
                pa.default_memory_pool().release_unused()
        used = np.flatnonzero(seen)
        for at in range(0, len(used), 2048):
            some = used[at:at + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(seen[some]), pa.array([w.astype("<f2").tobytes() for w in table[some]], pa.binary())],
                names=["bucket", "n", "w"],
            )

    def merged(batches):
        total, seen = np.zeros((WORD_BUCKETS, CLASSES)), np.zeros(WORD_BUCKETS, np.int64)
        for batch in batches:
            bucket, n = batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
            w = np.frombuffer(b"".join(batch.column("w").to_pylist()), "<f2").reshape(-1, CLASSES)
            np.add.at(total, bucket, w * n[:, None].astype(float))
            np.add.at(seen, bucket, n)
        used = np.flatnonzero(seen)
        mean = (total[used] / seen[used, None]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([w.tobytes() for w in mean], pa.binary())], names=["bucket", "w"])

    texts = docs.filter(~F.coalesce(held_out, F.lit(False))).select(F.col("text").cast("string").alias("text"))
    parts = texts.mapInArrow(run, "bucket int, n long, w binary").repartition(8, "bucket")
    table = np.zeros((WORD_BUCKETS, CLASSES), np.float32)
    for bucket, w in parts.mapInArrow(merged, "bucket int, w binary").collect():  # at most WORD_BUCKETS rows
        table[bucket] = np.frombuffer(w, "<f4")
    return table


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. ``base_score`` has add-one smoothed
    unigrams of all documents that are not held out. ``score`` multiplies the class in its context (classes and words
    before it) with the word in its class, add-one smoothed alike, with a place for all unknown words in each class. A null or empty text has only its
    end; a null flag is not held out; each row is scored by itself.

    Counts of all distinct words come from one aggregation over the vocabularies of batches, and go back to the batches
    by a join; no vocabulary but that of a batch is ever in one place.
    """
    rows = tokenized(docs, held_out)
    triples = rows.filter("kind = 2").groupBy(F.col("hash").alias("cell")).agg(F.sum("n").alias("n"))
    base = log_classes(train(triples), np.arange(CLASSES**2))
    by_words = train_words(docs, held_out, base)
    words = rows.filter("kind = 1").select("batch", "code", "hash", "n")
    totals = materialize(words.groupBy("hash").agg(F.sum("n").alias("c")))
    sizes, cls = np.zeros((2, CLASSES), np.int64), F.col("hash").bitwiseAND(CLASSES - 1).cast("int")
    for k, n, v in totals.filter("c > 0").groupBy(cls.alias("cls")).agg(F.sum("c"), F.count("*")).collect():
        sizes[:, k] = n, v
    n_all, v_all = (int(x) for x in sizes.sum(1))
    looked_up = words.drop("n").join(totals, "hash").select("batch", "code", F.col("hash").bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("word"), "c")
    in_class = np.log10((sizes.sum(0) + 1).astype(float))
    base = base.astype(np.float32)

    def score_batch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        low, high = (np.frombuffer(b"".join(x[i * len(x) // 2:(i + 1) * len(x) // 2] for x in left["codes"]), "<u2") for i in (0, 1))
        codes = high.astype(np.int32) << 16 | low
        ends = np.cumsum(left["codes"].map(len).to_numpy() // 4)
        count, words = np.zeros(len(right), np.int64), np.zeros(len(right), np.int32)
        place = right["code"].to_numpy()
        count[place], words[place] = right["c"].to_numpy(), right["word"].to_numpy()
        c = count[codes]
        cls, context, (w1, w2) = contexts(words[codes], ends)
        of_class = np.zeros(len(cls))
        for i in range(0, len(cls), STEP_TOKENS):
            some = slice(i, i + STEP_TOKENS)
            z = class_scores(by_words, base.take(context[some], 0), word_rows(w2[some], w1[some]))
            of_class[some] = z[np.arange(len(z)), cls[some]]
            of_class[some] -= np.log(np.einsum("ij->i", np.exp(z, out=z)))
        seen = np.log10(c + 1.0)
        per_token = {
            "n_known": c > 0, "base_score": seen - np.log10(n_all + v_all + 1.0),
            "score": of_class / np.log(10) + seen - in_class[cls],
        }
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        out = {k: np.add.reduceat(v.astype(float), starts) if len(v) else [] for k, v in per_token.items()}
        return pd.DataFrame({
            "doc_id": left["doc_id"].astype("Int64"), "held_out": left["held_out"], "n_tokens": ends - starts,
            "n_known": np.asarray(out["n_known"]).astype(np.int64), "train_tokens": n_all, "base_score": out["base_score"], "score": out["score"],
        })

    texts = rows.filter("kind = 0").select(F.col("batch").alias("of"), "doc_id", "held_out", "codes")
    return texts.groupBy("of").cogroup(looked_up.groupBy("batch")).applyInPandas(
        score_batch,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
