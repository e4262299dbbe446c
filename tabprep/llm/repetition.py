"""Quality rules on repetition inside a document, from the suffix array of its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import doc_slices, sums, text_column, words_of

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
SLICE_BYTES = 2_000_000
#: Shares of the words that repeats of 8 words or more may cover, and that the longest of them may have. Words in such
#: repeats lie in the 3-word windows of the base rule as well, so limits of a half or more would reject nothing. At sf0.1
#: no document of quality 1 that passes the base rule is above 0.3 or 0.2.
MAX_COVERED, MAX_LONGEST = 0.3, 0.2
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)


def _ranks(doc: np.ndarray, ends: np.ndarray, codes: np.ndarray):
    """Suffix array of the words of many documents; a suffix ends with its document.

    Returns (order of the suffixes, first word of each group of equal 3-word starts, ranks by length). ``ranks[h]``
    gives two suffixes the same number exactly when their first h words are equal and in the same document. Starts from
    one sort of 3-word windows; then only suffixes that are not yet alone are sorted again, by twice the length each time.
    """
    n = len(codes)
    place = np.arange(n)
    word = codes.astype(np.int64) + 1
    second = np.where(place + 1 < ends, np.concatenate([word[1:], [0]]), 0)
    third = np.where(place + 2 < ends, np.concatenate([word[2:], [0, 0]])[:n], 0)
    top = int(word.max()) + 1
    if top**2 * (int(doc[-1]) + 1) * top < 1 << 62:
        key = ((doc * top + word) * top + second) * top + third
    else:  # too many words for one number: rank the first two words before the third is added
        _, pair = np.unique((doc * top + word) * top + second if top**2 * (int(doc[-1]) + 1) < 1 << 62
                            else np.unique(doc * top + word, return_inverse=True)[1] * top + second, return_inverse=True)
        key = pair * top + third
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.maximum.accumulate(np.where(fresh, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    ranks, h = {3: rank.copy()}, 3
    while True:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, ranks
        some = order[slots]
        later = some + h
        inside = later < ends[some]
        key = rank[some] * (n + 1) + np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots] = some[by]
        key = key[by]
        starts = np.concatenate([[True], np.diff(key) != 0])
        fresh[slots] = starts
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))]
        h *= 2
        ranks[h] = rank.copy()


def longest_repeats(doc: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each word the length of the longest string that starts there and occurs again in its document, if of 3 words or more; else 0.

    It is the larger of the longest common prefixes with the two neighbours in the suffix array: the depth of the
    innermost LCP interval that holds the suffix.
    """
    longest = np.zeros(len(codes), np.int64)
    if len(codes) < 2:
        return longest
    order, ranks = _ranks(doc, ends, codes)
    r3 = ranks[3][order]
    near = np.flatnonzero(r3[1:] == r3[:-1])
    a, b = order[near], order[near + 1]
    shared = np.zeros(len(near), np.int64)
    end = np.maximum(a, b)
    limit = ends[end]
    last = len(codes) - 1

    def extend(same, by):
        nonlocal shared
        fits = end + shared < limit
        x, y = np.minimum(a + shared, last), np.minimum(b + shared, last)
        shared = shared + np.where(fits & (same[x] == same[y]), by, 0)

    for h in sorted(ranks, reverse=True):
        extend(ranks[h], h)
    extend(codes, 1)
    extend(codes, 1)
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def covered(longest: np.ndarray, least: int, at_most: int | None = None) -> np.ndarray:
    """Whether a word lies in the union of the repeated strings of at least ``least`` words."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    sizes = longest[starts] if at_most is None else np.minimum(longest[starts], at_most)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _measures(text: pa.Array, least_words: int) -> list[np.ndarray]:
    codes, offsets, words = words_of(text)
    n_docs = len(text)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    ends = offsets[doc + 1]
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    marks = pc.count_substring_regex(words, "[#*$%&|<>]").to_numpy(zero_copy_only=False)
    longest = longest_repeats(doc, ends, codes)
    lines = pc.split_pattern(text, "\n")
    line_doc = np.repeat(np.arange(n_docs), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten()
    filled = pc.match_substring_regex(flat, "[^ \\t-\\r]")
    line_doc = line_doc[filled.to_numpy(zero_copy_only=False)]
    kept = flat.filter(filled).dictionary_encode()
    line = kept.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.unique(line_doc * (len(kept.dictionary) + 1) + line) // (len(kept.dictionary) + 1)
    dup_lines = np.bincount(line_doc, minlength=n_docs) - np.bincount(own, minlength=n_docs)
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, doc, np.where(longest >= least_words, longest, 0))
    return [
        np.diff(offsets), sums(chars[codes], offsets), sums(marks[codes], offsets), dup_lines,
        sums(covered(longest, 3, 3), offsets), sums(covered(longest, least_words), offsets), most,
    ]


def measure(docs: DataFrame, text: str = "text", least_words: int = 8, prefix: str = "") -> DataFrame:
    """All columns and the measures of each whole text, as ``MEASURES`` with ``prefix`` before each name.

    Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none. ``covered_words`` counts the words inside repeated
    strings of at least ``least_words`` words, ``longest_repeat`` is the longest of them (0 if there is none).
    A row is measured by itself, so repeated rows and ids need no rule.
    """
    if least_words < 3:
        raise ValueError("least_words must be at least 3")
    names = [m.split()[0] for m in MEASURES.split(", ")]
    clash = {prefix + n for n in names} & set(docs.columns)
    if clash:
        raise ValueError(f"columns would be overwritten, choose another prefix: {sorted(clash)}")

    def run(batches):
        for batch in batches:
            texts = text_column(batch, text)
            for at, to in doc_slices(texts, SLICE_BYTES):
                found = _measures(texts.slice(at, to - at), least_words)
                part = pa.Table.from_batches([batch.slice(at, to - at)])
                for name, values in zip(names, found, strict=True):
                    part = part.append_column(prefix + name, pa.array(values.astype(np.int64)))
                yield from part.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", " + ", ".join(prefix + m for m in MEASURES.split(", ")))


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of them in 3-word windows that occur again."""
    n = F.col(prefix + "n_words")
    return (n < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * n)


def passes(max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, prefix: str = "") -> Column:
    """At most these shares of the words are covered by repeated strings, and in the longest of them."""
    n = F.col(prefix + "n_words")
    return (F.col(prefix + "covered_words") <= max_covered * n) & (F.col(prefix + "longest_repeat") <= max_longest * n)


def apply_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, **options) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``; see ``measure``."""
    prefix = options.get("prefix", "")
    return measure(docs, **options).withColumns(
        {prefix + "base_failed": base_failed(prefix), prefix + "kept": ~base_failed(prefix) & passes(max_covered, max_longest, prefix)}
    )
