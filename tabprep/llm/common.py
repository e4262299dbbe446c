"""Small helpers shared by the operators: word splitting of Arrow batches, slices of bounded size, stages."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.storage import materialize, settings

__all__ = [
    "cell_count", "crc_remainder", "doc_slices", "known_labels", "labelled", "labelled_texts", "materialize", "size_slices",
    "sorted_distinct", "sums", "table", "text_column", "text_slices", "worker_store", "words_of",
]

#: Spark's own Bloom filters in joins by shuffle: at any size of the larger side, for four million ids of the smaller.
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as Arrow strings, null as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def doc_slices(text: pa.Array, chars: int):
    """(from, to) row ranges of about ``chars`` bytes of text; a longer text is a range of its own."""
    return size_slices(pc.binary_length(text).to_numpy(zero_copy_only=False), chars)


def size_slices(sizes: np.ndarray, most: int):
    """(from, to) ranges of a total size of about ``most``; a larger item is a range of its own."""
    ends = np.cumsum(sizes.astype(np.int64))
    at, n = 0, len(ends)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def text_slices(batch: pa.RecordBatch, chars: int, rows: int, names: tuple[str, ...] = ("text",)):
    """(from, texts of each named column) for slices of a batch: about ``chars`` bytes of text and at most ``rows`` rows.

    Only one slice at a time is turned into Arrow strings; the memory of earlier ones is given back.
    """
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    for start, end in size_slices(sizes, chars):
        for at in range(start, end, rows):
            n = min(end, at + rows) - at
            # Taken rather than sliced: a slice cast to large strings keeps its first offset, which kernels misread.
            some = pa.array(np.arange(at, at + n))
            yield at, [pc.fill_null(c.take(some).cast(pa.large_string()), "") for c in columns]
    pa.default_memory_pool().release_unused()


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes, the first code of each text (one more than texts), the words."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    filled = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(filled, min_count=0).as_py():
        kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        offsets = kept[offsets]
        flat = flat.filter(filled)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes first; sorting millions of integers takes a fifth of its time."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so tasks of one worker share loaded models and caches."""
    holder = sys.modules.setdefault("_tabprep_worker_store", types.ModuleType("_tabprep_worker_store"))
    return holder.__dict__.setdefault(name, {})


def cell_count(df: DataFrame, rows_per_cell: int) -> int:
    """Number of cells of about ``rows_per_cell`` rows."""
    return max(1, -(-df.select(F.lit(1)).count() // rows_per_cell))


def crc_remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo the divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))


def labelled(docs: DataFrame, labels: DataFrame, label: str, column: str = "text") -> DataFrame:
    """(doc_id, ``column``, y) of all labelled documents.

    Labels that are null or neither 0 nor 1 are no labels; an id that repeats in ``labels`` has the larger one.
    """
    return docs.select("doc_id", column).join(known_labels(labels, label), "doc_id")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): one row for each id with a label."""
    y = F.col(label).cast("int")
    return labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy("doc_id").agg(F.max(y).alias("y"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``labelled``, written once; texts of other ids are dropped by a Bloom filter of the labelled ids before the shuffle.

    The filter has a fixed size. With more ids than it is made for it lets more texts pass; the join decides.
    """
    # Spark filters by ids only where their side has a condition of its own.
    known = materialize(known_labels(labels, label)).filter(F.col("y") >= 0)
    with settings(docs.sparkSession, _BLOOM):
        return materialize(docs.select("doc_id", "text").join(known, "doc_id"))
