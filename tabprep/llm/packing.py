"""Best-fit decreasing packing of token windows into sequences of a fixed capacity."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import cell_count, materialize, text_column
from tabprep.llm.encoding import encoded

#: Part windows packed by one task; a task holds some numbers for each, and leaves at most a few windows half full.
PIECES_PER_CELL = 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, capacity: int) -> DataFrame:
    """Cut each document's ids (its end id included) into full windows and a rest: one row per piece.

    A null or empty text has only the end id. A null doc_id stays null. Repeated rows are documents of their own.
    """

    def cut(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, lengths in encoded(text_column(batch), tokenizer, byte_level, end_id):
                rows, first = [], 0
                for doc, n in zip(doc_ids[at:at + len(lengths)], lengths.tolist(), strict=True):
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        crc = crc32(ids[first + start:first + start + size])
                        rows.append((doc, start, size, crc, n))
                    first += n
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, the longest first, each into the fullest window that takes it.

    A segment tree over the remaining capacities 0..capacity holds in each node how many open windows lie below it;
    the tightest window is the leftmost filled leaf at or right of the length.
    """
    width = 1 << capacity.bit_length()
    tree = [0] * (2 * width)
    open_windows: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def change(leaf: int, by: int) -> None:
        node = leaf + width
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """Smallest remaining capacity of at least ``need`` with an open window; -1 if there is none."""
        node = need + width
        while not tree[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node >>= 1
            if not node:
                return -1
            node += 1
            if node & (node - 1) == 0:  # walked past the last leaf of a level
                return -1
        while node < width:
            node *= 2
            if not tree[node]:
                node += 1
        return node - width

    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tightest(size)
        if room < 0:
            number, room, made = made, capacity, made + 1
        else:
            number = open_windows[room].pop()
            change(room, -1)
        window[i], offset[i] = number, capacity - room
        if room > size:
            open_windows[room - size].append(number)
            change(room - size, 1)
    return window, offset


def pack(docs: DataFrame, tokenizer: str, byte_level: bool = True, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    Full windows are sequences already and meet no other row. The rests are dealt evenly by row number to cells of about
    ``PIECES_PER_CELL`` pieces, and each cell is packed by itself: more input means more cells, not larger ones, and the
    loss is a few part-filled sequences per cell. ``sequence_id`` is odd for full windows, even for packed ones.
    An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = materialize(token_pieces(docs, tokenizer, byte_level, end_id, capacity))
    numbered = pieces.withColumn("piece", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") == capacity)
    rest = numbered.filter(F.col("length") < capacity)
    cells = cell_count(rest, PIECES_PER_CELL)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack_cell(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece", ignore_index=True)
        window, offset = best_fit_decreasing(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=2 * (window * cells + int(key[0])), offset=offset)[names]

    packed = (
        rest.withColumn("cell", F.pmod(F.xxhash64("piece"), F.lit(cells)))
        .groupBy("cell")
        .applyInPandas(pack_cell, f"{_PIECE}, sequence_id long, offset long")
    )
    alone = full.select(
        *names[:5], (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return alone.unionByName(packed)
