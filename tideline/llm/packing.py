"""Operator 7: best-fit-decreasing packing of token ids into windows, by a segment tree over remaining capacity.

One pass encodes and cuts: every document gives its full windows and one remainder. Which window a piece goes to depends
on its length alone, so the fit runs over the histogram of lengths (at most ``window`` rows, whatever the corpus): windows
of equal history stand together as ranges, and the result says for each length which ranks go to which range of windows.
Pieces then find their range by (length, rank) with a binary search in a table of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import staged
from tideline.llm.vocabulary import default_path, library_encoder

WINDOW, END_ID = 2048, 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the smallest capacity that is at least a given one."""

    def __init__(self, most: int) -> None:
        self.base = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = self.base + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.base


def best_fit(lengths: dict[int, int], window: int) -> np.ndarray:
    """Rows (length, first rank, number of pieces, first window, offset) of a best-fit-decreasing packing.

    The piece of rank first + i goes to window first + i at that offset. Equal to placing the pieces one by one, longest
    first, each into the fullest window that still takes it. Rows are bounded by a function of window, not of the corpus.
    """
    tree, open_, rows, windows = CapacityTree(window), {}, [], 0
    for size in sorted(lengths, reverse=True):
        rank, left = 0, lengths[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, q = window, window // size
                n = max(1, left // q)
                first, windows = windows, windows + n
            else:
                q = room // size
                ranges = open_[room]
                first, there = ranges.popleft()
                n = min(there, max(1, left // q))
                if n < there:
                    ranges.appendleft((first + n, there - n))
                tree.add(room, -n)
            q = min(q, left)  # a last window may get fewer
            for layer in range(q):
                rows.append((size, rank, n, first, window - room + layer * size))
                rank += n
            left -= q * n
            if rest := room - q * size:
                open_.setdefault(rest, deque()).append((first, n))
                tree.add(rest, n)
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: full windows, then the remainder, with place counted by length inside the task's part."""

    def cut(batches):
        encoder, part, seen = library_encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                for start in range(0, ids.size, window):
                    piece = ids[start : start + window]
                    for column, x in zip(out, (doc_id, start, piece.size, zlib.crc32(piece.tobytes()), ids.size, seen[piece.size]), strict=True):
                        column.append(x)
                    seen[piece.size] += 1
            cols = [pa.array(x, pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([*cols[:5], pa.array([part] * len(out[0]), pa.int32()), cols[5]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of every row of docs.

    Null text is empty and gives the end id alone; repeated rows are packed each; ties in length go by part and place;
    an empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    cut = staged(pieces(docs, path or default_path(), window, end_id))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # At most one row per length, so at most ``window`` rows.
    lengths = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = best_fit(lengths, window)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(rows[order])  # bounded by the window size

    def place(batches):
        table = plan.value
        stride = int(table[:, 1].max(initial=0) + table[:, 2].max(initial=0)) + 1
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            columns = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length * stride + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*columns, "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window: its tokens, and its padded length, which is the window except at a power of two."""
    n = F.sum("length")
    total = packed.groupBy("sequence_id").agg(n.alias("n_tokens"), F.count("*").alias("n_pieces"))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return total.withColumn("padded", F.when(exact, F.col("n_tokens")).otherwise(F.lit(window).cast("long")))
