"""Helpers shared by the corpus operators: staged tables, word and shingle hashes, Arrow chunks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none and runs on this machine (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        at = sc.getCheckpointDir()
    return at


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- hashing, inside tasks

_ODD = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
#: Powers of an odd number modulo 2**64, for the places of a word's bytes; bytes that are hashed at once.
_POWER = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 14) - 1, _ODD, np.uint64)))
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end).

    data: bytes of documents one after the other; ends: where each document ends.
    """
    word = ~_IS_SPACE[data]
    first = np.zeros(data.size + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[:-1]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (first | ~before))
    after = np.ones_like(word)
    after[:-1] = ~word[1:] | first[1:]
    end = np.flatnonzero(word & after) + 1
    return start, end, np.concatenate([[0], np.searchsorted(start, ends)])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that depends on its bytes alone; spans are in order and don't overlap.

    Worked off in slices, so that memory beside the result is bounded however long a text is (a longer word is a slice).
    """
    out = np.empty(start.size, np.uint64)
    lo = 0
    while lo < start.size:
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE, "right")))
        at, size = int(start[lo]), end[lo:hi] - start[lo:hi]
        place = np.arange(int(end[hi - 1]) - at) - np.repeat(start[lo:hi] - at, np.diff(np.append(start[lo:hi], end[hi - 1])))
        value = _BYTE[data[at : end[hi - 1]]] * _POWER[place & (_POWER.size - 1)]
        if size.max() > _POWER.size:
            value = mix(value + (place // _POWER.size).astype(np.uint64))
        sums = np.zeros(value.size + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        out[lo:hi] = mix(sums[end[lo:hi] - at] - sums[start[lo:hi] - at] + size.astype(np.uint64))
        lo = hi
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; position i covers words i..i+k-1."""
    n = words.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_ODD) + words[j : j + n]
    return mix(out)


def text_chunks(column: pa.Array, size: int = 1 << 19):
    """Pieces (first row, last row, bytes, ends) of a string column, of about size bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi


#: Bits of the size of a bitmap of ids (8 MB).
BITS = 26


def possible(rows: DataFrame, needed: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows without most of those whose column isn't in needed, by a bitmap of 2**BITS hashes: those needn't be shuffled."""
    return told_apart(rows, needed, column).filter("__may").drop("__may")


def told_apart(rows: DataFrame, needed: DataFrame, column: str) -> DataFrame:
    """rows with __may: whether the column may be in needed, by a bitmap of 2**BITS hashes; false only where it isn't."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << BITS)) + 1
    maps = needed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.expr("cast(bitmap_bit_position(__p) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__p", place).withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(maps), "__bucket", "left")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, (F.bitmap_bit_position("__p") % 8).cast("int")) == 1, F.lit(False)).alias("__may"))
