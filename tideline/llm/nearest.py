"""Operator 12: nearest neighbours by multi-index hashing of learned, rotated binary codes.

Vectors are centred, turned by a rotation that is learned to lose least when coordinates become signs, and kept as codes of up
to 64 bits. Codes are cut into substrings of 16 bits, each with an index of its own. Codes within m (s + 1) - 1 bits of a
query's agree with it in one of m substrings up to s bits (pigeonhole), so probing all substrings within s bits of the query's
finds every code within that radius; what is found is ranked by the floats.

How far a query has to probe is learned too: ``needed`` tells by distance within how many bits SURE of the vectors at that
distance lie. A query stops as soon as its radius covers what its k-th distance so far needs; nothing is cut off before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: Rows that the rotation and ``needed`` are learned from, at most.
SAMPLE = 4096
#: Bits of a substring, and of a code at most.
PIECE, BITS = 16, 64
#: Share of the vectors at a distance that a radius has to cover.
SURE = 0.95
#: Rows of a part of the index, about: what a task holds.
PART_ROWS = 1 << 19


@dataclass
class Codes:
    """mean, rotation (dims x bits), and needed radius by bins of distance up to ``far``."""

    mean: np.ndarray
    rotation: np.ndarray
    needed: np.ndarray
    far: float

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation > 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """uint64 codes."""
        bits = np.zeros((len(x), 64), np.uint8)
        bits[:, : self.bits] = self.signs(x)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()

    def radius(self, distance: float) -> int:
        if not np.isfinite(distance):
            return self.bits
        return int(self.needed[min(int(distance / self.far * (self.needed.size - 1)), self.needed.size - 1)]) if self.far else self.bits


def learn(x: np.ndarray, turns: int = 30, bins: int = 65, seed: int = 7) -> Codes:
    """Principal directions, then the rotation by alternating signs and the nearest rotation to them (iterative quantisation)."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    bits = min(BITS, dims)
    mean = x.mean(axis=0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    main = vectors[:, ::-1][:, :bits]
    y = (x - mean) @ main
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(turns):
        u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    codes = Codes(mean, main @ turn, np.zeros(bins, np.int64), 0.0)
    # Pairs at all distances: points on the way from one row of the sample to another, of a length between theirs.
    size = lambda v: np.linalg.norm(v, axis=1, keepdims=True)
    a, b, t = x[rng.integers(n, size=16 * SAMPLE)], x[rng.integers(n, size=16 * SAMPLE)], rng.random((16 * SAMPLE, 1))
    on_way = a + t * (b - a)
    long = size(on_way)
    on_way = np.divide(on_way * (size(a) * (1 - t) + size(b) * t), long, out=on_way, where=long > 0)
    apart, bits_apart = size(a - on_way).ravel(), (codes.signs(a) != codes.signs(on_way)).sum(axis=1)
    codes.far = float(apart.max(initial=0.0))
    if codes.far:
        place = (apart / codes.far * (bins - 1)).astype(np.int64)
        for i in range(bins):
            here = bits_apart[place == i]
            codes.needed[i] = np.ceil(np.quantile(here, SURE)) if here.size else 0
        codes.needed = np.maximum.accumulate(codes.needed)
    return codes


#: All masks of a substring by their number of bits, and where each number begins.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint32)), kind="stable")
_FIRST = np.searchsorted(np.bitwise_count(_MASKS.astype(np.uint32)), np.arange(PIECE + 2))


class Part:
    """An index of some of the vectors: for each substring, the values that occur and the rows of each value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes) -> None:
        self.ids, self.x, self.codes, self.code = ids, x, codes, codes.of(x)
        self.pieces = -(-codes.bits // PIECE)
        self.rows, self.starts, self.values = [], [], []
        for j in range(self.pieces):
            value = self.piece(self.code, j)
            counts = np.bincount(value, minlength=1 << PIECE)
            self.rows.append(np.argsort(value, kind="stable"))
            self.starts.append(np.append(0, np.cumsum(counts)))
            self.values.append(np.flatnonzero(counts))

    @staticmethod
    def piece(code, j: int):
        return (code >> np.uint64(PIECE * j) & np.uint64((1 << PIECE) - 1)).astype(np.int64)

    def probed(self, code: np.uint64, s: int, met: np.ndarray) -> np.ndarray:
        """Rows of which a substring differs from the query's in s bits exactly, and that weren't met before.

        Where more values are that far than occur at all, the values that occur are looked through instead.
        """
        found = []
        for j in range(self.pieces):
            value = self.piece(code, j)
            if _FIRST[s + 1] - _FIRST[s] > self.values[j].size:
                there = self.values[j][np.bitwise_count(self.values[j] ^ value) == s]
            else:
                there = value ^ _MASKS[_FIRST[s] : _FIRST[s + 1]]
            lo = self.starts[j][there]
            n = self.starts[j][there + 1] - lo
            rows = self.rows[j][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            rows = rows[~met[rows]]
            met[rows] = True
            found.append(rows)
        return np.concatenate(found)

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found."""
        code = self.codes.of(q[None])[0]
        met = self.ids == query_id
        rows, bits = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        near, dist = rows, np.zeros(0)
        needed = self.codes.bits
        for s in range(PIECE + 1):
            new = self.probed(code, s, met)
            rows, bits = np.concatenate([rows, new]), np.concatenate([bits, np.bitwise_count(self.code[new] ^ code)])
            covered = self.codes.bits if s == PIECE else min(self.codes.bits, self.pieces * (s + 1) - 1)
            while True:
                # Nearer codes first: they shorten what the rest has to reach.
                reach = min(covered, needed)
                if dist.size < k and rows.size > k:
                    reach = min(reach, int(np.partition(bits, k - dist.size)[k - dist.size]))
                take = bits <= reach
                if not take.any():
                    break
                near, dist = self.ranked(q, np.concatenate([near, rows[take]]), k)
                rows, bits = rows[~take], bits[~take]
                if dist.size == k:
                    needed = self.codes.radius(dist[-1])
            if covered >= needed:
                break
        return self.ids[near], dist

    def ranked(self, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of some rows, and their distances."""
        dist = np.concatenate([np.sqrt(((self.x[rows[i : i + 4096]] - q) ** 2).sum(axis=1)) for i in range(0, rows.size, 4096)])
        if rows.size > k:
            at = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
            rows, dist = rows[at], dist[at]
        by = np.lexsort((self.ids[rows], dist))[:k]
        return rows[by], dist[by]


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column | None = None, k: int = 10, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``queries`` (over vec_id) picks, by Euclidean distance.

    vectors: vec_id, embedding. The query's own id is no candidate; ties go to the smaller id; with fewer candidates all come.
    Null ids, and vectors that are null, zero, of null or non-finite components, or of another length than most of the sample
    take no part. Of repeated ids the smallest vector counts. Other columns are ignored; an empty table gives no rows.

    The index is dealt over parts by id, each of bounded size; a part's rows come first to its task, then the queries, streamed.
    """
    spark = vectors.sparkSession
    queries = F.pmod("vec_id", F.lit(100)) == 0 if queries is None else queries
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))
    rows = staged(rows)  # read for the sample, the count, the index and the queries
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    out = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], out)
    lengths = pd.Series(map(len, chosen)).value_counts()
    dims = int(lengths[lengths == lengths.max()].index.max())
    codes = learn(np.array([v for v in chosen if len(v) == dims]))
    rows = rows.filter(F.size("v") == dims)

    n = rows.count()
    parts = max(-(-n // part_rows), min(spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    index = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(0).alias("turn"), "vec_id", "v")
    asked = rows.filter("asked").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("turn"), "vec_id", "v")
    dealt = index.union(asked).repartition(parts, "part").sortWithinPartitions("part", "turn", "vec_id")
    found = dealt.mapInArrow(_answers(codes, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(codes: Codes, k: int):
    """Over rows (part, turn, vec_id, v) by part and turn: a part's index is built of turn 0, then turn 1 is asked row by row."""
    dims = codes.mean.size

    def run(batches):
        ids, xs, part, now = [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, turn, vec = (batch.column(i).to_numpy() for i in range(3))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(turn) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if part != of[lo]:
                    ids, xs, part, now = [], [], of[lo], None
                if turn[lo] == 0:
                    ids.append(vec[lo:hi])
                    xs.append(flat[lo:hi].astype(np.float64))
                    continue
                if now is None and ids:
                    now = Part(np.concatenate(ids), np.concatenate(xs), codes)
                    ids, xs = [], []
                if now is None:
                    continue
                found = [(int(vec[r]), *now.nearest(vec[r], flat[r], k)) for r in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [f[1].size for f in found]), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    return run
