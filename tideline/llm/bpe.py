"""Operator 10: byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch stand in one array of symbols with links to their neighbours. An index maps every
mergeable pair to all its positions; pairs are applied in ascending rank, each at all its positions at once, and the lists
of the pairs that this makes or breaks are updated. Documents are then gathered from their pre-tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.vocabulary import SPECIAL, default_path, pretokens, vocabulary

#: Pre-tokens that a task remembers before it starts anew; bounds memory, never changes a result.
REMEMBERED = 300_000


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if ends.size else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class PairIndex:
    def __init__(self, path: str) -> None:
        v = vocabulary(path)
        self.special = v["special"]
        self.byte = np.array([v["ids"][bytes([b])] for b in range(256)], np.int64)
        self.merges = v["merges"]
        keys = self.merges[:, 0] << 32 | self.merges[:, 1]
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.int64(2**62))
        self.text = np.frombuffer(b"".join(v["text"]), np.uint8)
        self.text_length = np.array([len(s) for s in v["text"]], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        length = np.array([len(w) for w in words], np.int64)
        n = int(length.sum())
        symbol = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(length)
        filled = length > 0
        after[ends[filled] - 1] = n
        before[(ends - length)[filled]] = n
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            right = symbol[after[at]]
            key = np.where(right >= 0, symbol[at] << 32 | right, -1)
            found = np.searchsorted(self.keys, key)
            hit = self.keys[found] == key
            at, rank = at[hit], self.order[found[hit]]
            if not at.size:
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), at.size]
            for lo, hi in zip(cuts, cuts[1:]):
                r = int(rank[lo])
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(ranks, r)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right, merged = self.merges[r]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and at.size > 1:  # of overlapping pairs the leftmost go first
                new_run = np.append(True, after[at[:-1]] != at[1:])
                place = np.arange(at.size)
                at = at[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            if not at.size:
                continue
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone] = merged, -2
            after[at], before[then] = then, at
            prior = before[at]
            note(np.unique(np.concatenate([prior[prior < n], at])))
        alive = symbol[:-1] >= 0
        kept = np.append(0, np.cumsum(alive))
        return symbol[:-1][alive].astype("<u4"), kept[ends] - kept[ends - length]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.text, self.text_start[ids], self.text_length[ids]).tobytes().decode("utf-8", "replace").encode()


class Memory:
    """Ids of the pre-tokens that a task has met."""

    def __init__(self, path: str) -> None:
        self.pairs, self.find = _pair_index(path), pretokens().findall
        self.clear()

    def clear(self) -> None:
        special = self.pairs.special
        self.place = {s: i for i, s in enumerate(special)}
        self.flat = np.array([*special.values()], "<u4")
        self.length = np.ones(len(special), np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        flat, length = self.pairs.encode([w.encode() for w in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])

    def ids(self, texts: list[str]):
        """Ids of each text; texts are taken in groups of bounded size."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 8 << 20):
                size += len(texts[hi])
                hi += 1
            if len(self.place) > REMEMBERED:
                self.clear()
            words = [self.find(t) for t in texts[lo:hi]]
            self.learn({w for x in words for w in x})
            start = np.cumsum(self.length) - self.length
            for x in words:
                at = np.fromiter(map(self.place.__getitem__, x), np.int64, len(x))
                yield gather(self.flat, start[at], self.length[at])
            lo = hi


@functools.lru_cache(maxsize=2)
def _pair_index(path: str) -> PairIndex:
    return PairIndex(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text. Null or empty text gives an empty array."""
    path = path or default_path()

    def run(batches):
        memory = Memory(path)
        for batch in batches:
            ids = list(memory.ids([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: texts of the ids of encode(); null ids give null."""
    path = path or default_path()

    def run(batches):
        pairs = _pair_index(path)
        for batch in batches:
            texts = [None if x is None else pairs.decode(np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes, then decodes, without keeping the ids.

    Null or empty text has no ids and the digest of nothing; repeated rows give repeated rows; an empty table gives none.
    """
    path = path or default_path()

    def run(batches):
        memory = Memory(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in memory.ids([t or "" for t in batch.column(1).to_pylist()]):
                n.append(ids.size)
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(memory.pairs.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


__all__ = ["SPECIAL", "PairIndex", "decode", "digests", "encode"]
