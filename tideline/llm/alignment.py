"""Operator 11: alignment of two tokenizers' tokens by pointer jumping.

A is a byte-level BPE vocabulary, B a piece vocabulary with byte fallback; both cut the same bytes. Every token points to the
token of the other side that overlaps it and reaches farthest to the right, if that ends later; where both end together A's
points to B's. Doubling the pointers of all tokens of a batch at once leads each token to the last one of its component, which
names its group.

Of two tokens that end together one's bytes are the end of the other's, so the pairs that can occur are known from the
vocabularies alone, and number them: a table of their counts has a bounded size whatever the corpus, and is sent to all tasks.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import gather
from tideline.llm.common import staged
from tideline.llm.vocabulary import default_path, library_encoder, vocabulary

#: Characters of text that are aligned at once (a longer text is taken alone).
TEXT = 1 << 18
#: How the piece vocabulary writes a space, and its byte pieces. Fixed values.
BLANK = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Flat:
    """Byte strings by id, one after the other."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.start[ids], self.length[ids])


class Pair:
    """Both vocabularies, and the pairs of ids whose tokens can end together."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a, self.b = library_encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        known = vocabulary(a_path)
        special = {*known["special"].values()}
        a_bytes = [b"" if i in special else t for i, t in enumerate(known["text"])]
        b_bytes = [self._bytes(i) for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = Flat(a_bytes), Flat(b_bytes)
        keys = []
        for x, y, flip in ((a_bytes, b_bytes, False), (b_bytes, a_bytes, True)):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(y):
                if t:
                    ids.setdefault(t, []).append(i)
            for i, t in enumerate(x):
                for k in range(len(t)):
                    keys += [(j << 16 | i) if flip else (i << 16 | j) for j in ids.get(t[k:], ())]
        #: Sorted a << 16 | b of every pair that can occur.
        self.pairs = np.unique(np.array(keys, np.int64))
        decimal = [str(i) + s for s in ",|;" for i in range(max(len(a_bytes), len(b_bytes)))]
        self.decimal, self.most = Flat([d.encode() for d in decimal]), max(len(a_bytes), len(b_bytes))

    def _bytes(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode()


@functools.lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def covering(end: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that it belongs to."""
    return np.repeat(np.arange(end.size), np.diff(end, prepend=0))


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the number of its group, from 0; ends are byte offsets, ascending, over the same bytes."""
    n = a_end.size
    # The token of the other side that covers a token's last byte reaches farthest to the right of all that overlap it.
    to_b, to_a = covering(b_end)[a_end - 1], covering(a_end)[b_end - 1]
    after = np.concatenate([n + to_b, np.where(a_end[to_a] > b_end, to_a, n + np.arange(b_end.size))])
    while True:
        then = after[after]
        if np.array_equal(then, after):
            break
        after = then
    last = after - n  # terminals are B tokens, in order of their places
    names = np.unique(last)
    group = np.searchsorted(names, last)
    return group[:n], group[n:]


def aligned(texts: list[str], p: Pair) -> list[tuple]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, and the numbers of its linked pairs."""
    nothing = (0, 0, 0, 0, "", b"")
    out = [nothing] * len(texts)
    here = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in here]
    a = [np.array(p.a.encode_ordinary(t), np.int64) for t in spaced]
    b = [np.array(x, np.int64) for x in p.b.encode([texts[i] for i in here], num_threads=1)]
    size = lambda flat, ids: int(flat.length[ids].sum())
    same = []
    for k, t in enumerate(spaced):
        raw = t.encode()
        if a[k].size and b[k].size and size(p.a_bytes, a[k]) == size(p.b_bytes, b[k]) == len(raw) and p.a_bytes.joined(a[k]).tobytes() == raw and p.b_bytes.joined(b[k]).tobytes() == raw:
            same.append(k)
    if not same:
        return out
    a_of, b_of = np.array([a[k].size for k in same]), np.array([b[k].size for k in same])
    a, b = np.concatenate([a[k] for k in same]), np.concatenate([b[k] for k in same])
    # Byte offsets run on over the texts, whose ends are ends of both sides.
    a_end, b_end = np.cumsum(p.a_bytes.length[a]), np.cumsum(p.b_bytes.length[b])
    a_group, b_group = components(a_end, b_end)
    n_groups = int(b_group[-1]) + 1
    met = covering(b_end)[a_end - 1]
    linked = np.flatnonzero(b_end[met] == a_end)
    numbers = np.searchsorted(p.pairs, a[linked] << 16 | b[met[linked]]).astype("<i4")
    text_of = np.repeat(np.arange(len(same)), a_of)
    links = np.bincount(text_of[linked], minlength=len(same))
    groups = np.bincount(np.repeat(np.arange(len(same)), b_of)[np.append(np.flatnonzero(np.diff(b_group)), b.size - 1)], minlength=len(same))
    # Tokens as they are written: A's of a group, then B's; each with the sign after it.
    a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    written = np.empty(a.size + b.size, np.int64)
    a_last, b_last = np.append(np.diff(a_group) > 0, True), np.append(np.diff(b_group) > 0, True)
    written[np.arange(a.size) + (np.cumsum(b_in) - b_in)[a_group]] = a + p.most * a_last
    written[np.arange(b.size) + np.cumsum(a_in)[b_group]] = b + 2 * p.most * b_last
    lo, at = 0, 0
    for k, i in enumerate(same):
        tokens = written[lo : lo + a_of[k] + b_of[k]]
        lo += tokens.size
        digest = hashlib.sha256(p.decimal.joined(tokens)[:-1].tobytes()).hexdigest()
        out[here[i]] = (int(a_of[k]), int(b_of[k]), int(groups[k]), int(links[k]), digest, numbers[at : at + links[k]].tobytes())
        at += int(links[k])
    return out


def grouped(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, linked (int32 numbers of pairs) of every row."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]

    def run(batches):
        p = pair(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n < TEXT):
                    n += len(texts[hi] or "")
                    hi += 1
                rows = [(i, *x) for i, x in zip(ids[lo:hi], aligned(texts[lo:hi], p), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked binary")


def pair_counts(found: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (its number), n: links of the whole corpus by pair; summed in every task first, so as many rows as pairs at most."""

    def run(batches):
        total = np.zeros(pair(a_path, b_path).pairs.size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, np.frombuffer(x.as_py(), "<i4"), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return found.select("linked").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    Null and empty texts, and texts that either vocabulary doesn't give back byte for byte, have zeros and the digest ''. Null
    ids stay null; repeated rows count each, in the links' counts too; other columns are ignored; an empty table gives none.
    Whole texts of any length are aligned: memory goes with the longest text beside a batch.

    Texts are encoded once: what the counts need of each is written to the shared folder. The counts are at most one number for
    each pair that the vocabularies allow (Pair.pairs), and only these go through the driver.
    """
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    found = staged(grouped(docs, a_path, b_path))
    spark = docs.sparkSession
    counts = pair_counts(found, a_path, b_path).toArrow()
    known = spark.sparkContext.broadcast((counts.column("pair").to_numpy(), counts.column("n").to_numpy()))

    def run(batches):
        pairs = pair(a_path, b_path).pairs
        total = np.zeros(pairs.size, np.int64)
        total[known.value[0]] = known.value[1]
        top = np.zeros(1 << 16, np.int64)
        np.maximum.at(top, pairs & 0xFFFF, total)
        best = total == top[pairs & 0xFFFF]
        for batch in batches:
            each = [np.frombuffer(x.as_py(), "<i4") for x in batch.column("linked")]
            sums = [pa.array([int(v[x].sum()) for x in each], pa.int64()) for v in (best, total)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
