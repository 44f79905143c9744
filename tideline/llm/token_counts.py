"""Operator 9: token counts that follow edits.

A document keeps its pre-tokens in a segment tree: a leaf holds a run of them, every node the sums of characters and tokens
below it. An edit re-encodes the pre-tokens that it touches and the context before it that can change, goes on until a new
boundary meets an old one, replaces those leaves and updates the sums above them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.vocabulary import CONTEXT, default_path, library_encoder, pretokens, vocabulary

LEAF = 64
EDITS = "array<struct<start: long, deleted: long, inserted: string>>"


class Counts(dict):
    """Tokens of a pre-token, encoded once."""

    def __init__(self, path: str) -> None:
        super().__init__({s: 1 for s in vocabulary(path)["special"]})
        self.encode = library_encoder(path).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update({"<|endoftext|>": 1})
        n = self[word] = len(self.encode(word))
        return n


class CountTree:
    def __init__(self, text: str, counts: Counts) -> None:
        self.text, self.counts, self.encoded = text, counts, 0
        words = pretokens().findall(text)
        self._build(list(map(len, words)), list(map(counts.__getitem__, words)))

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(a), sum(b)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds this character (the last one past the end), and where that leaf starts."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if char >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace text[start : start + deleted]; positions past the end are cut to it."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(deleted, 0), len(self.text))
        shift = len(inserted) - (stop - start)
        self.text = self.text[:start] + inserted + self.text[stop:]
        first, old = self._leaf_at(max(0, start - CONTEXT))
        k = 0
        chars = self.leaves[first][0]
        while k < len(chars) and old + chars[k] <= start - CONTEXT:
            old += chars[k]
            k += 1
        new, new_chars, new_tokens = old, [], []
        leaf, m, edge = first, k, start + len(inserted)
        scan = pretokens().finditer(self.text, old)
        while True:
            while old + shift < new or old < stop:  # old boundaries up to this place
                if m < len(self.leaves[leaf][0]):
                    old += self.leaves[leaf][0][m]
                    m += 1
                elif leaf + 1 < len(self.leaves):
                    leaf, m = leaf + 1, 0
                else:
                    break
            if new >= edge and new == old + shift and old >= stop:
                break
            match = next(scan, None)
            if match is None:
                break
            new = match.end()
            new_chars.append(new - match.start())
            new_tokens.append(self.counts[match.group()])
        self.encoded += sum(new_chars)
        head, tail = self.leaves[first], self.leaves[leaf]
        rest = (tail[0][m:], tail[1][m:])
        if first == leaf:
            self._put(first, head[0][:k] + new_chars + rest[0], head[1][:k] + new_tokens + rest[1])
        else:
            self._put(first, head[0][:k] + new_chars, head[1][:k] + new_tokens)
            for i in range(first + 1, leaf):
                self._put(i, [], [])
            self._put(leaf, *rest)
        if len(self.leaves[first][0]) > 4 * LEAF:
            self._build([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])

    def _put(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        i = self.base + leaf
        more, most = sum(chars) - self.chars[i], sum(tokens) - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += most
            i >>= 1


def edited_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, encoded_chars from rows doc_id, text, edits (EDITS, applied in order).

    encoded_chars: characters encoded again for the edits. Null text is empty; null edits, and null fields in one (start 0,
    nothing deleted, nothing inserted), change nothing. Repeated rows give repeated rows; an empty table gives none.
    """
    path = path or default_path()

    def run(batches):
        counts = Counts(path)
        for batch in batches:
            before, after, encoded = [], [], []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = CountTree(text.as_py() or "", counts)
                before.append(tree.n_tokens)
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                after.append(tree.n_tokens)
                encoded.append(tree.encoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (before, after, encoded))], names=["doc_id", "n_tokens", "edited_tokens", "encoded_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, edited_tokens long, encoded_chars long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, made from it alone: a cut in the middle, an insertion, a replaced beginning."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    head = F.coalesce(F.substring("text", 1, 24), F.lit(""))
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), inserted.alias("inserted"))
    return docs.select("doc_id", "text", F.array(edit(F.floor(n / 2), 7, F.lit("")), edit(F.floor(n / 3), 0, head), edit(F.least(n, F.lit(3)), 11, F.lit("It's 2024's <|endoftext|>"))).alias("edits"))
