"""Vocabulary operators against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, packing, token_counts
from tideline.llm.vocabulary import default_path

TEXTS = [
    "", None, " ", "a", "Hello world's  end\n\n ok", "aaaa aaaaa aaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'm you're they'd 've",
    "naïve café 中文字符 😀😀  x　y", "x<|endoftext|>y  <|endoftext|><|endo !!<|endoftext|>!<<|endoftext|", "tab\t\tnew\r\nline   ",
    "12345 67 ½ ² ٣", "é" * 300 + " the the the" * 50, "\x00\x01 \x85 z", "ab" * 5000, "Thtion### oneron*** thand%%% ouin&&& ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def rows(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def clashing(docs):
    """With columns whose names the operators use themselves."""
    return docs.withColumns({n: F.lit("clash") for n in ("ids", "n_tokens", "length", "start", "offset", "sequence_id", "tokens", "doc_tokens", "n_chars")})


def test_odd_rows(spark, library):
    """Null ids, repeated rows, empty tables, clashing columns, and a text longer than a chunk."""
    long = "The quick brown fox. " * 60_000
    docs = clashing(spark.createDataFrame([(None, "a b"), (7, "same text"), (7, "same text"), (8, None), (9, long)], "doc_id long, text string"))
    ids = len(library.encode(long, add_special_tokens=False).ids)
    digests = bpe.digests(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in digests) == [(-1, 2), (7, 2), (7, 2), (8, 0), (9, ids)]
    counts = token_counts.edited_counts(token_counts.sample_edits(docs))
    assert counts.count() == 5 and token_counts.edited_counts(token_counts.sample_edits(docs.limit(0))).count() == 0
    pieces = packing.pack(docs).collect()
    assert sum(r["length"] for r in pieces) == 3 + 3 + 3 + 1 + ids + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_pair_index_equals_library(spark, library):
    docs = clashing(rows(spark, TEXTS + TEXTS))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    for i, t in enumerate(TEXTS + TEXTS):
        assert got[i] == library.encode(t or "", add_special_tokens=False).ids, t
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))


def test_digests(spark, library):
    for r in bpe.digests(rows(spark, TEXTS)).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(rows(spark, [])).count() == 0


def test_count_tree_equals_full_count(library):
    rng = random.Random(1)
    counts = token_counts.Counts(default_path())
    alphabet = ["a", "b", " ", "  ", "'", "s", "re", "\n", "<|endoftext|>", "<|endo", "!", "é", "7", "The", "　"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 5, 60, 900])))
        tree = token_counts.CountTree(text, counts)
        for _ in range(4):
            start, cut, new = rng.randint(0, len(text) + 3), rng.choice([0, 1, 3, 40]), "".join(rng.choices(alphabet, k=rng.choice([0, 1, 4, 300])))
            text = text[:start] + new + text[start + cut :]
            tree.edit(start, cut, new)
            assert tree.text == text
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            assert tree.chars[1] == len(text)


def test_edited_counts(spark, library):
    docs = token_counts.sample_edits(rows(spark, TEXTS))
    got = {r["doc_id"]: r for r in token_counts.edited_counts(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        assert got[r["doc_id"]]["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        for e in r["edits"]:
            text = text[: e["start"]] + e["inserted"] + text[e["start"] + e["deleted"] :]
        assert got[r["doc_id"]]["edited_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
    none = spark.createDataFrame([(1, "a b", None), (2, None, [(None, None, None), None])], "doc_id long, text string, edits " + token_counts.EDITS)
    assert {r["doc_id"]: (r["n_tokens"], r["edited_tokens"]) for r in token_counts.edited_counts(none).collect()} == {1: (2, 2), 2: (0, 0)}


def one_by_one(lengths, window):
    left = []
    for size in sorted((s for s, n in lengths.items() for _ in range(n)), reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(window - size)
    return sorted(left)


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        window = rng.choice([7, 16, 64])
        lengths = {rng.randint(1, window): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        rows_, used = packing.best_fit(lengths, window), {}
        for size, _, n, first, offset in rows_.tolist():
            for w in range(first, first + n):
                used.setdefault(w, []).append((offset, size))
        for parts in used.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[s for _, s in parts][:-1]]).tolist()
        assert one_by_one(lengths, window) == sorted(window - sum(s for _, s in p) for p in used.values())


def test_pack(spark, library):
    texts = TEXTS + ["word " * 5000, "word " * 5000, None]
    got = packing.pack(rows(spark, texts), window=64).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == ids.size
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == ids.size
    for parts in by_window.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(by_window) == list(range(len(by_window)))
    assert packing.pack(rows(spark, [])).count() == 0
    assert packing.sequences(packing.pack(rows(spark, texts), window=64), 64).filter("padded < n_tokens").count() == 0
