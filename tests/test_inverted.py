"""The stored inverted index against full scores, through loads, replacements, deletions and filters."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.operators.inverted import InvertedIndex, term_counts
from tideline.sources.state import State

SCHEMA = "chunk_id long, text string, lang string"
VOCABULARY = [f"w{i}" for i in range(60)]


def texts(ids, seed):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(VOCABULARY, weights, k=rng.choice([0, 1, 8, 40, 200]))), rng.choice(["en", "de"])) for i in ids]


def split(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def brute(docs, queries, k, fits=lambda d, q: True):
    tf = {d[0]: collections.Counter(split(d[1])) for d in docs}
    dl = {d[0]: sum(tf[d[0]].values()) for d in docs}
    df = collections.Counter(t for c in tf.values() for t in c)
    mean = sum(dl.values()) / len(docs)
    out = []
    for q, text in queries:
        scores = {}
        for d in docs:
            s = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[d[0]][t] * 2.2 / (tf[d[0]][t] + 1.2 * (0.25 + 0.75 * dl[d[0]] / mean)) for t in {*split(text)} if tf[d[0]][t]]
            if s and fits(d, q):
                scores[d[0]] = sum(s)
        top = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, c, r + 1, round(s, 6)) for r, (c, s) in enumerate(top)]
    return sorted(out)


def found(index, queries, **more):
    df = index.spark.createDataFrame(queries, "query_id long, text string")
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 6)) for r in index.search(df, k=5, **more).collect())


QUERIES = [(0, "w0 w1 w2 w50"), (1, "w3"), (2, "w59 w58 w57 W0, w0"), (3, "nothing"), (4, ""), (5, " ".join(VOCABULARY)), (6, "w1 w2")]


def test_term_counts(spark):
    rows = [("b a b. B c",), ("",), (None,), ("...",), ("x " * 3000,)]
    got = [{x["term"]: x["tf"] for x in r[0]} for r in spark.createDataFrame(rows, "text string").select(F.coalesce(term_counts(F.col("text")), F.array())).collect()]
    assert got == [{"b": 3, "a": 1, "c": 1}, {}, {}, {}, {"x": 3000}]


@pytest.mark.parametrize("shard", [8192, 7])
def test_search_equals_full_scores(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr("tideline.operators.inverted.SHARD", shard)
    docs = {d[0]: d for d in texts(range(120), 1)}
    frame = lambda d: spark.createDataFrame(list(d), SCHEMA)
    index = InvertedIndex.create(spark, str(tmp_path / "i"), frame([]), ("lang",), buckets=4)
    assert found(index, QUERIES) == []
    index.add(frame([*docs.values(), (None, "w0", "en")]), 0)
    assert found(index, QUERIES) == brute([*docs.values()], QUERIES, 5) == found(index, QUERIES, prune=True)
    second = texts(range(100, 150), 2)
    index.add(frame(second), 1)
    docs |= {d[0]: d for d in second}
    index.delete(spark.createDataFrame([(3,), (110,), (999,)], "chunk_id long"), 2)
    docs = {i: d for i, d in docs.items() if i not in (3, 110)}
    index = InvertedIndex(spark, index.path)
    assert found(index, QUERIES) == brute([*docs.values()], QUERIES, 5)
    assert found(index, QUERIES, prune=True) == brute([*docs.values()], QUERIES, 5)
    third = texts([3], 3)
    index.add(frame(third), 3)
    index.add(frame(texts([4], 9)), 3)  # the same number: already done
    docs |= {3: third[0]}
    assert found(index, QUERIES) == brute([*docs.values()], QUERIES, 5)
    for prune in (False, True):
        assert found(index, QUERIES, where=F.col("lang") == "de", prune=prune) == brute([*docs.values()], QUERIES, 5, lambda d, q: d[2] == "de")
    assert {r["chunk_id"] for r in index.documents().collect()} == {*docs}


def test_crash_before_the_state(spark, tmp_path, monkeypatch):
    docs = texts(range(30), 4)
    frame = lambda d: spark.createDataFrame(d, SCHEMA)
    index = InvertedIndex.create(spark, str(tmp_path / "i"), frame([]), buckets=4)
    index.add(frame(docs), 0)

    def die(self, value):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(State, "write", die)
        with pytest.raises(RuntimeError):
            InvertedIndex(spark, index.path).add(frame(texts(range(20, 40), 5)), 1)
    assert found(InvertedIndex(spark, index.path), QUERIES) == brute(docs, QUERIES, 5)
    again = InvertedIndex(spark, index.path)
    again.add(frame(texts(range(25, 60), 6)), 1)
    assert found(again, QUERIES) == brute(docs[:25] + texts(range(25, 60), 6), QUERIES, 5)


def test_no_text_is_read(spark, tmp_path):
    docs = spark.createDataFrame(texts(range(30), 7), SCHEMA)
    index = InvertedIndex.create(spark, str(tmp_path / "i"), docs, buckets=4)
    index.add(docs, 0)
    assert not [c for n in ("postings", "docs", "terms", "removed") for c in index.table(n).columns if c == "text"]


def test_a_shard_is_made_where_it_is_read(spark, tmp_path):
    import pyarrow as pa

    from tideline.operators.inverted import inverted

    docs = pa.table({"chunk_id": [7, 3, 5, 9], "w": ["b a b", " é ", None, ""], "lang": ["en", None, "de", "fr"]})
    held, blocks = inverted(docs, 4, ["lang"])
    assert [(r["term"], r["n"], [(p["chunk_id"], p["tf"], p["dl"]) for p in r["posts"]], r["max_tf"], r["min_dl"]) for r in blocks.to_pylist()] == [
        ("a", 1, [(7, 1, 3)], 1, 3), ("b", 1, [(7, 2, 3)], 2, 3), ("é", 1, [(3, 1, 1)], 1, 1)]
    assert [(r["doc"]["chunk_id"], r["doc"]["dl"], r["doc"]["terms"], r["doc"]["lang"]) for r in held.to_pylist()] == [(7, 3, "a b", "en"), (3, 1, "é", None), (5, 0, "", "de"), (9, 0, "", "fr")]
    # No posting is moved to be written, and what a search moves is less than the postings of its terms.
    frame = spark.createDataFrame([(i, "x y z " * 3, "en") for i in range(400)], SCHEMA).repartition(2)
    index = InvertedIndex.create(spark, str(tmp_path / "i"), frame, buckets=4)
    index.add(frame, 0)
    assert {r["n"] for r in index.table("postings").filter("term <> ''").collect()} == {r["n"] for r in index.table("postings").groupBy("shard").agg(F.count("doc").cast("int").alias("n")).collect()}
