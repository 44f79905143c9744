"""Small-world graphs against exact search, and the batch scorer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import neighbours as nb
from tideline.operators import retrieval as rt
from tideline.operators.graph import cut


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], "clash") for i, r in enumerate(x)], "chunk_id long, vector array<double>, part string")


@pytest.mark.parametrize("kind", ["even", "groups"])
def test_graph_recall_and_what_is_scored(spark, kind):
    rng = np.random.default_rng(4)
    n = 6000
    x = rng.normal(size=(n, 32))
    if kind == "groups":
        x = x[rng.integers(0, 60, n)] + 0.2 * x
    chunks, queries = frame(spark, x), frame(spark, rng.permutation(x)[:40] + 0.01).select(F.col("chunk_id").alias("query_id"), "vector")
    index = cut(nb.graph_index(chunks, part_rows=2500))
    assert index.count() == n and index.select("part").distinct().count() == 3
    got = nb.graph_top_k(queries, index, 10, width=48).toPandas()
    want = rt.dense_top_k(queries, chunks.select("chunk_id", "vector"), 10).toPandas()
    both = got.merge(want, on=["query_id", "chunk_id"])
    assert len(both) >= 0.9 * len(want) and np.allclose(both["score_x"], both["score_y"])
    assert got.groupby("query_id")["rank"].apply(sorted).map(lambda r: r == [*range(1, 11)]).all()
    cells = 12 / 16  # what the coarse cells score by default
    assert got.groupby("query_id")["n_scored"].first().mean() < 0.6 * cells * n


def test_graph_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])]
    index = cut(nb.graph_index(spark.createDataFrame(rows, "chunk_id long, vector array<double>")))
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None)], "query_id string, vector array<double>")
    assert [tuple(r)[:4] for r in nb.graph_top_k(q, index, 10).orderBy("rank").collect()] == [("a", 1, 1.0, 1), ("a", 4, 1.0, 2), ("a", 5, 0.0, 3)]


def test_batch_scorer(spark):
    def load():
        loaded = []  # one for each call of load()

        def model(queries, texts):
            loaded.append(1)
            return [len(q) * 1000 + len(t) + len(loaded) * 0 for q, t in zip(queries, texts, strict=True)]

        return model

    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, chunk_id long")
    docs = spark.createDataFrame(pd.DataFrame({"chunk_id": [1, 2, 3], "text": ["a", None, "abc"]}))
    got = rt.rerank(hits, spark.createDataFrame([(1, "qq")], "query_id long, text string"), docs, 2, rt.batch_scorer(load)).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(3, 2003.0), (1, 2001.0)]
