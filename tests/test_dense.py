"""Dense search as matrix products: against a sum in order, with ties, odd rows and several blocks and parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import neighbours as nb
from tideline.operators import retrieval as rt
from tideline.operators.graph import shared_dir


def s(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):  # sum() rounds otherwise
        out += x * y
    return out


def brute(queries, chunks, k, mode):
    out = []
    for q, v in queries:
        hits = []
        for c, w in chunks:
            if w is None or len(w) != len(v) or any(x is None for x in w):
                continue
            score = s(v, w)
            if mode != "inner":
                norm = (s(v, v) * s(w, w)) ** 0.5
                if norm == 0:
                    continue
                score = min(1.0, max(-1.0, score / norm))
            hits.append((-((1 + score) / 2 if mode == "half" else score), c))
        out += [(q, c, -less, i + 1) for i, (less, c) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("mode", ["cosine", "half", "inner"])
def test_dense_against_a_sum_in_order(spark, mode):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 7)).astype("float32").astype(float).tolist()
    chunks = [(i, base[i % 60]) for i in range(150)] + [(900, None), (901, [0.0] * 7), (902, [1.0, None] + [0.0] * 5), (903, [1.0, 2.0])]
    queries = [(i, base[i]) for i in range(0, 60, 7)] + [(70, [0.0] * 7)]
    q = spark.createDataFrame(queries, "query_id long, vector array<float>")
    c = spark.createDataFrame(chunks, "chunk_id long, vector array<float>")
    for block, parts in ((4096, None), (3, 4)):
        got = rt.dense_top_k(q, c, 5, mode, block=block, parts=parts).collect()
        assert sorted(map(tuple, got)) == brute(queries, chunks, 5, mode)


def test_dense_in_one_product(spark):
    """A pair of query and chunk is no row of any plan: as rows they took the time (F1)."""
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "chunk_id long, vector array<double>")
    plan = rt.dense_top_k(q, c, 2)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert [r["chunk_id"] for r in rt.dense_top_k(q, c, 2, where=F.col("chunk_id") < 5).orderBy("rank").collect()] == [4, 3]
    assert [r["chunk_id"] for r in rt.dense_top_k(q, c, 2, where=F.col("chunk_id") != 8, post_filter=True).collect()] == [7]


def test_what_a_walk_missed_is_put_in(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    shared_dir(spark)
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "chunk_id long, vector array<double>")
    queries = chunks.filter("chunk_id % 30 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    true = rt.dense_top_k(queries, chunks, 12)
    walked = true.filter("rank > 2").withColumn("rank", F.col("rank") - 2).checkpoint()  # as of a walk that missed the two nearest
    assert sorted(map(tuple, nb.checked(walked, queries, chunks, 10).collect())) == sorted(map(tuple, true.filter("rank <= 10").collect()))


def test_levels_are_chosen_by_counts(spark):
    """Hits of levels that aren't kept were made and shuffled (F13)."""
    chunks = [(f"c{i}", "abc"[i % 3], f"s{i % 7}" if i % 11 else None) for i in range(40)]
    queries = [(1, "a", "s0"), (2, "b", "s9"), (3, "z", "s1"), (4, None, "s1"), (5, "c", None), (6, "a", "s1")]
    c = spark.createDataFrame(chunks, "chunk_id string, x string, y string")
    q = spark.createDataFrame(queries, "query_id int, x string, y string")
    for least in (1, 2, 3, 20):
        want = set()
        for i, x, y in queries:
            hits = [[n for n, a, b in chunks if x is not None and a == x and (level or y is not None and b == y)] for level in (0, 1)]
            level = next((v for v in (0, 1) if len(hits[v]) >= least), max((v for v in (0, 1) if hits[v]), default=0))
            want |= {(i, level, n) for n in hits[level]}
        got = rt.at_level(q, c, [["x", "y"], ["x"]], least, parts=3).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_first_of_a_key(spark):
    """One task sorted all outputs of a name that each of them has (F27, F32)."""
    from tideline.operators import graph as gr

    rows = spark.createDataFrame([(2, 0, "a", None, "x"), (1, 1, "a", "p", "y"), (1, 0, "b", None, "z"), (1, 2, "a", "q", "w")], "output_id int, n int, entity_id string, name string, etype string")
    found = gr.first_of(rows, "entity_id")
    assert found.columns == ["output_id", "entity_id", "name", "etype"]
    assert {tuple(r) for r in found.collect()} == {(1, "a", "p", "y"), (1, "b", None, "z")}
    assert "Window" not in found._jdf.queryExecution().toString()


def test_objects_by_pattern_and_by_fold(spark):
    from tideline.operators import graph as gr

    deep = '{"a":' * 9 + "1" + "}" * 9
    texts = {'x {"a":{"b":"} \\" {"}} {c}': '{"a":{"b":"} \\" {"}}', deep + "}": deep, '{"a": "unclosed}': None, "no": None, '{\\"}"}': '{\\"}"}', "{{}": None, '{"a":"' + "x" * 50_000 + '"}': '{"a":"' + "x" * 50_000 + '"}'}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", gr.first_object(F.col("t"))).collect()} == texts
