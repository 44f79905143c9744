"""Stored chunk table: against the batch upsert, after crashes, and its plans."""

import re

import pytest
from pyspark.sql import functions as F

from tideline.sources.chunk_table import ChunkTable
from tideline.sources.documents import upsert
from tideline.sources.state import State
from tideline.streaming.usage import upsert_stream

SCHEMA = "chunk_id string, doc_id long, society string, chapter_section string, version_year int, text string"
SOCIETIES = ["DNV", "ABS", "CCS", None]


def rows(spark, ids, mark=0):
    return spark.createDataFrame([(f"c{i}", i // 3, SOCIETIES[(i + mark) % 4], f"Pt.{i % 5}", 2010 + (i + mark) % 9, f"text {i} of {mark}") for i in ids], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return ChunkTable.create(spark, str(tmp_path / "t"), rows(spark, []), buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def everything(df):
    return sorted(map(tuple, df.select("chunk_id", "doc_id", "society", "chapter_section", "version_year", "text").collect()), key=str)


def test_equals_batch_upsert(spark, table):
    loads = [rows(spark, range(300)), rows(spark, range(200, 350), 1), rows(spark, [5, 299, 349, 349], 2)]
    want = None
    for n, load in enumerate(loads):
        table.load(load, n)
        load = load.distinct().withColumn("load_no", F.lit(n))
        want = load if want is None else upsert(want, load)
        assert everything(ChunkTable(spark, table.path).rows()) == everything(want)
        if n == 1:
            table.compact()
            assert everything(table.rows()) == everything(want)
    n_gone = {r["doc_id"]: r["n_deleted"] for r in table.delete_documents(spark.createDataFrame([(1,), (99,), (999,)], "doc_id long"), 3).collect()}
    assert n_gone == {1: 3, 99: 3}
    want = want.filter("doc_id not in (1, 99)")
    assert everything(table.rows()) == everything(want)
    table.load(rows(spark, [3], 3), 4)  # comes back
    assert everything(table.rows()) == everything(want.unionByName(rows(spark, [3], 3), allowMissingColumns=True))
    table.compact()
    table.vacuum()
    assert everything(ChunkTable(spark, table.path).rows()) == everything(want.unionByName(rows(spark, [3], 3), allowMissingColumns=True))
    assert everything(table.rows(F.col("society") == "DNV")) == [r for r in everything(table.rows()) if r[2] == "DNV"]


def test_filters_hold_for_what_changed(spark, table):
    """A row that moved to another society is no longer found under the old one, and the other way round."""
    table.load(rows(spark, range(40)), 0)
    table.compact()
    table.load(rows(spark, range(20), 1), 1)
    for s in SOCIETIES[:3]:
        assert everything(table.rows(F.col("society") == s)) == [r for r in everything(table.rows()) if r[2] == s]
    assert everything(table.rows(F.col("society").isNull())) == [r for r in everything(table.rows()) if r[2] is None]


def test_crashes_between_steps(spark, table, monkeypatch):
    table.load(rows(spark, range(100)), 0)
    before = everything(table.rows())

    def die(self, value):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(State, "write", die)  # after the data, before the state
        for step in (lambda t: t.load(rows(spark, range(50, 150), 1), 1), lambda t: t.compact()):
            with pytest.raises(RuntimeError):
                step(ChunkTable(spark, table.path))
            assert everything(ChunkTable(spark, table.path).rows()) == before
    # A state file that its writer left half written doesn't count.
    with monkeypatch.context() as m:
        m.setattr("json.dumps", lambda value: '{"key": "chu')
        ChunkTable(spark, table.path).state.write({})
    assert everything(ChunkTable(spark, table.path).rows()) == before
    again = ChunkTable(spark, table.path)
    again.load(rows(spark, range(50, 150), 1), 1)
    again.load(rows(spark, range(50, 150), 7), 1)  # the same number: already done
    again.compact()
    want = upsert(rows(spark, range(100)).withColumn("load_no", F.lit(0)), rows(spark, range(50, 150), 1).withColumn("load_no", F.lit(1)))
    assert everything(again.rows()) == everything(want)
    with pytest.raises(ValueError):  # loads come in order
        again.load(rows(spark, [1]), -1)


def test_bytes_grow_with_the_load(spark, table):
    table.load(rows(spark, range(20_000)), 0)
    table.load(rows(spark, range(20), 1), 1)
    table.compact()
    table.load(rows(spark, range(20), 2), 2)
    assert table.written_bytes(1) < table.written_bytes(0) / 20 and table.written_bytes(2) < table.written_bytes(0) / 20


def test_no_shuffle_and_pruning(spark, table):
    table.load(rows(spark, range(4000)), 0)
    table.compact()
    table.load(rows(spark, range(0, 4000, 7), 1), 1)
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table.rows(F.col("society") == "DNV")
        found.collect()
        assert "Exchange" not in plan(found)  # neither the latest of a key nor the anti-join moves rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    table.compact()
    found = table.rows((F.col("society") == "DNV") & (F.col("version_year") == 2015))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*society", text) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(version_year", text)
    files = lambda df: len(df.inputFiles())
    assert files(found) * 3 < files(table.rows())
    # Through a join the partitions are pruned as well.
    asked = spark.createDataFrame([(1, "DNV", 2015)], "query_id int, society string, year int").filter("query_id = 1")
    joined = table.rows().join(F.broadcast(asked), "society")
    assert "dynamicpruning" in plan(joined)


def test_stream(spark, table, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, range(30)).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    upsert_stream(stream(), table.path, str(tmp_path / "c")).awaitTermination(120)
    rows(spark, range(20, 40), 1).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(stream(), table.path, str(tmp_path / "c")).awaitTermination(120)
    want = upsert(rows(spark, range(30)).withColumn("load_no", F.lit(0)), rows(spark, range(20, 40), 1).withColumn("load_no", F.lit(1)))
    assert everything(ChunkTable(spark, table.path).rows()) == everything(want)
    assert ChunkTable(spark, table.path).about["done"] == [0, 1]


def test_whole_rows_are_not_sorted(spark, table):
    table.load(rows(spark, range(60)), 0)
    table.compact()
    table.load(rows(spark, range(0, 60, 7), 1), 1)
    table.load(rows(spark, range(0, 60, 5), 2), 2)
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table.rows()
        n = found.count()
        found.collect()
        assert n == 60 and "Window" not in plan(found) and "Sort" not in plan(found) and "Exchange" not in plan(found)
        table.delete_documents(spark.createDataFrame([(i,) for i in (0, 5, 5, 77)], "doc_id long"), 3)
        left = {r["chunk_id"]: r["text"] for r in table.rows().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    mark = lambda i: 2 if i % 5 == 0 else 1 if i % 7 == 0 else 0
    assert left == {f"c{i}": f"text {i} of {mark(i)}" for i in range(60) if i // 3 not in (0, 5)}
