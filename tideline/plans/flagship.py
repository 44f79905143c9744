"""The flagship: BM25 of benchmark items over a stored index of the documents, fused with a second ranking, deduplicated, cut and
measured. Texts are read of the hits only, once, and of the documents that have the rarest word of a quotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import retrieval as rt
from tideline.operators.graph import cut
from tideline.operators.inverted import InvertedIndex
from tideline.plans.registry import Tables
from tideline.plans.stored_queries import stored_index


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    index = stored_index(t)
    first = cut(index.search(queries))  # a few rows of each query, read by all that follows
    texts = cut(docs.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    second = rt.rerank(first, queries, texts)
    lists = first.select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id").union(second.select("query_id", F.lit(1), "rank", "chunk_id"))
    fused = cut(rt.reciprocal_ranks(lists))
    kept = rt.adjacent_dedup(fused.join(texts, "chunk_id").select("query_id", "rank", "text"), "query_id", "rank")
    shown = rt.assembled(fused.join(kept, ["query_id", "rank"]).drop("rank"), 20)
    return rt.metrics(shown.select("query_id", "chunk_id", "rank"), quoting(queries, docs, index))


def quoting(queries: DataFrame, docs: DataFrame, index: InvertedIndex | None = None, n: int = 6) -> DataFrame:
    """(query_id, chunk_id) of the documents that have the first n words of a query in a row.

    With an index (of the same documents) texts are looked at only where the rarest of the words is; without one all are.
    """
    split = lambda df, *ids: df.select(*ids, rt.words(F.col("text")).alias("w")).filter(F.size("w") >= n)
    run = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(n)))
    first = split(queries, "query_id")
    if index is not None:
        may = index.holding(first.select("query_id", F.explode(F.slice("w", 1, n)).alias("term")))
        docs = docs.join(may.select("chunk_id").distinct(), "chunk_id", "left_semi")
    held = cut(split(docs, "chunk_id"))  # so that the words aren't split anew for every run
    there = held.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), run)).alias("run"))
    return there.join(first.select("query_id", run(F.lit(0)).alias("run")), "run").select("query_id", "chunk_id").distinct()
