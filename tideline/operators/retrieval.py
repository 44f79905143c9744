"""Retrieval over tables of many queries: vectors, fusion, reranking, levels, metrics (BM25: inverted.py).

Hits are rows (query_id, chunk_id, score, rank). Ties in score go to the lower chunk_id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, mode: str = "cosine") -> Column:
    """cosine; half: (1 + cosine) / 2; inner: the plain product. A zero vector has no cosine."""
    if mode == "inner":
        return dot(a, b)
    cosine = dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))
    return (1 + cosine) / 2 if mode == "half" else cosine


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank (from 1) by score, and keeps the first k of each query."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


#: Queries of a block and chunks of a part, about; queries that are multiplied together.
BLOCK, PART, TOGETHER = 4096, 32_768, 256
#: What a matrix product may be off, against the sum in order, for vectors of length 1.
OFF = 1e-9


def _matrix(vectors: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The given rows, all of one length, as doubles."""
    return vectors.take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.size, -1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first place to the last (as SQL engines do, so that equal vectors tie)."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best_of(q: np.ndarray, floors: np.ndarray, x: np.ndarray, order: np.ndarray, k: int, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, row of x, score) of the k best rows of x for each of q, above its floor, ties by ``order``.

    A matrix product finds who can be among them; these alone are scored in order.
    """
    with np.errstate(all="ignore"):
        nq, nx = _in_order(q, q), _in_order(x, x)
        if mode != "inner":
            of_q, of_x = np.flatnonzero(nq != 0), np.flatnonzero(nx != 0)
        else:
            of_q, of_x = np.arange(len(q)), np.arange(len(x))
        if not of_x.size:
            return
        u = x[of_x] if mode == "inner" else x[of_x] / np.sqrt(nx[of_x])[:, None]
        longest = float(np.nanmax(np.sqrt(nx[of_x]), initial=0.0)) if mode == "inner" else 1.0
        for lo in range(0, of_q.size, TOGETHER):
            rows = of_q[lo : lo + TOGETHER]
            v = q[rows] if mode == "inner" else q[rows] / np.sqrt(nq[rows])[:, None]
            near = v @ u.T
            odd = ~np.isfinite(near)
            near[odd] = -np.inf
            floor = 2 * floors[rows] - 1 if mode == "half" else floors[rows]
            if of_x.size > k:
                floor = np.maximum(floor, np.partition(near, of_x.size - k, axis=1)[:, of_x.size - k])
            slack = OFF * (np.sqrt(nq[rows]) * longest if mode == "inner" else np.ones(rows.size))
            at, to = np.nonzero(~(near < (floor - slack)[:, None]) | odd)
            score = np.empty(at.size)
            for i in range(0, at.size, 65_536):
                some = slice(i, i + 65_536)
                score[some] = _in_order(q[rows[at[some]]], x[of_x[to[some]]])
            if mode != "inner":
                score = np.clip(score / np.sqrt(nq[rows[at]] * nx[of_x[to]]), -1, 1)
            if mode == "half":
                score = (1 + score) / 2
            by = np.lexsort((order[of_x[to]], np.where(np.isnan(score), -np.inf, -score), at))
            at, to, score = at[by], to[by], score[by]
            first = np.searchsorted(at, np.arange(rows.size))
            kept = np.arange(at.size) - first[at] < k
            yield rows[at[kept]], of_x[to[kept]], score[kept]


def scored_cells(queries: DataFrame, chunks: DataFrame, by: list[str], k: int, mode: str = "cosine") -> DataFrame:
    """query_id, chunk_id, score, held: the k best chunks (chunk_id, vector, held) of every query (query_id, vector, floor) in
    each group of the columns ``by``, which deal both to what a task can hold. Vectors of another length, with nulls, and for
    cosines zero vectors, take no part."""
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull())
    q = queries.filter(whole).select(*by, "query_id", F.col("vector").alias("q"), "floor")  # both names are new: the sides may be one table
    c = chunks.filter(whole).select(*by, "chunk_id", F.col("vector").alias("x"), "held")
    kinds = [q.schema["query_id"].dataType.simpleString(), c.schema["chunk_id"].dataType.simpleString()]

    def best(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and there.num_rows:
            order = np.empty(there.num_rows, np.int64)
            order[pc.sort_indices(there.column("chunk_id")).to_numpy()] = np.arange(there.num_rows)
            floors = np.where(asked.column("floor").is_null().to_numpy(), -np.inf, asked.column("floor").fill_null(0.0).to_numpy())
            dims = [pc.list_value_length(v).to_numpy() for v in (asked.column("q"), there.column("x"))]
            for dim in np.unique(dims[0]):
                of_q, of_c = (np.flatnonzero(d == dim) for d in dims)
                if of_c.size:
                    x = _matrix(there.column("x"), of_c)
                    for i, j, score in _best_of(_matrix(asked.column("q"), of_q), floors[of_q], x, order[of_c], k, mode):
                        found.append((of_q[i], of_c[j], score))
        i, j, score = (np.concatenate([f[n] for f in found] or [np.zeros(0, int)]) for n in range(3))
        held = there.take(pa.array(j, pa.int64()))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(i, pa.int64())), "chunk_id": held.column("chunk_id"), "score": pa.array(score, pa.float64()), "held": held.column("held")})

    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(best, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, held boolean")


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, mode: str = "cosine", where: Column | None = None, block: int = BLOCK, parts: int | None = None, post_filter: bool = False) -> DataFrame:
    """Exact nearest chunks of every query (query_id, vector) among (chunk_id, vector), filter first (or last, if told so).

    Queries are dealt to blocks of about ``block`` and chunks to parts (of about PART, 32 at least), and every part meets each
    block once, as a product of matrices in one task; only k rows of a query leave a part, before the ranks of all parts meet.
    Scores are sums in double precision, from the first place to the last. Where queries have a column floor, chunks that score
    below it are left out.
    """
    candidates = chunks if where is None or post_filter else chunks.filter(where)
    blocks = max(1, -(-queries.count() // block))
    parts = parts or max(32, -(-candidates.count() // PART))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    floor = F.col("floor").cast("double") if "floor" in queries.columns else F.lit(None).cast("double")
    q = queries.select("query_id", "vector", floor.alias("floor"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", numbers(parts))
    held = F.coalesce(where, F.lit(False)) if post_filter and where is not None else F.lit(True)
    c = candidates.select("chunk_id", "vector", held.alias("held"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", numbers(blocks))
    return ranked(scored_cells(q, c, ["block", "part"], k, mode), k).filter("held").select("query_id", "chunk_id", "score", "rank")


def cells(chunks: DataFrame, n_cells: int, seed: int = 7, sample: int = 2000) -> tuple[list, DataFrame]:
    """Coarse cells: centres fitted by k-means on at most ``sample`` unit vectors, and chunks with their nearest cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = F.sqrt(dot(F.col("vector"), F.col("vector")))
    unit = chunks.withColumn("unit", F.transform("vector", lambda x: x.cast("double") / norm)).withColumn("features", array_to_vector("unit"))
    fit_on = unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    model = KMeans(k=n_cells, seed=seed, maxIter=8).fit(fit_on)
    return [[float(x) for x in c] for c in model.clusterCenters()], model.transform(unit).select("chunk_id", "vector", F.col("prediction").alias("cell"), vector_to_array("features").alias("unit"))


def approximate_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, n_cells: int | None = None, probes: int | None = None, sample: int = 5000) -> DataFrame:
    """Nearest chunks within each query's nearest cells, exactly scored; every chunk is indexed.

    By default there is a cell for every 39 chunks, 16 at least and 128 at most, and three quarters of them are probed, which
    vectors without groups need for nine of ten neighbours; where vectors lie in groups, 16 of 128 do.
    """
    n_cells = n_cells or min(128, max(16, chunks.count() // 39))
    probes = probes or -(-3 * n_cells // 4)
    centres, indexed = cells(chunks, n_cells, sample=sample)
    known = F.from_json(F.lit(json.dumps(centres)), "array<array<double>>")  # n_cells centres, 128 at most by default
    far = F.transform(known, lambda c, i: F.struct((-similarity(F.col("vector"), c)).alias("far"), i.alias("cell")))
    near = queries.withColumn("x", F.explode(F.slice(F.array_sort(far), 1, probes)))
    n, asked = chunks.count(), queries.count()
    parts, blocks = max(1, -(-n // (n_cells * PART))), max(1, -(-asked // BLOCK))  # a cell's chunks and queries by hash, as in dense_top_k()
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = near.select("query_id", "vector", F.lit(None).cast("double").alias("floor"), "x.cell", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", numbers(parts))
    c = indexed.select("chunk_id", "vector", F.lit(True).alias("held"), "cell", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part")).withColumn("block", numbers(blocks))
    return ranked(scored_cells(q, c, ["cell", "part", "block"], k), k).select("query_id", "chunk_id", "score", "rank")


NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def reciprocal_ranks(lists: DataFrame, k: int = 60, top_k: int = 50) -> DataFrame:
    """Fusion of (query_id, list_no, rank, chunk_id): sums of 1 / (k + rank); ties keep the first list and rank."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_no", "first.rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "rank")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    q = F.array_distinct(words(query))
    return F.coalesce(F.size(F.array_intersect(q, words(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 20, scorer=overlap) -> DataFrame:
    """Hits scored anew by scorer(query text, chunk text), a column function (native, or a pandas UDF over a model)."""
    both = hits.select("query_id", "chunk_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(docs.select("chunk_id", F.col("text").alias("d")), "chunk_id")
    return ranked(both.select("query_id", "chunk_id", scorer(F.col("q"), F.col("d")).alias("score")), k)


def batch_scorer(load):
    """A scorer for rerank() from load(), which gives a function of (queries, texts), two pandas series, to scores.

    load() runs once a task, in the worker, so a model's weights are read there and not sent with the plan; the function gets
    whole Arrow batches. Null texts and queries come as ''.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.fillna(""), texts.fillna("")), dtype="float64")

    return F.pandas_udf(score, "double")


def adjacent_dedup(rows: DataFrame, by: str, order: str, threshold: float = 0.85) -> DataFrame:
    """(by, order) of the rows kept: in order, a text is dropped if its words are too like those of the last one kept.

    Sequential within a group, which therefore has to be small; two texts without words are alike.
    """
    sets = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), sets.alias("w")))).alias("items"))
    union = lambda a, x: F.size(F.array_union(a, x))
    alike = lambda a, x: F.when(union(a, x) == 0, 1.0).otherwise(F.size(F.array_intersect(a, x)) / union(a, x)) >= threshold
    kind = rows.schema[order].dataType.simpleString()
    start = F.struct(F.lit(None).cast("array<string>").alias("last"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda acc, x: F.when(acc["last"].isNotNull() & alike(acc["last"], x["w"]), acc).otherwise(F.struct(x["w"].alias("last"), F.array_append(acc["kept"], x["o"]).alias("kept")))
    return items.select(by, F.explode(F.aggregate("items", start, step, lambda acc: acc["kept"])).alias(order))


def expanded(hits: DataFrame, chunks: DataFrame, window: int = 3) -> DataFrame:
    """Hits (query_id, doc_id, position) with their neighbours in the document, each once; window 0 leaves them as they are."""
    near = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("position") - window, F.col("position") + window)).alias("position"))
    return near.distinct().join(chunks, ["doc_id", "position"])


def propositions(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, line_no, proposition: lines without bullets, numbers and quotes, over ``least`` characters, first of each kept."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^(?:[-*•]+|\d+[.)])\s*", ""), r"^[\"']+|[\"']+$", ""))
    lines = lines.select("doc_id", "line_no", bare.alias("proposition")).filter(F.length("proposition") > least)
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower(F.trim("proposition"))).orderBy("line_no"))
    return lines.withColumn("r", first).filter("r = 1").drop("r")


def by_level(hits: DataFrame, least: int = 3) -> DataFrame:
    """Of hits (query_id, level, chunk_id) those of the first level with enough, else of the last level that has any."""
    n = hits.groupBy("query_id", "level").agg(F.count("*").alias("n"))
    chosen = n.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("level"))), F.max("level")).alias("level"))
    return hits.join(chosen, ["query_id", "level"])


def at_level(queries: DataFrame, chunks: DataFrame, levels: list[list[str]], least: int = 3, parts: int = 32) -> DataFrame:
    """query_id, level, chunk_id as by_level() keeps them, where a hit of a level is a chunk that equals the query in all of its
    columns. What a level has is counted by its values, so only hits of the chosen levels are made; ``parts`` deals the chunks
    of the same values to tasks."""
    of, known = queries, []
    for level, names in enumerate(levels):
        n = chunks.groupBy(*(F.col(c).alias(f"__{c}") for c in names)).agg(F.count("*").alias(f"__n{level}"))
        on = [F.col(c) == F.col(f"__{c}") for c in names]
        of = of.join(n, on, "left").drop(*(f"__{c}" for c in names))
        known.append(F.when(F.col(f"__n{level}") > 0, F.struct(F.lit(level).alias("level"), F.col(f"__n{level}").alias("n"))))
    enough = [F.when(k["n"] >= least, k["level"]) for k in known]
    chosen = F.coalesce(*enough, *(k["level"] for k in reversed(known)))
    asked = of.withColumn("level", chosen).filter("level is not null")
    out = None
    dealt = chunks.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    for level, names in enumerate(levels):
        q = asked.filter(F.col("level") == level).select("query_id", "level", *(F.col(c).alias(f"__{c}") for c in names), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
        hits = dealt.join(q, [F.col("part") == F.col("__part"), *(F.col(c) == F.col(f"__{c}") for c in names)]).select("query_id", "level", "chunk_id")
        out = hits if out is None else out.union(hits)
    return out


def assembled(hits: DataFrame, k: int = 20) -> DataFrame:
    """Hits with total_found (of all of a query) and the first k of them."""
    w = Window.partitionBy("query_id")
    out = hits.withColumn("total_found", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")))
    return out.filter(F.col("rank") <= k)


def metrics(rankings: DataFrame, relevant: DataFrame, k: int = 20) -> DataFrame:
    """query_id, recall, mrr, dcg, ndcg at k from rankings (query_id, chunk_id, rank) and relevant (query_id, chunk_id).

    A query without relevant chunks has recall, mrr and ndcg 1; one that retrieved nothing has 0.
    """
    total = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hit = rankings.join(relevant.distinct().withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left")
    top = F.col("rank") <= k
    per = hit.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("rel"))).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ids = rankings.select("query_id").union(relevant.select("query_id")).distinct()
    j = ids.join(total, "query_id", "left").join(per, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = lambda x: F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce(x, F.lit(0.0)))
    return j.select(
        "query_id", some(F.col("found") / F.col("n")).alias("recall"), some(1 / F.col("first")).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)), 9).alias("dcg"), F.round(some(F.col("dcg") / ideal), 9).alias("ndcg"),
    )
