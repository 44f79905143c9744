"""Approximate nearest chunks by navigable small-world graphs, one for each part of the chunks.

A part holds a bounded number of chunks. Its graph links every chunk to near ones in different directions and is built by
inserting batches, each searching the graph so far; the rows of all graphs are a table that is written once. A search walks
every part's graph for all queries of a batch at once, nearest open chunk first, and the parts' best meet in one ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.retrieval import dense_top_k, ranked

#: Chunks of a part, about; links a chunk gets when it is inserted (twice as many at most); width of a search when building.
PART, LINKS, WIDTH = 16_384, 16, 64
#: Queries that walk a graph together.
TOGETHER = 256


def walk(x: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the numbers and distances (1 - cosine; ascending) of the ``width`` nearest met, and how many were scored.

    x, q: unit vectors. links: numbers by row, -1 for none. Numbers are -1 where fewer were met.
    """
    n_q, n = len(q), len(x)
    seen = np.zeros((n_q, n + 1), bool)  # the last column is for no link
    seen[:, n] = True
    seen[:, starts] = True
    dist = 1 - q @ x[starts].T
    take = np.argsort(dist, axis=1, kind="stable")[:, :width]
    ids, dist = starts[take], np.take_along_axis(dist, take, 1)
    if ids.shape[1] < width:
        more = width - ids.shape[1]
        ids, dist = np.pad(ids, ((0, 0), (0, more)), constant_values=-1), np.pad(dist, ((0, 0), (0, more)), constant_values=np.inf)
    scored, done = np.full(n_q, starts.size), ~np.isfinite(dist)
    while True:
        best = np.where(done, np.inf, dist).argmin(axis=1)
        rows = np.flatnonzero(~done[np.arange(n_q), best])
        if not rows.size:
            return ids, dist, scored
        node = ids[rows, best[rows]]
        done[rows, best[rows]] = True
        near = np.where(links[node] < 0, n, links[node])
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        d = np.where(new, 1 - np.einsum("ad,amd->am", q[rows], x[np.minimum(near, n - 1)]), np.inf)
        scored[rows] += new.sum(axis=1)
        all_ids, all_dist = np.concatenate([ids[rows], np.where(new, near, -1)], axis=1), np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], ~new], axis=1)
        by = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(v, by, 1) for v in (all_ids, all_dist, all_done))


def spread(x: np.ndarray, node: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> list[int]:
    """Of candidates by distance those nearer to the node than to any already taken, filled up with the nearest others."""
    ids, dist = ids[np.isfinite(dist)], dist[np.isfinite(dist)]
    between = 1 - x[ids] @ x[ids].T
    kept: list[int] = []
    for i in range(ids.size):
        if len(kept) == most:
            break
        if not kept or between[i, kept].min() > dist[i]:
            kept.append(i)
    rest = [i for i in range(ids.size) if i not in kept][: most - len(kept)]
    return ids[kept + rest].tolist()


def build(x: np.ndarray, links: int = LINKS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows x 2 links, -1 for none) of unit vectors, in the order they are given, and the rows where searches start."""
    n = len(x)
    out = np.full((n, 2 * links), -1, np.int64)
    held = np.zeros(n, np.int64)
    starts = np.arange(max(1, int(np.sqrt(n))))
    done = 0
    while done < n:
        size = min(n - done, max(2 * links, done // 4))
        batch = np.arange(done, done + size)
        inside = 1 - x[batch] @ x[batch].T
        np.fill_diagonal(inside, np.inf)
        inside[np.triu_indices(size, 1)] = np.inf  # of a batch the earlier ones only
        pairs = []
        for lo in range(0, size, TOGETHER):
            part = batch[lo : lo + TOGETHER]
            if done:
                ids, dist, _ = walk(x[:done], out[:done], starts[starts < done], x[part], width)
            else:
                ids, dist = np.full((part.size, 0), -1), np.zeros((part.size, 0))
            near = np.argsort(inside[lo : lo + TOGETHER], axis=1, kind="stable")[:, :width]
            ids = np.concatenate([ids, batch[near]], axis=1)
            dist = np.concatenate([dist, np.take_along_axis(inside[lo : lo + TOGETHER], near, 1)], axis=1)
            by = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
            for i, node in enumerate(part):
                chosen = spread(x, x[node], ids[i], dist[i], links)
                out[node, : len(chosen)] = chosen
                held[node] = len(chosen)
                pairs += [(c, node) for c in chosen]
        for to, node in pairs:  # the way back; a full row keeps its nearest
            if held[to] < 2 * links:
                out[to, held[to]] = node
                held[to] += 1
            else:
                far = 1 - x[out[to]] @ x[to]
                worst = int(far.argmax())
                if 1 - x[node] @ x[to] < far[worst]:
                    out[to, worst] = node
        done += size
    return out, starts


def _unit(batch_column: pa.Array, n: int) -> np.ndarray:
    x = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph_index(chunks: DataFrame, part_rows: int = PART, links: int = LINKS, width: int = WIDTH) -> DataFrame:
    """part, place, chunk_id, vector, links of (chunk_id, vector): the rows of all graphs; write them before they are searched.

    Null and zero vectors aren't indexed; all others are, and have one length.
    """
    held = chunks.filter(F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0)).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-held.count() // part_rows))
    dealt = held.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def made(table: pa.Table) -> pa.Table:
        table = table.take(np.random.default_rng(7).permutation(table.num_rows))
        out, _ = build(_unit(table.column("vector").combine_chunks(), table.num_rows), links, width)
        rows = pa.array([[int(v) for v in r if v >= 0] for r in out], pa.list_(pa.int32()))
        return pa.table({"part": table.column("part"), "place": pa.array(range(table.num_rows), pa.int32()), "chunk_id": table.column("chunk_id"), "vector": table.column("vector"), "links": rows})

    return dealt.groupBy("part").applyInArrow(made, f"part int, place int, chunk_id {kind}, vector array<double>, links array<int>")


def graph_top_k(queries: DataFrame, index: DataFrame, k: int = 20, width: int = 160) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank, n_scored (of all parts) of (query_id, vector) over graph_index() rows.

    A part's rows come to its task first, then the queries, in batches: memory goes with a part, not with the queries.
    """
    parts = index.select("part").distinct()
    q = queries.filter(F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0))
    none = index.schema["chunk_id"].dataType.simpleString()
    asked = q.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(parts.count() - 1))).alias("part"))
    kind = queries.schema["query_id"].dataType.simpleString()
    both = index.select("part", F.lit(0).alias("turn"), "place", "chunk_id", F.lit(None).cast(kind).alias("query_id"), "vector", "links").unionByName(
        asked.select("part", F.lit(1).alias("turn"), F.lit(0).alias("place"), F.lit(None).cast(none).alias("chunk_id"), "query_id", "vector", F.lit(None).cast("array<int>").alias("links"))
    )

    def run(batches):
        rows, part, graph = [], None, None
        for batch in batches:
            of, turn = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(turn) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True) if len(of) else ():
                piece = batch.slice(lo, hi - lo)
                if part != of[lo]:
                    rows, part, graph = [], of[lo], None
                if turn[lo] == 0:
                    rows.append(piece)
                    continue
                if graph is None:
                    held = pa.Table.from_batches(rows)
                    listed = held.column("links").to_pylist()
                    links = np.full((len(listed), max(1, max(map(len, listed)))), -1, np.int64)
                    for i, x in enumerate(listed):
                        links[i, : len(x)] = x
                    graph = held.column("chunk_id").combine_chunks(), _unit(held.column("vector").combine_chunks(), held.num_rows), links, np.arange(max(1, int(np.sqrt(len(listed)))))
                    rows = []
                names, x, links, starts = graph
                for at in range(0, hi - lo, TOGETHER):
                    some = piece.slice(at, TOGETHER)
                    ids, dist, scored = walk(x, links, starts, _unit(some.column("vector"), some.num_rows), max(width, k))
                    ids, dist = ids[:, :k], dist[:, :k]
                    real = np.isfinite(dist)
                    by = np.repeat(np.arange(some.num_rows), real.sum(axis=1))
                    once = np.where(np.diff(by, prepend=-1) != 0, scored[by], 0)  # told once a query and part
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(by)), names.take(pa.array(ids[real])), pa.array(1 - dist[real]), pa.array(once, pa.int64())], names=["query_id", "chunk_id", "score", "scored"])

    dealt = both.repartition("part").sortWithinPartitions("part", "turn", "place", "query_id")
    found = dealt.mapInArrow(run, f"query_id {kind}, chunk_id {none}, score double, scored long")
    total = F.sum("scored").over(Window.partitionBy("query_id"))
    return ranked(found.withColumn("n_scored", total), k).select("query_id", "chunk_id", "score", "rank", "n_scored")


def checked(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest of all chunks, without a miss: hits of graph_top_k() give each query a floor, and whatever else reaches it
    is put in. One pass over the pairs of queries and chunks, as matrix products."""
    floors = hits.filter(F.col("rank") == k).select("query_id", (F.col("score") - 1e-9).alias("floor"))
    return dense_top_k(queries.join(floors, "query_id", "left"), chunks, k)
