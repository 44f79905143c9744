"""A stored inverted index with BM25 search that leaves out what can't reach the best k.

Postings are written once, by shard of the documents and term, with the largest term count and the least length of each block;
a term of many documents is many rows, so none grows beyond a shard. The shards are what a task meets one after the other, so
that postings are made where the texts are read, without a shuffle, and a search adds up most of a document's score in the
task that reads its shard. Segments are added by load; a document that comes again or
goes is marked as removed from the segments before, and its terms are taken out of the counts, so scores are always those of
the documents that are there. Nothing of a document's text is read or split by a search.

Search (MaxScore): every term of a query has an upper bound, from the largest count and least length. The rarest terms are
scored first, and what they bring up best is scored in full; its k-th best is a floor under the final k-th score. Terms whose bounds together stay below the floor can't
lift a document into the best k alone: only the others' postings give candidates, without blocks that can't reach the floor,
and the rest is added to the candidates that still can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.graph import cut
from tideline.operators.retrieval import NO_WORD, ranked, words
from tideline.sources.bucketed import known_as, write_partition
from tideline.sources.state import State

#: Documents of a shard, about: the most postings of a row. A shard of long documents ends with this many bytes.
SHARD, BYTES = 8192, 1 << 25
#: Pairs of posting and query that are added up at once; queries of a term that meet its postings together.
PAIRS, ASKED = 2_000_000, 4096
#: Terms of queries up to which they are sent to all tasks.
SENT = 500_000
#: What rounding could add to a score.
SLACK = 1e-7
#: Postings of all queries' terms over which a search leaves out what it can: below, one pass over all of them takes less.
PRUNE_OVER = 5_000_000_000


def term_counts(text: Column) -> Column:
    """array<struct<term, tf>> of a text: its words are sorted, and runs of the same counted, in the row."""
    sorted_words = F.sort_array(words(text))
    # Bound once: as an element of an array of one.
    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, n: F.struct(F.get(w, at).alias("term"), (F.coalesce(F.get(s, n + 1), F.size(w)) - at).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.flatten(F.flatten(F.transform(F.array(sorted_words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array(none)))))


def inverted(docs: pa.Table, number: int, fields: list[str]) -> list[pa.Table]:
    """The rows of one shard, by term: its blocks, and under the empty term its documents. docs: chunk_id, w (words between blanks), fields."""
    w = pc.split_pattern(docs.column("w").combine_chunks(), " ")
    n, flat = docs.num_rows, w.flatten()
    ids = docs.column("chunk_id").combine_chunks()
    doc = np.repeat(np.arange(n), pc.list_value_length(w).fill_null(0).to_numpy(zero_copy_only=False))
    code = flat.dictionary_encode()
    known = code.dictionary
    by = pc.sort_indices(known).to_numpy()
    place = np.empty(by.size, np.int64)
    place[by] = np.arange(by.size)
    there = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[code.indices.to_numpy()]
    doc = doc[there]
    key, tf = np.unique(place[code.indices.to_numpy()[there]] * n + doc, return_counts=True)
    term, at = np.divmod(key, n)
    dl, tf = np.bincount(doc, minlength=n).astype(np.int32), tf.astype(np.int32)
    head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if key.size else np.zeros(0, np.int64)
    ends = np.append(head, key.size).astype(np.int32)
    posts = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(tf), pa.array(dl[at])], names=["chunk_id", "tf", "dl"]))
    names = known.take(pa.array(by[term]))
    of_doc = np.argsort(at, kind="stable")
    terms = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=n))).astype(np.int32)), names.take(pa.array(of_doc)))
    held = pa.StructArray.from_arrays([ids, pa.array(dl), pc.binary_join(terms, " "), *(docs.column(f).combine_chunks() for f in fields)], names=["chunk_id", "dl", "terms", *fields])
    shard = lambda m: pa.array(np.full(m, number, np.int64))
    least, most = (np.minimum.reduceat(dl[at], head), np.maximum.reduceat(tf, head)) if key.size else (dl[:0], tf[:0])
    blocks = pa.table({"term": names.take(pa.array(head)), "shard": shard(head.size), "n": pa.array(np.diff(ends)), "posts": posts, "max_tf": pa.array(most), "min_dl": pa.array(least), "doc": pa.nulls(head.size, held.type)})
    none = lambda kind: pa.nulls(n, kind)
    return [pa.table({"term": pa.array([""] * n), "shard": shard(n), "n": none(pa.int32()), "posts": none(posts.type), "max_tf": none(pa.int32()), "min_dl": none(pa.int32()), "doc": held}), blocks]


def added_up(blocks: DataFrame, k1: float, b: float, avgdl: float, kinds: tuple[str, str]) -> DataFrame:
    """query_id, chunk_id, seg, shard, score from blocks (seg, shard, posts, asks): sums over what lies together of a shard.

    A shard that two tasks read, and a very large sum, gives several rows of a query and document.
    """

    def codes(column: pa.Array, known: dict, values: list) -> np.ndarray:
        """Numbers of the values of a column, the same for equal ones of all batches."""
        own = column.dictionary_encode()
        number = np.empty(len(own.dictionary), np.int64)
        for i, v in enumerate(own.dictionary.to_pylist()):
            number[i] = known.setdefault(v, len(values))
            if number[i] == len(values):
                values.append(v)
        return number[own.indices.to_numpy()]

    def run(batches):
        of, queries, docs = None, ({}, []), ({}, [])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told():
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            score = np.bincount(at, np.concatenate([w for _, w in held]), key.size)
            q, d = np.divmod(key, 1 << 32)
            for lo in range(0, key.size, 1 << 16):
                part = slice(lo, lo + (1 << 16))
                columns = [pa.array(x[1], t).take(pa.array(i[part])) for x, i, t in ((queries, q, types[0]), (docs, d, types[1]))]
                size = len(columns[0])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(size, of[0])), pa.array(np.full(size, of[1])), pa.array(score[part])], names=["query_id", "chunk_id", "seg", "shard", "score"])
            held.clear()

        for batch in batches:
            seg, shard = (batch.column(i).to_numpy() for i in (0, 1))
            types = [batch.column(3).type.value_type.field("query_id").type, batch.column(2).type.value_type.field("chunk_id").type]
            cuts = np.flatnonzero((seg[1:] != seg[:-1]) | (shard[1:] != shard[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if of != (seg[lo], shard[lo]):
                    if held:
                        yield from told()
                    of, docs = (seg[lo], shard[lo]), ({}, [])
                posts, asks = batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                n_posts, n_asks = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (posts, asks))
                first_post, first_ask = np.cumsum(n_posts) - n_posts, np.cumsum(n_asks) - n_asks
                posts, asks = posts.flatten(), asks.flatten()
                tf, dl = (posts.field(x).to_numpy().astype(np.float64) for x in ("tf", "dl"))
                gain, idf = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), asks.field("idf").to_numpy()
                d, q = codes(posts.field("chunk_id"), *docs), codes(asks.field("query_id"), *queries)
                total = np.cumsum(n_posts * n_asks)
                row = 0
                while row < hi - lo:  # some rows at once, one at least
                    until = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
                    some = np.arange(row, until)
                    pair = np.repeat(some, (n_posts * n_asks)[some])
                    within = np.arange(pair.size) - (total - n_posts * n_asks)[pair] + (total[row - 1] if row else 0)
                    a, p = np.divmod(within, n_posts[pair])
                    a, p = a + first_ask[pair], p + first_post[pair]
                    held.append(_summed(q[a] << 32 | d[p], idf[a] * gain[p], len(queries[1]), len(docs[1])))
                    if sum(k.size for k, _ in held) > 4 * PAIRS:
                        yield from told()
                    row = until
        if held:
            yield from told()

    return blocks.select("seg", "shard", "posts", "asks").mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, seg bigint, shard bigint, score double")


def _summed(key: np.ndarray, weight: np.ndarray, queries: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (query << 32 | document), and the sums of their weights."""
    if queries * docs > 4 * PAIRS:
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, weight, key.size)
    flat = (key >> 32) * docs + (key & 0xFFFFFFFF)
    sums, met = np.bincount(flat, weight, queries * docs), np.bincount(flat, minlength=queries * docs)
    found = np.flatnonzero(met)
    q, d = np.divmod(found, docs)
    return q << 32 | d, sums[found]


class InvertedIndex:
    """State: segments, n and total length of the documents that are there, done (loads so far)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.state = State(spark, f"{self.path}/state")
        self.about = self.state.read()
        if self.about is None:
            raise FileNotFoundError(f"no index in {path}")
        self.fields, self._known = self.about["fields"], {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, like: DataFrame, fields: tuple[str, ...] = (), buckets: int = 16) -> InvertedIndex:
        """An empty index. like: chunk_id, text and the columns that filters may name (fields)."""
        kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
        state = {"id": kinds["chunk_id"], "fields": [f"{n} {kinds[n]}" for n in fields], "buckets": buckets, "segments": [], "done": [], "removals": False, "n": 0, "length": 0}
        State(spark, f"{path.rstrip('/')}/state").write(state)
        return cls(spark, path)

    def _schema(self) -> list[str]:
        """Columns of the postings: a block's, and those of a document (of the empty term), without its segment."""
        key = self.about["id"]
        doc = ",".join([f"chunk_id:{key},dl:int,terms:string", *(f.replace(" ", ":", 1) for f in self.fields)])
        return ["term string", "shard bigint", "n int", f"posts array<struct<chunk_id:{key},tf:int,dl:int>>", "max_tf int", "min_dl int", f"doc struct<{doc}>"]

    def _name(self, name: str) -> str:
        columns, by = {
            "postings": (self._schema(), None),
            "terms": (["term string", "df bigint", "max_tf int", "min_dl int"], "term"),
            "removed": ([f"chunk_id {self.about['id']}"], "chunk_id"),
        }[name]
        if name not in self._known:
            buckets = self.about["buckets"] if by else 0
            self._known[name] = known_as(self.spark, f"{self.path}/{name}", [*columns, "seg bigint"], "seg", by, buckets, [by] if by else ())
        return self._known[name]

    def _put(self, name: str, rows: DataFrame, number: int) -> None:
        write_partition(self._name(name), f"{self.path}/{name}", rows, "seg", number)

    def table(self, name: str) -> DataFrame:
        """Rows of the segments that the state names."""
        if name == "docs":
            terms = F.filter(F.split("terms", " "), lambda w: w != "")  # stored as one string, which is written far faster
            return self.table("postings").filter("term = ''").select("doc.*", "shard", "seg").withColumn("terms", terms)
        return self.spark.table(self._name(name)).filter(F.col("seg").isin([int(s) for s in self.about["segments"]]))

    def documents(self) -> DataFrame:
        """The documents that are there: chunk_id, dl, terms, fields, shard, seg."""
        return self._there(self.table("docs"))

    def _there(self, rows: DataFrame) -> DataFrame:
        """rows (chunk_id, seg) without those removed by a later segment."""
        if not self.about["removals"]:
            return rows
        gone = self.table("removed").groupBy(F.col("chunk_id").alias("gone")).agg(F.max("seg").alias("since"))
        return rows.join(gone, (F.col("chunk_id") == F.col("gone")) & (F.col("seg") < F.col("since")), "left_anti")

    # ------------------------------------------------------------ writing

    def add(self, docs: DataFrame, number: int) -> None:
        """Add documents (chunk_id, text, fields), each id once; those that are there already are replaced. As ChunkTable.load().

        Null ids are left out; a null text has no words and is a document all the same.
        """
        if number in self.about["done"]:
            return
        names = [f.split(" ")[0] for f in self.fields]
        split = docs.filter(F.col("chunk_id").isNotNull()).select("chunk_id", F.regexp_replace(F.lower("text"), NO_WORD, " ").alias("w"), *names)
        most_docs, most_bytes = SHARD, BYTES

        def run(batches):
            shard = TaskContext.get().partitionId() << 24
            held, n, size = [], 0, 0
            for batch in batches:
                for lo in range(0, batch.num_rows, most_docs):
                    piece = batch.slice(lo, most_docs)
                    held.append(piece)
                    n, size = n + piece.num_rows, size + (pc.sum(pc.binary_length(piece.column(1))).as_py() or 0)
                    if n >= most_docs or size >= most_bytes:
                        for rows in inverted(pa.Table.from_batches(held), shard, names):
                            yield from rows.to_batches(4096)
                        held, n, size, shard = [], 0, 0, shard + 1
            if n:
                for rows in inverted(pa.Table.from_batches(held), shard, names):
                    yield from rows.to_batches(4096)

        self._write(number, split.mapInArrow(run, ", ".join(self._schema())), docs.filter(F.col("chunk_id").isNotNull()).select("chunk_id"))

    def delete(self, doomed: DataFrame, number: int) -> None:
        """Remove documents by chunk_id."""
        if number not in self.about["done"]:
            self._write(number, None, doomed.select("chunk_id"))

    def _write(self, number: int, posts: DataFrame | None, touched: DataFrame) -> None:
        gone, n, length = None, 0, 0
        if self.about["segments"]:
            gone = cut(self.documents().join(touched.distinct(), "chunk_id", "left_semi").select("chunk_id", "dl", "terms"))
            n_gone, length_gone = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, length = n - n_gone, length - length_gone
            self._put("removed", gone.select("chunk_id"), number)
        counts = []
        if posts is not None:
            self._put("postings", posts, number)
            written = self.spark.table(self._name("postings")).filter(F.col("seg") == number)
            counts.append(written.filter("term <> ''").select("term", F.col("n").cast("long").alias("df"), "max_tf", "min_dl"))
            n_new, length_new = written.filter("term = ''").agg(F.count("*"), F.coalesce(F.sum("doc.dl"), F.lit(0))).first()
            n, length = n + n_new, length + length_new
        if gone is not None:
            counts.append(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df"), F.lit(None).cast("int").alias("max_tf"), F.lit(None).cast("int").alias("min_dl")))
        if counts:
            both = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
            self._put("terms", both.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")), number)
        about = self.about | {"segments": [*self.about["segments"], number], "done": [*self.about["done"], number], "removals": self.about["removals"] or gone is not None, "n": self.about["n"] + n, "length": self.about["length"] + length}
        self.state.write(about)
        self.about = about

    # ------------------------------------------------------------ search

    def holding(self, terms: DataFrame) -> DataFrame:
        """(query_id, chunk_id) of documents that may have all terms of a query (query_id, term): those with its rarest one."""
        df = self.table("terms").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        known = terms.distinct().join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", "df").alias("term"), F.count_if(F.col("df").isNull()).alias("unknown")).filter("unknown = 0")
        posts = known.select("query_id", "term").join(self.table("postings").select("term", "posts", "seg"), "term").select("query_id", F.explode("posts.chunk_id").alias("chunk_id"), "seg")
        return self._there(posts).select("query_id", "chunk_id")

    def search(self, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, where: Column | None = None, prune: bool | None = None) -> DataFrame:
        """Hits of (query_id, text): the k best chunks by BM25, and by chunk_id where scores (to 9 digits) are equal.

        where: over the fields, and over further columns of ``queries``; what fails it is left out, without a change of scores.
        prune: False scores all postings of all terms in one pass; by default that is done up to PRUNE_OVER postings. Either way
        the hits are the same.
        """
        n, avgdl = self.about["n"], (self.about["length"] / self.about["n"] if self.about["n"] and self.about["length"] else 1.0)
        asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        df = self.table("terms").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).filter("df > 0")
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = lambda tf, dl: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))
        t = cut(asked.join(df, "term").withColumn("idf", idf).withColumn("bound", gain(F.col("max_tf"), F.col("min_dl"))))
        n_terms, n_posts = t.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        postings = self.table("postings").filter("term <> ''")
        of_query = Window.partitionBy("query_id")
        kinds = (queries.select("query_id").schema[0].dataType.simpleString(), self.about["id"])

        def summed(terms: DataFrame, floor: bool) -> DataFrame:
            """(query_id, chunk_id, seg, shard, score) over the terms' postings, of documents that are there and satisfy where."""
            ask = ["query_id", "idf", *(["bound", "all", "floor"] if floor else [])]
            part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_terms // ASKED))))  # of a term's queries
            asks = terms.groupBy("term", part.alias("part")).agg(F.collect_list(F.struct(*ask)).alias("asks"))
            x = postings.join(F.broadcast(asks) if n_terms <= SENT else asks, "term")
            if floor:  # a block is left out if even its best document, best in all other terms too, stays below
                best = lambda q: q["all"] - q["bound"] + q["idf"] * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / F.lit(avgdl)))
                x = x.withColumn("asks", F.filter("asks", lambda q: best(q) >= q["floor"])).filter(F.size("asks") > 0)
            x = added_up(x, k1, b, avgdl, kinds).repartition("chunk_id")  # so that no hit is moved again
            hits = self._there(x.groupBy("query_id", "chunk_id", "seg", "shard").agg(F.sum("score").alias("score")))
            if where is None:
                return hits
            fields, more = [f.split(" ")[0] for f in self.fields], [c for c in queries.columns if c not in ("query_id", "text")]
            held = self.documents().select("chunk_id", *fields)
            return hits.join(held.hint("shuffle_hash"), "chunk_id").join(queries.select("query_id", *more), "query_id").filter(where).select("query_id", "chunk_id", "seg", "shard", "score")

        def completed(hits: DataFrame, terms: DataFrame) -> DataFrame:
            """hits with what further terms of their queries add: only blocks that hold one of them are opened."""
            wanted = hits.select("query_id", "chunk_id", "seg", "shard").join(terms.select("query_id", "term", "idf"), "query_id")
            blocks = postings.join(wanted.select("term", "seg", "shard").distinct(), ["term", "seg", "shard"], "left_semi").select("term", "seg", F.explode("posts").alias("p")).select("term", "seg", "p.*")
            late = wanted.select("query_id", "chunk_id", "term", "idf", "seg").join(blocks, ["term", "seg", "chunk_id"]).select("query_id", "chunk_id", gain(F.col("tf"), F.col("dl")).alias("score"))
            return hits.select("query_id", "chunk_id", "score").unionByName(late).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))

        nine = F.floor(F.col("score") * 1e9 + 0.5) / 1e9  # round() goes by decimals, which takes longer than all else of a hit
        best_k = lambda hits: ranked(hits.select("query_id", "chunk_id", nine.alias("score")), k)
        if prune is None:
            prune = n_posts > PRUNE_OVER
        if not prune or not self.about["segments"]:
            return best_k(summed(t, False))
        by_bound = of_query.orderBy(F.desc("bound"), "term")
        before = F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("bound").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        t = cut(t.withColumn("first", before < 4 * k).withColumn("rest", rest).withColumn("all", F.sum("bound").over(of_query)))
        best = F.row_number().over(of_query.orderBy(F.desc("score")))
        seeds = cut(summed(t.filter("first"), False).withColumn("r", best).filter(F.col("r") <= 4 * k).drop("r"))
        floors = completed(seeds, t.filter("not first")).withColumn("r", best).filter(F.col("r") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))
        t = cut(t.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))
        leading = t.filter(F.col("rest") >= F.col("floor"))  # the others' bounds together stay below the floor
        added = t.filter(F.col("rest") < F.col("floor"))
        more = added.groupBy("query_id").agg(F.sum("bound").alias("more"))
        hits = summed(leading, True).join(t.select("query_id", "floor").distinct(), "query_id").join(more, "query_id", "left")
        hits = cut(hits.filter(F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("floor")).select("query_id", "chunk_id", "seg", "shard", "score"))
        return best_k(completed(hits, added))
