"""Queries over stored tables: chunks that are loaded, changed, deleted and compacted, and an inverted index over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.inverted import InvertedIndex
from tideline.plans.registry import query
from tideline.sources import documents as sd
from tideline.sources.chunk_table import ChunkTable

_COLUMNS = ["chunk_id", "doc_id", "society", "chapter_section", "version_year", "text"]
#: What the loads below leave.
_STORED = """SELECT chunk_id, doc_id, CASE WHEN doc_id % 10 = 7 THEN 'IACS' ELSE society END AS society, chapter_section,
version_year + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS version_year, CASE WHEN doc_id % 2 = 0 THEN concat('second ', text) ELSE text END AS text
FROM corpus WHERE (doc_id % 3 <> 0 OR doc_id % 2 = 0 OR doc_id % 10 = 7) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"""


def _toxic(t):
    return t.labels.filter("toxic = 1").select("doc_id").distinct()


def stored_chunks(t) -> ChunkTable:
    """A first load, compacted; a second with new texts; a third that moves rows to another society, twice; a deletion."""

    def build(path):
        corpus = t.corpus.select(*_COLUMNS)
        table = ChunkTable.create(t.spark, path, corpus, buckets=8)
        table.load(corpus.filter("doc_id % 3 <> 0"), 0)
        table.compact()
        table.load(corpus.filter("doc_id % 2 = 0").withColumns({"version_year": F.col("version_year") + 1, "text": F.concat(F.lit("second "), "text")}), 1)
        for _ in range(2):
            table.load(corpus.filter("doc_id % 10 = 7").withColumn("society", F.lit("IACS")), 2)
        table.delete_documents(_toxic(t), 3)

    return ChunkTable(t.spark, t.once("chunks", build))


@query("SELECT chunk_id, society, version_year, md5(text) AS digest FROM stored", stored=_STORED)
def a7_incremental_upsert(t):
    return stored_chunks(t).rows().select("chunk_id", "society", "version_year", F.md5("text").alias("digest"))


@query("SELECT doc_id, count(*) AS n_deleted FROM corpus WHERE (doc_id % 3 <> 0 OR doc_id % 2 = 0 OR doc_id % 10 = 7) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def a8_stored_delete(t):
    return stored_chunks(t).deleted(3)


@query("SELECT version_year, count(*) AS n FROM stored WHERE society = 'IACS' AND version_year >= 2020 GROUP BY version_year", stored=_STORED)
def a9_stored_count(t):
    found = stored_chunks(t).rows((F.col("society") == "IACS") & (F.col("version_year") >= 2020))
    return found.groupBy("version_year").agg(F.count("*").alias("n"))


@query("SELECT q.item_id AS query_id, s.chunk_id FROM benchmark q JOIN stored s ON s.society = CASE q.item_id % 3 WHEN 0 THEN 'DNV' WHEN 1 THEN 'CCS' ELSE 'BV' END AND s.version_year >= 2017 AND s.chapter_section = concat('Pt.', CAST(q.item_id % 5 + 1 AS VARCHAR), ' Ch.', CAST(q.item_id % 7 + 1 AS VARCHAR))", stored=_STORED)
def b12_stored_filters(t):
    """Filters of many queries as a join: partitions that no query asks for aren't read."""
    pick = F.when(F.col("item_id") % 3 == 0, "DNV").when(F.col("item_id") % 3 == 1, "CCS").otherwise("BV")
    chapter = F.concat(F.lit("Pt."), (F.col("item_id") % 5 + 1).cast("string"), F.lit(" Ch."), (F.col("item_id") % 7 + 1).cast("string"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), pick.alias("society"), chapter.alias("chapter_section"))
    return stored_chunks(t).rows(F.col("version_year") >= 2017).join(asked, ["society", "chapter_section"]).select("query_id", "chunk_id")


@query("SELECT doc_id, chunk_id FROM stored WHERE society = 'ABS' AND chapter_section = 'Pt.2 Ch.2'", stored=_STORED)
def b13_stored_conjunction(t):
    return stored_chunks(t).rows(sd.conjunction({"society": "ABS", "chapter_section": "Pt.2 Ch.2", "domain": ""}, drop_empty=True)).select("doc_id", "chunk_id")


# ---------------------------------------------------------------- the index


def stored_index(t) -> InvertedIndex:
    """The documents by id, with the fields lang and source; texts as they are."""

    def build(path):
        docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
        InvertedIndex.create(t.spark, path, docs, ("lang", "source")).add(docs, 0)

    return InvertedIndex(t.spark, t.once("index", build))


def changed_index(t) -> InvertedIndex:
    """Three loads: even documents, then every third one (again) with its words doubled and the source 'new', then toxic ones go."""

    def build(path):
        docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
        index = InvertedIndex.create(t.spark, path, docs, ("lang", "source"))
        index.add(docs.filter("chunk_id % 2 = 0"), 0)
        index.add(docs.filter("chunk_id % 3 = 0").withColumns({"text": F.concat("text", F.lit(" "), "text"), "source": F.lit("new")}), 1)
        index.delete(_toxic(t).withColumnRenamed("doc_id", "chunk_id"), 2)

    return InvertedIndex(t.spark, t.once("changed-index", build))


BM25_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_ASKED = f"SELECT DISTINCT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS asked, unnest({BM25_WORDS.format('text')}) AS term FROM benchmark"
ALL = "SELECT doc_id AS chunk_id, text, lang, source FROM documents"
_CHANGED = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' ', text) ELSE text END AS text, lang, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"
_SPLIT = f"SELECT chunk_id, lang, source, len(w) AS dl, w FROM (SELECT *, {BM25_WORDS.format('text')} AS w FROM held)"
_POSTS = "SELECT term, chunk_id, lang, source, dl, count(*) AS tf FROM (SELECT chunk_id, lang, source, dl, unnest(w) AS term FROM split) GROUP BY ALL"
_SCORED = "SELECT query_id, chunk_id, any_value(asked) AS asked, any_value(lang) AS lang, any_value(source) AS source, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / c.avgdl))), 9) AS score FROM asked_terms JOIN posts USING (term) JOIN (SELECT term, count(*) AS df FROM posts GROUP BY term) f USING (term), (SELECT count(*) AS n, avg(dl) AS avgdl FROM split) c GROUP BY query_id, chunk_id"
_TOP = "SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE {}) WHERE rank <= 20"
BM25_VIEWS = {"asked_terms": _ASKED, "split": _SPLIT, "posts": _POSTS, "scored": _SCORED}


def _queries(t):
    lang = F.when(F.col("item_id") % 4 == 0, "en").when(F.col("item_id") % 4 == 1, "fr").when(F.col("item_id") % 4 == 2, "de")
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text", lang.alias("asked"))


@query(_TOP.format("(asked IS NULL OR lang = asked) AND source <> 'src1'"), held=ALL, **BM25_VIEWS)
def d4_bm25_filtered(t):
    """The query's language, where it names one, and all sources but one."""
    return stored_index(t).search(_queries(t), where=(F.col("asked").isNull() | (F.col("lang") == F.col("asked"))) & (F.col("source") != "src1"))


@query(_TOP.format("true"), held=_CHANGED, **BM25_VIEWS)
def d4_bm25_changed(t):
    return changed_index(t).search(_queries(t))
