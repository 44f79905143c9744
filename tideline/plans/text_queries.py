"""Sources, text predicates, chunks and document tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.functions import text as tx
from tideline.operators import tables as tb
from tideline.operators.graph import shared_dir
from tideline.plans.registry import MARKDOWN_SPARK, query
from tideline.sources import documents as sd

_SOC = "CASE " + " ".join("WHEN regexp_matches({t}, '" + p.replace("'", "''") + f"') THEN '{s}'" for p, s in lx.SOCIETY_PATTERNS) + " END"
_HEADS = "CASE page_id % 6 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '504B030414000600' WHEN 3 THEN '3C68746D6C3E0A20' WHEN 4 THEN '0000000000000000' END"
_EXT = "CASE page_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'HTML' WHEN 2 THEN 'xyz' ELSE 'csv' END"
_FMT = "CASE WHEN lower(h) LIKE '255044462d%' THEN 'pdf' WHEN lower(h) LIKE '89504e47%' THEN 'image' WHEN lower(h) LIKE '3c68746d6c%' THEN 'html' WHEN lower(ext) IN ('docx', 'html', 'csv') THEN lower(ext) END"


def _files(t):
    return t.pages.select("page_id", F.concat(F.lit("in/p"), F.col("page_id").cast("string"), F.lit("."), F.expr(_EXT)).alias("path"), F.unhex(F.expr(_HEADS)).alias("content"))


@query(f"SELECT page_id, {_FMT} AS format FROM (SELECT page_id, {_HEADS} AS h, {_EXT} AS ext FROM pages)")
def a2_detect_format(t):
    return _files(t).select("page_id", sd.detect_format(F.col("path"), F.col("content")).alias("format"))


def _written(t, name):
    """A new folder in the shared place."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT lang, source, lang IN ('en', 'fr') AS success, CASE WHEN lang IN ('en', 'fr') THEN NULL ELSE 'unsupported extension: txt' END AS error, CASE WHEN lang IN ('en', 'fr') THEN 'csv' END AS format, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY lang, source")
def a1_read_batch(t):
    """Files of document ids by language and source, read as a batch; those of two languages have an extension that nobody knows."""
    path = _written(t, "files")
    ids = t.documents.select("lang", "source", F.col("doc_id").cast("string").alias("value")).repartition("lang", "source")
    ids.filter("lang in ('en', 'fr')").write.partitionBy("lang", "source").csv(f"{path}/known")
    ids.filter("lang not in ('en', 'fr')").write.partitionBy("lang", "source").text(f"{path}/unknown")
    found = sd.read_batch(t.spark, f"{path}/*/*/*/*")
    lang, source = (F.regexp_extract("path", f"/{n}=([^/]*)/", 1).alias(n) for n in ("lang", "source"))
    # A folder may hold several files.
    return found.groupBy(lang, source, "success", "error", "format").agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query(f"SELECT page_id, format, CASE WHEN h IS NULL THEN 'no content' WHEN format IS NULL THEN concat('unsupported extension: ', lower(ext)) END AS error, h IS NOT NULL AND format IS NOT NULL AS success FROM (SELECT *, {_FMT} AS format FROM (SELECT page_id, {_HEADS} AS h, {_EXT} AS ext FROM pages))")
def a1_batch_source(t):
    return sd.with_status(_files(t)).select("page_id", "format", "error", "success")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text,
nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') AS title FROM pages""")
def a3_html_text(t):
    return t.pages.select("page_id", sd.html_text(F.col("html")).alias("text"), sd.page_title(F.col("html")).alias("title"))


@query("SELECT doc_id, concat('d', CAST(doc_id AS VARCHAR)) AS filename, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS language, 'general' AS domain, CASE WHEN doc_id % 2 = 0 THEN source END AS system, '[]' AS vessel_types, '{}' AS custom_tags FROM documents")
def a4_document_record(t):
    fields = F.map_concat(
        F.create_map(F.lit("filename"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("language"), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("system"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return t.documents.select("doc_id", *sd.document_record(fields)).select("doc_id", "filename", "language", "domain", "system", "vessel_types", "custom_tags")


@query("SELECT doc_id, md5(text) AS digest, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def a5_packed_sink(t):
    """All documents to packed files, and those of good quality read back by the index."""
    path = t.once("packed", lambda path: sd.write_packed(t.documents, path, file_bytes=4 << 20))
    found = sd.read_packed(t.spark, path, t.labels.filter("quality = 1"))
    x = F.from_json("value", "doc_id bigint, text string, n_chars bigint")
    return found.select(x.alias("x")).select("x.doc_id", F.md5("x.text").alias("digest"), "x.n_chars")


@query("SELECT strftime(o_orderdate, '%Y%m') AS folder, o_orderkey, o_totalprice, o_orderpriority, false AS refused FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT NULL, o_orderkey, NULL, NULL, true FROM orders WHERE o_orderkey % 7 = 0")
def a5_document_sink(t):
    """Orders as JSON in a folder of each month, read again; every seventh has no payload and is refused."""
    path = _written(t, "json")
    payload = F.when(F.col("o_orderkey") % 7 != 0, F.to_json(F.struct("o_orderkey", "o_totalprice", "o_orderpriority")))
    month = F.date_format("o_orderdate", "yyyyMM").alias("month")
    refused = sd.write_documents(t.orders.select(month, "o_orderkey", payload.alias("payload")).repartition("month"), path, "month")
    back = F.from_json("payload", "o_orderkey bigint, o_totalprice double, o_orderpriority string")
    good = sd.read_documents(t.spark, path, "month").select(F.col("month").alias("folder"), back.alias("b")).select("folder", "b.*", F.lit(False).alias("refused"))
    bad = refused.select(F.lit(None).cast("string").alias("folder"), "o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderpriority"), F.lit(True).alias("refused"))
    return good.unionByName(bad)


@query("""SELECT doc_id, string_agg(b, chr(10) ORDER BY table_no, b) AS csv FROM (SELECT l_orderkey AS doc_id, l_linenumber AS table_no, concat('# Table ', CAST(l_linenumber AS VARCHAR), chr(10), CASE WHEN l_partkey % 5 = 4 THEN '# (failed)' ELSE concat('part,flag', chr(10), CAST(l_partkey AS VARCHAR), ',', l_returnflag) END) AS b FROM lineitem) GROUP BY doc_id""")
def a6_table_csv(t):
    csv = F.when(F.col("l_partkey") % 5 != 4, F.concat(F.lit("part,flag\n"), F.col("l_partkey").cast("string"), F.lit(","), "l_returnflag"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("table_no"), csv.alias("csv"))
    return sd.table_csv(rows)


@query("""SELECT chunk_id, load_no, version_year FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY load_no DESC) AS r FROM (
SELECT chunk_id, 1 AS load_no, version_year FROM corpus UNION ALL SELECT chunk_id, 2, version_year + 1 FROM corpus WHERE doc_id % 3 = 0)) WHERE r = 1""")
def a7_upsert_chunks(t):
    old = t.corpus.select("chunk_id", F.lit(1).alias("load_no"), "version_year")
    new = t.corpus.filter("doc_id % 3 = 0").select("chunk_id", F.lit(2).alias("load_no"), (F.col("version_year") + 1).alias("version_year"))
    return sd.upsert(old, new)


@query("SELECT source, count(*) AS n_left FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY source")
def a8_delete_by_document(t):
    left, _ = sd.delete_by_document(t.documents.select("doc_id", "source"), t.labels.filter("toxic = 1"))
    return left.groupBy("source").agg(F.count("*").alias("n_left"))


@query("SELECT l.doc_id, count(*) AS n_deleted FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY l.doc_id")
def a8_delete_counts(t):
    return sd.delete_by_document(t.documents.select("doc_id"), t.labels.filter("toxic = 1"))[1]


@query("SELECT count(*) AS n FROM corpus WHERE society = 'DNV' AND version_year = 2015")
def a9_filtered_count(t):
    return t.corpus.filter(sd.conjunction({"society": "DNV", "version_year": 2015})).agg(F.count("*").alias("n"))


@query(f"SELECT chunk_id, coalesce({_SOC.format(t='text')}, 'Unknown') AS society FROM corpus")
def b1_society(t):
    return t.corpus.select("chunk_id", tx.society(F.col("text"), default="Unknown").alias("society"))


@query(r"""SELECT d.doc_id, coalesce(nullif(regexp_replace(regexp_extract(CASE WHEN p.page_id % 2 = 0 THEN url ELSE '' END, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), ''), nullif(trim(substr(regexp_extract(trim(d.text), '^([^\n]*)', 1), 1, 120)), ''), 'Unknown') AS regulation FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def b2_regulation_name(t):
    j = t.documents.join(t.pages, F.col("doc_id") == F.col("page_id"), "left")
    return j.select("doc_id", tx.regulation_name(F.col("text"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("")).alias("regulation"))


@query(r"SELECT chunk_id, nullif(regexp_extract(text, '(20\d{2}|19\d{2})', 1), '') AS version_year FROM corpus")
def b3_version_year(t):
    return t.corpus.select("chunk_id", tx.version_year(F.col("text")).alias("version_year"))


@query(f"SELECT chunk_id, nullif(trim(regexp_extract(text, '{lx.CHAPTER}', 0)), '') AS chapter FROM corpus")
def b4_chapter(t):
    return t.corpus.select("chunk_id", tx.chapter_section(F.col("text")).alias("chapter"))


_STOPS = ", ".join(f"('{lang}', '{w}')" for lang, ws in lx.STOP_WORDS.items() for w in ws)


@query(f"""SELECT doc_id, coalesce(max(lang_hit) FILTER (WHERE r = 1), 'unknown') AS language FROM (
SELECT d.doc_id, v.lang AS lang_hit, row_number() OVER (PARTITION BY d.doc_id ORDER BY v.n DESC, v.lang) AS r FROM documents d LEFT JOIN (
SELECT doc_id, s.lang, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r.,;:!?]+')) AS w FROM documents) x JOIN (VALUES {_STOPS}) s(lang, w) ON s.w = x.w GROUP BY doc_id, s.lang) v USING (doc_id)) GROUP BY doc_id""")
def b5_language(t):
    """A vote of stop words: shared words count for each of their languages; ties go to the first name."""
    stops = t.spark.createDataFrame([(lang, w) for lang, ws in lx.STOP_WORDS.items() for w in ws], "hit string, w string")
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), "[ \t\n\r.,;:!?]+")).alias("w"))
    votes = words.join(F.broadcast(stops), "w").groupBy("doc_id", "hit").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "hit")).alias("b"))
    return t.documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("b.hit", F.lit("unknown")).alias("language"))


@query(rf"SELECT chunk_id, coalesce({_SOC.format(t='text')}, 'Unknown') AS society, nullif(regexp_extract(text, '(20\d{{2}}|19\d{{2}})', 1), '') AS version_year, nullif(trim(regexp_extract(text, '{lx.CHAPTER}', 0)), '') AS chapter, chunk_id AS regulation FROM corpus")
def b6_metadata(t):
    c = F.col("text")
    bundle = F.struct(tx.society(c, default="Unknown").alias("society"), tx.version_year(c).alias("version_year"), tx.chapter_section(c).alias("chapter"), tx.regulation_name(c, F.concat("chunk_id", F.lit(".pdf"))).alias("regulation"))
    return t.corpus.select("chunk_id", bundle.alias("m")).select("chunk_id", "m.*")


_KW = r"list_concat(regexp_extract_all(text, '\b[A-Z]{2,4}\d{2,3}\b'), list_transform(regexp_extract_all(text, '\d{2,4}\s*[°º]?\s*[CF]\b'), lambda x: trim(x)))"


@query(f"SELECT chunk_id, w AS keyword, min(i) AS first_at FROM (SELECT chunk_id, unnest(k) AS w, generate_subscripts(k, 1) - 1 AS i FROM (SELECT chunk_id, {_KW} AS k FROM corpus)) GROUP BY chunk_id, w")
def b7_keywords(t):
    k = F.concat(F.regexp_extract_all("text", F.lit(tx.as_re2(lx.STEEL_GRADE)), F.lit(0)), F.transform(F.regexp_extract_all("text", F.lit(tx.as_re2(lx.TEMPERATURE)), F.lit(0)), lambda x: F.trim(x)))
    distinct = t.corpus.select("chunk_id", k.alias("all"), F.explode(tx.keywords(F.col("text"))).alias("keyword"))
    return distinct.select("chunk_id", "keyword", (F.array_position("all", F.col("keyword")) - 1).cast("long").alias("first_at"))


@query(rf"""SELECT chunk_id, {_SOC.format(t='text')} AS society, nullif(trim(regexp_extract(text, '{lx.CHAPTER}', 0)), '') AS chapter, TRY_CAST(nullif(regexp_extract(text, '(20\d{{2}}|19\d{{2}})', 1), '') AS INTEGER) AS year,
trim(regexp_replace(list_reduce(list_concat([text], {_KW}), lambda a, k: replace(a, k, '')), '\s+', ' ', 'g')) AS semantic_query FROM corpus""")
def b8_query_analysis(t):
    c = F.col("text")
    return t.corpus.select("chunk_id", tx.society(c).alias("society"), tx.chapter_section(c).alias("chapter"), tx.version_year(c).cast("int").alias("year"), tx.semantic_query(c, tx.keywords(c)).alias("semantic_query"))


_CODES = "CASE item_id % 3 WHEN 0 THEN concat(' DNV-ST-N', CAST(item_id AS STRING), ' ') WHEN 1 THEN concat('ABS rules ', CAST(item_id AS STRING)) ELSE text END"
_EXACT = "regexp_matches(trim(q), '^[A-Z]{2,6}-[A-Za-z0-9-]+$')"
_KEYQ = r"len(list_filter(string_split_regex(trim(q), '\s+'), lambda w: w <> '')) <= 5 AND len(list_filter(string_split_regex(trim(q), '\s+'), lambda w: upper(w) = w AND lower(w) <> w AND length(w) >= 2)) > 0"


@query(f"SELECT item_id, {_EXACT} AS exact FROM (SELECT item_id, {_CODES} AS q FROM benchmark)")
def b9_exact_code(t):
    return t.benchmark.select("item_id", tx.is_exact(F.expr(_CODES)).alias("exact"))


@query(f"SELECT item_id, {_KEYQ} AS keyword_query FROM (SELECT item_id, {_CODES} AS q FROM benchmark)")
def b10_keyword_query(t):
    return t.benchmark.select("item_id", tx.is_keyword(F.expr(_CODES)).alias("keyword_query"))


@query(f"SELECT item_id, CASE WHEN {_EXACT} THEN 'sparse' WHEN {_KEYQ} THEN 'fused' ELSE 'reranked' END AS path FROM (SELECT item_id, {_CODES} AS q FROM benchmark)")
def b11_path(t):
    return t.benchmark.select("item_id", tx.path(F.expr(_CODES)).alias("path"))


@query("SELECT q.doc_id AS query_id, count(*) AS n FROM corpus q JOIN corpus c ON c.society = q.society AND c.version_year >= 2018 - 3 AND (q.doc_id % 3 <> 0 OR c.chapter_section = q.chapter_section) WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id")
def b12_filters(t):
    """Derived filters as a join: society always, chapter where the query names one, else the last three years before 2018."""
    q = t.corpus.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("society").alias("qs"), F.when(F.col("doc_id") % 3 == 0, F.col("chapter_section")).alias("qc"))
    hit = (F.col("society") == F.col("qs")) & (F.col("version_year") >= 2018 - 3) & (F.col("qc").isNull() | (F.col("chapter_section") == F.col("qc")))
    return t.corpus.join(q, hit).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, chunk_id FROM corpus WHERE society = 'ABS' AND chapter_section = 'Pt.2 Ch.2'")
def b13_conjunction(t):
    return t.corpus.filter(sd.conjunction({"society": "ABS", "chapter_section": "Pt.2 Ch.2", "domain": ""}, drop_empty=True)).select("doc_id", "chunk_id")


_SECTION = "concat(chapter_section, CASE doc_id % 3 WHEN 0 THEN ' §2.1' WHEN 1 THEN ' Section 4' ELSE '' END)"
_STRIP = r"""CASE WHEN regexp_matches({s}, '\s*§\s*\d+(?:\.\d+)?$') THEN nullif(trim(regexp_replace({s}, '\s*§\s*\d+(?:\.\d+)?$', '')), '')
WHEN regexp_matches({s}, '(?i)\s*S(?:ec(?:tion)?)?\.?\s*\d+(?:\.\d+)?$') THEN nullif(trim(regexp_replace({s}, '(?i)\s*S(?:ec(?:tion)?)?\.?\s*\d+(?:\.\d+)?$', '')), '')
WHEN regexp_matches({s}, '(?i)\s*Ch(?:apter)?\.?\s*\d+$') AND trim(regexp_replace({s}, '(?i)\s*Ch(?:apter)?\.?\s*\d+$', '')) <> '' THEN trim(regexp_replace({s}, '(?i)\s*Ch(?:apter)?\.?\s*\d+$', ''))
WHEN regexp_matches({s}, '(?i)\s*P(?:t|art)\.?\s*\d+$') THEN nullif(trim(regexp_replace({s}, '(?i)\s*P(?:t|art)\.?\s*\d+$', '')), '') END"""


@query(f"SELECT doc_id, {_STRIP.format(s='s')} AS stripped FROM (SELECT doc_id, {_SECTION} AS s FROM corpus)")
def b14_strip_section(t):
    return t.corpus.select("doc_id", tx.strip_section(F.expr(_SECTION)).alias("stripped"))


@query(f"""SELECT doc_id, CAST(level AS INTEGER) AS level, section FROM (SELECT doc_id, 0 AS level, s0 AS section FROM lv UNION ALL SELECT doc_id, 1, s1 FROM lv WHERE s1 IS NOT NULL UNION ALL SELECT doc_id, 2, s2 FROM lv WHERE s1 IS NOT NULL AND s2 IS NOT NULL
UNION ALL SELECT doc_id, CASE WHEN s1 IS NULL THEN 1 WHEN s2 IS NULL THEN 2 ELSE 3 END, NULL FROM lv) WHERE level < 3""",
       lv=f"SELECT *, {_STRIP.format(s='s1')} AS s2 FROM (SELECT *, {_STRIP.format(s='s0')} AS s1 FROM (SELECT doc_id, {_SECTION} AS s0 FROM corpus))")
def b15_fallback_chain(t):
    return t.corpus.select("doc_id", F.posexplode(tx.fallback_levels(F.expr(_SECTION))).alias("level", "section"))


_SCORE = "(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 12 > 8 OR l_quantity > 50 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END)"


def _scored(t):
    score = tb.complexity(F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 5 == 0, F.col("l_suppkey") % 12, F.col("l_quantity"), F.col("l_partkey") % 7 == 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", score.alias("c"))


@query(f"SELECT l_orderkey, l_linenumber, {_SCORE} <= 0 AS stored FROM lineitem")
def b16_store_gate(t):
    review = F.when(F.col("c.score") > 0, True)
    return _scored(t).select("l_orderkey", "l_linenumber", tb.stored(review).alias("stored"))


_LEX = {"first": ["enth", "tion "], "second": ["ando", "ento"], "third": ["ich", "eau"]}


@query("SELECT doc_id, concat(CASE WHEN contains(text, 'enth') OR contains(text, 'tion ') THEN 'first' WHEN contains(text, 'ando') OR contains(text, 'ento') THEN 'second' WHEN contains(text, 'ich') OR contains(text, 'eau') THEN 'third' ELSE lang END, '/', CASE WHEN contains(text, 'welding') THEN '焊接' ELSE '通用' END) AS label FROM documents")
def b17_classify(t):
    label = F.concat(tx.first_keyword(F.col("text"), _LEX, F.col("lang")), F.lit("/"), tx.first_keyword(F.col("text"), {"焊接": ["welding"]}, F.lit("通用")))
    return t.documents.select("doc_id", label.alias("label"))


@query("""SELECT doc_id, CAST(b AS INTEGER) AS position, string_agg(u, chr(10) ORDER BY i) AS text, CAST(greatest(1, floor((sum(length(u)) + count(*) - 1) / 4)) AS INTEGER) AS n_tokens FROM fold GROUP BY doc_id, b""",
       ln="SELECT doc_id, line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE trim(line) <> ''",
       un="SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i FROM (SELECT doc_id, n, k, substr(line, 1 + 512 * k, 512) AS u FROM (SELECT doc_id, line, n, unnest(range(0, greatest(1, CAST(ceil(length(line) / 512) AS BIGINT)))) AS k FROM ln))",
       fold="SELECT doc_id, i, u, length(u) AS c, 0 AS b FROM un WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, x.u, CASE WHEN floor((f.c + 1 + length(x.u)) / 4) <= 128 THEN f.c + 1 + length(x.u) ELSE length(x.u) END, CASE WHEN floor((f.c + 1 + length(x.u)) / 4) <= 128 THEN f.b ELSE f.b + 1 END FROM fold f JOIN un x ON x.doc_id = f.doc_id AND x.i = f.i + 1")
def c1_chunker(t):
    return tb.chunks(t.documents, 128)


@query(f"SELECT l_orderkey, l_linenumber, {_SCORE} AS score, concat_ws('; ', CASE WHEN l_linenumber > 3 THEN 'merged cells' END, CASE WHEN l_returnflag = 'R' THEN 'crosses pages' END, CASE WHEN l_partkey % 2 = 0 THEN 'footnote references' END, CASE WHEN l_partkey % 3 = 0 THEN 'parenthetical values' END, CASE WHEN l_partkey % 5 = 0 THEN 'footnotes' END, CASE WHEN l_suppkey % 12 > 8 OR l_quantity > 50 THEN 'large' END, CASE WHEN l_partkey % 7 = 0 THEN 'borderless' END) AS reasons FROM lineitem")
def c2_table_complexity(t):
    return _scored(t).select("l_orderkey", "l_linenumber", "c.score", F.array_join("c.reasons", "; ").alias("reasons"))


@query(f"SELECT CASE WHEN s <= 0 THEN 'pass' WHEN s <= 2 THEN 'low_confidence' ELSE 'blocked' END AS gate, count(*) AS n FROM (SELECT {_SCORE} AS s FROM lineitem) GROUP BY 1")
def c3_quality_gate(t):
    return _scored(t).groupBy(tb.quality_gate(F.col("c.score")).alias("gate")).agg(F.count("*").alias("n"))


@query("SELECT table_id, 'line,part,flag' AS header, len(string_split(markdown, chr(10))) - 2 AS n_rows FROM tables_md")
def c4_headers(t):
    h = tb.headers(t.sql(MARKDOWN_SPARK))
    return h.select("table_id", F.array_join(F.flatten("headers"), ",").alias("header"), F.size("rows").cast("long").alias("n_rows"))


@query("""SELECT table_id, row_no, col_no, cell, ['line', 'part', 'flag'][col_no + 1] AS col_header, CASE WHEN col_no > 0 THEN cells[1] ELSE '' END AS row_header,
CASE WHEN col_no > 0 THEN concat(['line', 'part', 'flag'][col_no + 1], ' / ', cells[1]) ELSE 'line' END AS header_path FROM (
SELECT table_id, row_no, cells, unnest(cells) AS cell, CAST(generate_subscripts(cells, 1) - 1 AS INTEGER) AS col_no FROM (
SELECT table_id, CAST(i - 1 AS INTEGER) AS row_no, list_transform(string_split(trim(line, '|'), '|'), lambda x: trim(x)) AS cells FROM (
SELECT table_id, unnest(lines[3:]) AS line, generate_subscripts(lines[3:], 1) AS i FROM (SELECT table_id, string_split(markdown, chr(10)) AS lines FROM tables_md))))""")
def c5_cells(t):
    return tb.annotated_cells(t.sql(MARKDOWN_SPARK))


def _fragments(t):
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_returnflag") == "N").alias("has_headers"), F.concat(F.lit("|"), F.col("l_partkey").cast("string"), F.lit("|")).alias("markdown"))


_GROUPS = """SELECT *, CAST(sum(CASE WHEN page = pp + 1 AND NOT has_headers AND ph THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, markdown, has_headers) AS BIGINT) AS group_no FROM (
SELECT *, lag(page) OVER w AS pp, lag(has_headers) OVER w AS ph FROM (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_returnflag = 'N' AS has_headers, concat('|', CAST(l_partkey AS VARCHAR), '|') AS markdown FROM lineitem) WINDOW w AS (PARTITION BY doc_id ORDER BY page, markdown, has_headers))"""


@query("SELECT doc_id, page, group_no FROM grp", grp=_GROUPS)
def c6_page_splits(t):
    return tb.split_groups(_fragments(t)).select("doc_id", "page", "group_no")


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS INTEGER)) AS n_tokens FROM documents")
def c7_token_estimate(t):
    return t.documents.select("doc_id", tx.tokens(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, group_no, string_agg(markdown, concat(chr(10), '<!-- continued -->', chr(10)) ORDER BY page, markdown) AS markdown, min(page) AS start_page, max(page) AS end_page, count(*) AS n_fragments FROM grp GROUP BY doc_id, group_no", grp=_GROUPS)
def c8_merge_fragments(t):
    return tb.merged_fragments(tb.split_groups(_fragments(t)))


@query("""SELECT source AS doc_id, CAST(b AS INTEGER) AS batch_no, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS n_tokens FROM fold GROUP BY source, b""",
       items="SELECT doc_id AS source, greatest(0, CAST(floor(length(line) / 4) AS BIGINT)) AS c, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)",
       fold="SELECT source, i, c, c AS t, 1 AS n, 0 AS b FROM items WHERE i = 1 UNION ALL SELECT x.source, x.i, x.c, CASE WHEN f.t + x.c > 300 OR f.n >= 20 THEN x.c ELSE f.t + x.c END, CASE WHEN f.t + x.c > 300 OR f.n >= 20 THEN 1 ELSE f.n + 1 END, CASE WHEN f.t + x.c > 300 OR f.n >= 20 THEN f.b + 1 ELSE f.b END FROM fold f JOIN items x ON x.source = f.source AND x.i = f.i + 1")
def c9_token_batches(t):
    """The lines of a document."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return tb.token_batches(lines.select("doc_id", "line_no", tx.tokens(F.col("line"), 0).alias("c")), "doc_id", "line_no", "c", 300, 20)


@query("SELECT page_id, md5(replace(html, concat('<!-- ad ', CAST(page_id AS VARCHAR), ' -->'), concat('![f](', CAST(page_id AS VARCHAR), '.png)'))) AS bound FROM pages")
def c10_figures(t):
    link = F.array(F.concat(F.lit("![f]("), F.col("page_id").cast("string"), F.lit(".png)")))
    return t.pages.select("page_id", F.md5(tb.bind_figures(F.col("html"), link, r"<!-- ad \d+ -->")).alias("bound"))
