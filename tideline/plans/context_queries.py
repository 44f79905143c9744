"""Context, history, usage and research queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.operators import context as cx
from tideline.operators import research as rs
from tideline.operators import retrieval as rt
from tideline.operators.inverted import InvertedIndex
from tideline.plans.registry import GRAPH_NODES, query

_TIER = "CASE user_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'pro' ELSE 'enterprise' END"
_HITS = "SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank, concat('d', CAST(doc_id AS VARCHAR)) AS citation, text, lang AS file, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 3 AS VARCHAR) END AS regulation FROM documents"


def _hits(t):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select(F.col("source").alias("query_id"), rank.alias("rank"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("citation"), "text", F.col("lang").alias("file"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 3).cast("string")).alias("regulation"))


def _events(t):
    return t.events.withColumn("tier", F.expr(_TIER))


@query("SELECT source, count(*) AS n, CAST(count(error) AS BIGINT) AS n_errors FROM (SELECT 'chunks' AS source, NULL AS error FROM documents UNION ALL SELECT 'graph', NULL FROM nodes UNION ALL SELECT 'web', 'unreachable') GROUP BY source")
def f1_sources(t):
    rows = cx.tagged_union({"chunks": t.documents.select(F.col("doc_id").cast("string").alias("id")), "graph": t.sql(GRAPH_NODES).select(F.col("entity_id").alias("id"))}, {"web": "unreachable"})
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


@query("SELECT query_id, count(*) AS n_used, CAST(sum(cost) AS BIGINT) AS n_tokens, string_agg(line, concat(chr(10), chr(10)) ORDER BY rank) AS context FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, greatest(1, CAST(floor(length(line) / 4) AS BIGINT)) AS cost FROM (SELECT *, concat('[Source ', citation, '] ', text) AS line FROM h))) WHERE total <= 20000 GROUP BY query_id", h=_HITS)
def f2_packed_context(t):
    return cx.packed_context(_hits(t), 20000)


_SECTIONS = {
    "h": _HITS,
    "pk": "SELECT query_id, string_agg(line, concat(chr(10), chr(10)) ORDER BY rank) AS passages FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, greatest(1, CAST(floor(length(line) / 4) AS BIGINT)) AS cost FROM (SELECT *, concat('[Source ', citation, '] ', text) AS line FROM h))) WHERE total <= 2000 GROUP BY query_id",
    "fa": "SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS facts FROM (SELECT query_id, rank, concat('- ', split_part(text, '.', 1)) AS line FROM h WHERE rank <= 15) GROUP BY query_id",
    "en": "SELECT query_id, string_agg(line, chr(10) ORDER BY r) AS entities FROM (SELECT query_id, line, row_number() OVER (PARTITION BY query_id ORDER BY file, line) AS r FROM (SELECT DISTINCT query_id, file, concat('- ', file, ' (language)') AS line FROM h WHERE file <> 'es')) WHERE r <= 20 GROUP BY query_id",
    "re": "SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS relations FROM (SELECT query_id, rank, concat('- ', citation, ' -> written_in -> ', file) AS line FROM h WHERE rank <= 10) GROUP BY query_id",
}


@query("""SELECT query_id, concat_ws(concat(chr(10), chr(10)), concat('## Key Facts', chr(10), facts), CASE WHEN passages IS NOT NULL THEN concat('## Document Context', chr(10), passages) END,
CASE WHEN entities IS NOT NULL THEN concat('## Knowledge Graph', chr(10), '### Entities', chr(10), entities) END, CASE WHEN entities IS NOT NULL THEN concat('### Relations', chr(10), relations) END) AS context FROM fa LEFT JOIN pk USING (query_id) LEFT JOIN en USING (query_id) LEFT JOIN re USING (query_id)""", **_SECTIONS)
def f2_context_sections(t):
    h = _hits(t)
    facts = h.select("query_id", "rank", F.split_part("text", F.lit("."), F.lit(1)).alias("text"))
    entities = h.filter("file <> 'es'").select("query_id", F.col("file").alias("rank"), F.col("file").alias("name"), F.lit("language").alias("etype")).distinct()
    relations = h.select("query_id", "rank", F.col("citation").alias("src"), F.lit("written_in").alias("rtype"), F.col("file").alias("dst"))
    return cx.context_sections(cx.packed_context(h, 2000), facts, entities, relations)


@query("""SELECT conv_id, turn, CAST(total AS INTEGER) AS total, CAST(trunc(total * (r * f)) AS INTEGER) AS retrieval, CAST(trunc(total * h) AS INTEGER) AS history, CAST(trunc(total * CASE WHEN f0 THEN CASE total WHEN 4000 THEN 0.5::DOUBLE WHEN 8000 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END ELSE greatest(0.1::DOUBLE, (total - trunc(total * (r * f)) - trunc(total * h)) / total) END) AS INTEGER) AS generation FROM (
SELECT conv_id, turn, length(text) = 0 AS f0, CASE WHEN length(text) = 0 THEN 1.0::DOUBLE ELSE least(1.5::DOUBLE, greatest(0.5::DOUBLE, length(text) / 500.0::DOUBLE)) END AS f, CASE conv_id % 3 WHEN 0 THEN 4000.0::DOUBLE WHEN 1 THEN 8000.0::DOUBLE ELSE 16000.0::DOUBLE END AS total, CASE conv_id % 3 WHEN 0 THEN 0.30::DOUBLE WHEN 1 THEN 0.40::DOUBLE ELSE 0.50::DOUBLE END AS r, 0.20::DOUBLE AS h FROM conversations WHERE role = 'user')""")
def f3_token_budget(t):
    tier = F.expr("CASE conv_id % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'pro' ELSE 'enterprise' END")
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", cx.budget(tier, F.col("text")).alias("b")).select("conv_id", "turn", "b.*")


_CIT = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, file, regulation) AS INTEGER) AS idx, file, regulation, substr(text, 1, 200) AS excerpt FROM (SELECT query_id, file, coalesce(regulation, '') AS regulation, min(rank) AS rank, arg_min(text, rank) AS text FROM h GROUP BY query_id, file, coalesce(regulation, ''))"


@query("SELECT * FROM cit", h=_HITS, cit=_CIT)
def f4_citations(t):
    return cx.citations(_hits(t))


@query("SELECT c.query_id, idx, file FROM cit c JOIN (SELECT source AS query_id, concat('see [1], [3] and [', CAST(count(*) % 7 AS VARCHAR), ']') AS answer FROM documents GROUP BY source) a USING (query_id) WHERE contains(answer, concat('[', CAST(idx AS VARCHAR), ']'))", h=_HITS, cit=_CIT)
def f5_used_citations(t):
    answers = t.documents.groupBy(F.col("source").alias("query_id")).agg(F.format_string("see [1], [3] and [%d]", F.count("*") % 7).alias("answer"))
    return cx.used_citations(cx.citations(_hits(t)), answers).select("query_id", "idx", "file")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY sys DESC, turn) AS INTEGER) AS place, turn, role, CASE WHEN must OR lft >= cost THEN text ELSE concat(substr(text, 1, CAST(greatest(0, lft * 4 - 3) AS BIGINT)), '...') END AS text FROM (
SELECT *, 150 - needed - before AS lft, sys OR age <= 2 OR others <= 2 AS must FROM (SELECT *, count(age) OVER (PARTITION BY conv_id) AS others, sum(CASE WHEN sys OR age <= 2 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS needed,
coalesce(sum(CASE WHEN age > 2 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id, sys ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
SELECT *, role = 'system' AS sys, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS cost, CASE WHEN role <> 'system' THEN row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) END AS age FROM conversations))) WHERE must OR lft > 0""")
def f6_history(t):
    return cx.compressed_history(t.conversations, 150)


@query("SELECT query_id, concat_ws(' ', query, CASE WHEN contains(lower(query), 'welding') THEN 'weld' END, CASE WHEN contains(lower(query), 'preheat') THEN 'pre-heat' END, CASE WHEN contains(lower(query), 'thickness') THEN 'plate thickness' END, CASE WHEN contains(lower(query), 'requirement') THEN 'criteria' END) AS expanded FROM questions")
def f7_query_expansion(t):
    return t.questions.select("query_id", cx.expanded_query(F.col("query"), 0, lx.SYNONYMS).alias("expanded"))


@query()
def f8_iterative_retrieval(t):
    docs = t.corpus.select("chunk_id", "text")
    index = InvertedIndex(t.spark, t.once("corpus-index", lambda path: InvertedIndex.create(t.spark, path, docs).add(docs, 0)))

    def retrieve(q):
        return rt.rerank(index.search(q, 10), q, docs, 10)

    return cx.iterated(t.questions.select("query_id", F.col("query").alias("text")), retrieve, lx.SYNONYMS)


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN concat('Résumez ', source) WHEN 'de' THEN concat('Summarise ', source) ELSE concat('Summarise ', source) END AS prompt FROM documents")
def f9_prompts(t):
    templates = t.spark.createDataFrame([("sum", "en", "Summarise {value}"), ("sum", "fr", "Résumez {value}")], "id string, lang string, template string")
    asked = t.documents.select("doc_id", F.lit("sum").alias("id"), "lang", F.col("source").alias("value"))
    return cx.prompts(asked, templates, "Answer {value}").select("doc_id", "prompt")


@query("SELECT conv_id, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM (SELECT conv_id, CAST(coalesce(sum(greatest(1, floor(length(text) / 4))) FILTER (WHERE role <> 'assistant'), 0) AS BIGINT) AS p, CAST(coalesce(sum(greatest(1, floor(length(text) / 4))) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS c FROM conversations GROUP BY conv_id)")
def f10_usage(t):
    return cx.usage(t.conversations)


@query(f"SELECT event_id, CASE tier WHEN 'basic' THEN r <= 3 WHEN 'pro' THEN r <= 10 ELSE true END AS admitted FROM (SELECT event_id, {_TIER} AS tier, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events)")
def f11_daily_quota(t):
    return cx.admitted_daily(_events(t)).select("event_id", "admitted")


@query("SELECT event_id, admitted FROM fold",
       ev="SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events",
       fold="SELECT user_id, i, event_id, [us] AS held, true AS admitted FROM ev WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(f.held, lambda h: h > e.us - 86400000000)) < 2 THEN list_append(list_filter(f.held, lambda h: h > e.us - 86400000000), e.us) ELSE list_filter(f.held, lambda h: h > e.us - 86400000000) END, len(list_filter(f.held, lambda h: h > e.us - 86400000000)) < 2 FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1")
def f12_rate_limit(t):
    return cx.admitted_window(_events(t), 86400, {"basic": 2, "pro": 2, "enterprise": 2}).select("event_id", "admitted")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_window FROM events")
def f13_window_usage(t):
    return cx.window_usage(t.events, 86400).select("event_id", "n_window")


@query("SELECT event_type AS mode, count(*) AS n, round(avg(value), 1) AS avg_latency FROM events GROUP BY ROLLUP (event_type)")
def f14_query_metrics(t):
    return cx.query_metrics(t.events.select(F.col("event_type").alias("mode"), F.col("value").alias("latency")))


@query("SELECT c.conv_id, coalesce(n, 0) AS n_messages, last_turn FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations WHERE role <> 'system' GROUP BY conv_id) m USING (conv_id) ORDER BY last_turn DESC NULLS LAST, conv_id LIMIT 20 OFFSET 5")
def f15_conversation_list(t):
    return cx.conversation_list(t.conversations.select("conv_id").distinct(), t.conversations.filter("role <> 'system'"), 20, 5).select("conv_id", "n_messages", "last_turn")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')) WHERE r <= 3")
def f16_message_history(t):
    return cx.message_history(t.conversations, t.conversations.filter("role = 'system'"), 3).select("conv_id", "turn", "role")


def _hit(col, words):
    return " + ".join(f"CASE WHEN contains(lower({col}), '{w.lower()}') THEN 1 ELSE 0 END" for w in words)


def _points(lists, n):
    return " + ".join([f"CASE WHEN contains(query, '{w}') THEN {n} ELSE 0 END" for w in lists[0]] + [f"CASE WHEN regexp_matches(lower(query), '\\b{w}\\b') THEN {n} ELSE 0 END" for w in lists[1]])


_CPLX = rf"least(15, {_hit('query', lx.SOCIETIES)} + CASE WHEN regexp_matches(query, '(?i)Pt\.\s*\d+.*Ch\.\s*\d+') THEN 2 WHEN regexp_matches(query, '(?i)(?:Pt\.|Ch\.|§)\s*\d') THEN 1 ELSE 0 END + {_points(lx.DEEP, 2)} + {_points(lx.SCOPE, 2)} + {_points(lx.DOMAIN, 1)})"


@query(f"SELECT query_id, CAST({_CPLX} AS INTEGER) AS score FROM questions")
def g1_complexity(t):
    return t.questions.select("query_id", rs.complexity(F.col("query"), F.lit(False)).alias("score"))


@query(f"SELECT conv_id, turn, count(*) OVER w = 3 AND min(CASE WHEN ({_hit('text', lx.SOCIETIES)}) > 0 THEN 1 ELSE 0 END) OVER w = 1 AS history_hits FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def g1_history(t):
    return rs.last_three_mention(t.conversations).select("conv_id", "turn", "history_hits")


@query(f"SELECT query_id, CASE WHEN s >= 11 THEN 'auto' WHEN s >= 8 THEN 'strong' WHEN s >= 5 THEN 'suggest' ELSE 'none' END AS level FROM (SELECT query_id, {_CPLX} AS s FROM questions)")
def g2_suggestion(t):
    return t.questions.select("query_id", rs.suggestion(rs.complexity(F.col("query"), F.lit(False))).alias("level"))


_SOCS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), '{s.lower()}') THEN '{s}' END" for s in lx.SOCIETIES) + "], lambda x: x IS NOT NULL)[:8]"


@query(f"""SELECT query_id, CAST(no AS INTEGER) AS no, CASE WHEN s[no] IS NULL THEN substr(query, 1, 120) ELSE concat(s[no], ' requirements for: ', substr(query, 1, 80)) END AS question, CASE WHEN s[no] IS NULL THEN substr(query, 1, 150) ELSE concat(s[no], ' ', substr(query, 1, 100)) END AS search_query, CAST(least(len(s) * 15 + 25, 120) AS INTEGER) AS estimate FROM (
SELECT *, unnest(range(1, len(s) + 1)) AS no FROM (SELECT query_id, query, CASE WHEN len({_SOCS}) > 0 THEN {_SOCS} ELSE [NULL] END AS s FROM questions))""")
def g3_decomposition(t):
    return rs.decomposed(t.questions)


_EV = "SELECT source AS query_id, concat('c', CAST(doc_id AS STRING)) AS chunk_id, CAST(doc_id % 4 AS INT) AS source_no, doc_id AS rank FROM {documents} UNION ALL SELECT source, concat('c', CAST(doc_id AS STRING)), 1, doc_id FROM {documents} WHERE doc_id % 3 = 0"


@query("SELECT query_id, chunk_id, source_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_no, rank) AS r FROM ev) WHERE r = 1", ev=_EV.replace("{documents}", "documents"))
def g4_evidence(t):
    return rs.evidence(t.sql(_EV))


@query("SELECT doc_id AS query_id, CASE WHEN contains(upper(text), 'TION') THEN 'tion' WHEN contains(upper(text), 'ENTH') THEN 'enth' ELSE 'eau' END AS code, CASE WHEN contains(upper(text), 'TION') THEN 'first' WHEN contains(upper(text), 'ENTH') THEN 'second' ELSE 'third' END AS title, 0.8::DOUBLE AS score FROM documents WHERE contains(upper(text), 'TION') OR contains(upper(text), 'ENTH') OR contains(upper(text), 'EAU')")
def g5_standards(t):
    codes = t.spark.createDataFrame([(0, "tion", "first"), (1, "enth", "second"), (2, "eau", "third")], "pos int, code string, title string")
    return rs.standards(t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), codes)


@query("SELECT concat('kg-', md5(concat('[KG] ', etype, ': ', name))) AS chunk_id, concat('[KG] ', etype, ': ', name) AS text, 0.6::DOUBLE AS score FROM nodes")
def g6_graph_evidence(t):
    return rs.graph_evidence(t.sql(GRAPH_NODES))


@query("SELECT url, page_id FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages) WHERE url <> '') WHERE r = 1")
def g7_first_urls(t):
    return rs.first_urls(t.pages.select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("url")), "page_id")


@query("SELECT query_id, concat_ws(' ', query, CASE WHEN query_id % 2 = 0 THEN 'ISO ASTM API standard' END, CASE WHEN query_id % 3 = 0 THEN 'marine accident report MAIB NTSB' END) AS query FROM questions")
def g7_augmented(t):
    tags = F.array_compact(F.array(F.when(F.col("query_id") % 2 == 0, "standards"), F.when(F.col("query_id") % 3 == 0, "cases")))
    return t.questions.select("query_id", rs.augmented(F.col("query"), tags).alias("query"))


_REQ = rf"SELECT lower(p) AS param, society, arg_max(v, doc_id * 1000 + i) AS value FROM (SELECT society, doc_id, i, regexp_extract_all(text, '{lx.REQUIREMENTS[1]}', 1)[i] AS p, TRY_CAST(regexp_extract_all(text, '{lx.REQUIREMENTS[1]}', 2)[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '{lx.REQUIREMENTS[1]}', 1)) + 1)) AS i FROM corpus)) WHERE v IS NOT NULL GROUP BY lower(p), society"


def _values(t):
    return rs.requirements(t.corpus.select("society", F.col("doc_id").alias("seq"), "text"))


@query("SELECT * FROM req", req=_REQ)
def g8_requirements(t):
    return _values(t)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'thickness' WHEN 1 THEN 'speed' ELSE lower(trim(l_linestatus)) END AS param FROM lineitem")
def g9_normalised(t):
    name = F.when(F.col("l_partkey") % 3 == 0, "板厚").when(F.col("l_partkey") % 3 == 1, " Speed ").otherwise(F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rs.normalised(name).alias("param"))


_CON = "SELECT *, CASE WHEN difference_pct >= 10 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT a.param, a.society AS society_a, a.value AS value_a, b.society AS society_b, b.value AS value_b, round_even(abs(a.value - b.value) / greatest(a.value, b.value) * 100, 1) AS difference_pct FROM req a JOIN req b ON a.param = b.param AND a.society < b.society AND abs(a.value - b.value) >= 0.001)"


@query("SELECT * FROM con", req=_REQ, con=_CON)
def g10_conflicts(t):
    return rs.conflicts(_values(t))


@query("SELECT CASE WHEN count(*) = 0 THEN 'no conflicts found' ELSE string_agg(concat(param, ': ', society_a, ' and ', society_b, ' differ'), chr(10) ORDER BY param, society_a, society_b) END AS finding, CASE WHEN count(*) = 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM (SELECT * FROM con ORDER BY param, society_a, society_b LIMIT 5)", req=_REQ, con=_CON)
def g11_findings(t):
    return rs.findings(rs.conflicts(_values(t)))


