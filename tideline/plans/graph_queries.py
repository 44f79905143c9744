"""Entities, relations and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.operators import graph as gr
from tideline.plans.registry import GRAPH_EDGES, GRAPH_NODES, query


def _sq(p):
    return p.replace("'", "''")


@query(f"SELECT DISTINCT chunk_id, unnest(regexp_extract_all(text, '{lx.STEEL_GRADE}')) AS name FROM corpus")
def e1_steel_grades(t):
    return t.corpus.select("chunk_id", F.explode(gr.steel_grades(F.col("text"))).alias("name"))


# Start, end and text of every match, by the pieces between matches.
def _spans_sql(source, pattern, kind):
    p = _sq(pattern)
    return f"SELECT doc_id, '{kind}' AS etype, CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, h[i] AS m FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS h, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i FROM {source})"


_CL = " UNION ALL ".join(_spans_sql("corpus", p, "regulation_clause") for p in lx.CLAUSES)
_NEG = " UNION ALL ".join(_spans_sql("corpus", p, "x") for p in lx.NEGATIONS)
_CLAUSES = {
    "cl": _CL, "clo": "SELECT doc_id, s, s + length(m) AS e, m, row_number() OVER (PARTITION BY doc_id ORDER BY s, s + length(m) DESC, m) AS i FROM cl",
    "keep": "SELECT doc_id, i, s, e, m, e AS last, true AS k FROM clo WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, x.s, x.e, x.m, greatest(f.last, x.e), x.e > f.last FROM keep f JOIN clo x ON x.doc_id = f.doc_id AND x.i = f.i + 1",
}
_SHIPS = ", ".join(f"({i}, '{w}', '{n}')" for i, (w, n) in enumerate(lx.SHIP_TYPES.items()))
_ALL = {
    **_CLAUSES, "neg": f"SELECT doc_id, s, s + length(m) AS e FROM ({_NEG})",
    "raw": " UNION ALL ".join([
        f"SELECT doc_id, etype, s, m FROM ({_spans_sql('corpus', lx.STEEL_GRADE, 'steel_grade')})", "SELECT doc_id, 'regulation_clause', s, m FROM keep WHERE k",
        f"SELECT doc_id, etype, s, m FROM ({_spans_sql('corpus', lx.EQUIPMENT, 'equipment')})", *(f"SELECT doc_id, etype, s, m FROM ({_spans_sql('corpus', p, 'parameter')})" for p in lx.PARAMETERS),
        f"SELECT doc_id, 'ship_type', instr(lower(text), w) - 1, n FROM corpus JOIN (VALUES {_SHIPS}) v(i, w, n) ON contains(lower(text), w)"]),
    "ent": "SELECT DISTINCT md5(concat(trim(m), ':', etype)) AS entity_id, trim(m) AS name, etype, doc_id FROM raw r WHERE NOT EXISTS (SELECT 1 FROM neg n WHERE n.doc_id = r.doc_id AND r.s < n.e AND r.s + length(r.m) > n.s)",
}


@query("SELECT DISTINCT doc_id, m AS name FROM keep WHERE k", **_CLAUSES)
def e2_clauses(t):
    return t.corpus.select("doc_id", F.explode(F.array_distinct(F.transform(gr.clause_spans(F.col("text")), lambda x: x["m"]))).alias("name"))


@query(f"SELECT DISTINCT p_partkey, unnest(regexp_extract_all(concat('Fit Type-', split_part(p_type, ' ', 1), ' or model: X', CAST(p_size AS VARCHAR)), '{_sq(lx.EQUIPMENT)}')) AS name FROM part")
def e3_equipment(t):
    text = F.concat(F.lit("Fit Type-"), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(" or model: X"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.explode(gr.equipment(text)).alias("name"))


@query(r"SELECT DISTINCT doc_id, trim(unnest(list_concat(list_concat(regexp_extract_all(text, '\b[0-9]{2,4}\s*(?:°\s*)?[CF]\b'), regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?\s*mm\b')), regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?\s*MPa\b')))) AS name FROM corpus")
def e4_parameters(t):
    return t.corpus.select("doc_id", F.explode(gr.parameters(F.col("text"))).alias("name"))


@query(f"SELECT DISTINCT doc_id, n AS name FROM corpus JOIN (VALUES {_SHIPS}) v(i, w, n) ON contains(lower(text), w)")
def e5_ship_types(t):
    return t.corpus.select("doc_id", F.explode(gr.ship_types(F.col("text"))).alias("name"))


@query("SELECT doc_id, count(*) AS n FROM raw r WHERE etype = 'steel_grade' AND NOT EXISTS (SELECT 1 FROM neg n WHERE n.doc_id = r.doc_id AND r.s < n.e AND r.s + length(r.m) > n.s) GROUP BY doc_id", **_ALL)
def e6_negation(t):
    kept = gr.not_negated(F.col("text"), gr.spans(F.col("text"), [lx.STEEL_GRADE]))
    return t.corpus.select("doc_id", F.size(kept).cast("long").alias("n")).filter("n > 0")


@query("SELECT * FROM ent", **_ALL)
def e7_entities(t):
    return gr.extract_entities(t.corpus)


_ALL2 = {"corpus2": "SELECT doc_id, concat(text, ' See Ch.9 and Section 4.2 too.') AS text FROM corpus"} | {k: v.replace("FROM corpus", "FROM corpus2") for k, v in _ALL.items()}


@query("SELECT a.doc_id, a.entity_id AS src, b.entity_id AS dst, 'references' AS rtype, 1.0::DOUBLE AS confidence FROM ent a JOIN ent b ON a.doc_id = b.doc_id AND a.name < b.name WHERE a.etype = 'regulation_clause' AND b.etype = 'regulation_clause'", **_ALL2)
def e8_clause_references(t):
    return gr.clause_references(gr.cut(gr.extract_entities(t.corpus.withColumn("text", F.concat("text", F.lit(" See Ch.9 and Section 4.2 too."))), ("regulation_clause",))))


@query("SELECT p.doc_id, p.entity_id AS src, o.entity_id AS dst, 'constrains' AS rtype, 1.0::DOUBLE AS confidence FROM ent p JOIN ent o ON p.doc_id = o.doc_id AND o.etype IN ('steel_grade', 'equipment', 'ship_type') WHERE p.etype = 'parameter'", **_ALL)
def e9_constraints(t):
    return gr.constraints(gr.cut(gr.extract_entities(t.corpus, ("parameter", "steel_grade", "equipment", "ship_type"))))


@query("SELECT src, dst, md5(concat(src, ':', dst, ':', rtype)) AS relation_id FROM edges")
def e10_ids(t):
    e = t.sql(GRAPH_EDGES)
    return e.select("src", "dst", gr.relation_id(F.col("src"), F.col("dst"), F.col("rtype")).alias("relation_id"))


_EXTRACTS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS etype, 0 AS priority, p_partkey AS seq FROM {part} UNION ALL SELECT p_name, p_brand, 1, p_partkey FROM {part} WHERE p_partkey % 3 = 0"


@query("SELECT name, etype, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), etype ORDER BY priority DESC, seq DESC) AS r FROM x) WHERE r = 1", x=_EXTRACTS.replace("{part}", "part"))
def e11_merge_entities(t):
    return gr.merge_entities(t.sql(_EXTRACTS))


_RELS = "SELECT src, dst, rtype, 0 AS priority, 0 AS seq FROM {edges} UNION ALL SELECT src, dst, rtype, 1, 1 FROM {edges} WHERE rtype <> 'located_in'"


@query("SELECT src, dst, rtype, priority, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rtype ORDER BY priority DESC, seq DESC) AS r FROM x) WHERE r = 1", x=_RELS.replace("{edges}", "edges"))
def e12_merge_relations(t):
    return gr.merge_relations(t.sql(_RELS, edges=t.sql(GRAPH_EDGES)))


@query("SELECT e.doc_id, entity_id, CASE WHEN etype IN ('regulation_clause', 'equipment') THEN concat(society, '-', name) ELSE name END AS name FROM ent e JOIN corpus c ON c.doc_id = e.doc_id", **_ALL)
def e13_disambiguation(t):
    j = gr.extract_entities(t.corpus).join(t.corpus.select("doc_id", "society"), "doc_id")
    return j.select("doc_id", "entity_id", gr.disambiguated(F.col("name"), F.col("etype"), F.col("society")).alias("name"))


@query("SELECT e.doc_id, entity_id, CASE WHEN etype IN ('regulation_clause', 'equipment') THEN name END AS original, 'rules' AS origin FROM ent e JOIN corpus c ON c.doc_id = e.doc_id", **_ALL)
def e13_original_names(t):
    j = gr.extract_entities(t.corpus).join(t.corpus.select("doc_id", "society"), "doc_id")
    held = gr.with_original(F.create_map(F.lit("origin"), F.lit("rules")), F.col("name"), F.col("etype"), F.col("society"))
    return j.select("doc_id", "entity_id", held["original_name"].alias("original"), held["origin"].alias("origin"))


_RAW = "SELECT event_id AS output_id, user_id, CASE event_id % 3 WHEN 0 THEN concat('{\"entities\":[{\"name\":\"u', CAST(user_id AS STRING), '\",\"type\":\"user\"}]}') WHEN 1 THEN concat('Here: {\"entities\":[{\"id\":\"e', CAST(user_id AS STRING), '\",\"name\":\"', event_type, '\"}]} done') ELSE 'nothing' END AS raw FROM {events}"


@query("""SELECT output_id, entity_id, name, etype, 0.9::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY output_id) AS r FROM (
SELECT event_id AS output_id, md5(concat('u', user_id, ':user')) AS entity_id, concat('u', user_id) AS name, 'user' AS etype FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, concat('e', user_id), event_type, 'unknown' FROM events WHERE event_id % 3 = 1)) WHERE r = 1""")
def e14_model_outputs(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string('{"entities":[{"name":"u%d","type":"user"}]}', "user_id")).when(F.col("event_id") % 3 == 1, F.format_string('Here: {"entities":[{"id":"e%d","name":"%s"}]} done', "user_id", "event_type")).otherwise("nothing")
    return gr.parse_entities(t.events.select(F.col("event_id").alias("output_id"), raw.alias("raw"))).drop("properties")


def _outputs(t):
    """Outputs with prose, fences, braces and quotes in strings, dangling relations and cut-off objects."""
    uid, kind = F.col("user_id").cast("string"), F.col("event_type")
    body = F.concat(
        F.lit('{"entities":[{"id":"u'), uid, F.lit('","name":"user } \\" {","type":"user","properties":{"a":{"b":'), uid, F.lit('}}},{"name":"'), kind,
        F.lit('","type":"act"}],"relations":[{"source":"u'), uid, F.lit('","target":"u'), uid, F.lit('","type":"is"},{"source":"u'), uid, F.lit('","target":"gone"}]}'),
    )
    m = F.col("event_id") % 4
    raw = F.when(m == 0, body).when(m == 1, F.concat(F.lit("Result: "), body, F.lit(" and {more}"))).when(m == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit('{"entities":['))
    return t.events.select(F.col("event_id").alias("output_id"), raw.alias("raw"))


@query("""SELECT output_id, entity_id, name, etype, properties FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY output_id) AS r FROM (
SELECT event_id AS output_id, concat('u', user_id) AS entity_id, 'user } " {' AS name, 'user' AS etype, concat('{"a":{"b":', user_id, '}}') AS properties FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, md5(concat(event_type, ':act')), event_type, 'act', '{}' FROM events WHERE event_id % 4 <> 3)) WHERE r = 1""")
def e14_output_entities(t):
    return gr.parse_entities(_outputs(t)).drop("confidence")


@query("""SELECT min(event_id) AS output_id, md5(concat('u', user_id, ':u', user_id, ':is')) AS relation_id, concat('u', user_id) AS src, concat('u', user_id) AS dst, 'is' AS rtype, 0.9::DOUBLE AS confidence
FROM events WHERE event_id % 4 <> 3 GROUP BY user_id""")
def e14_output_relations(t):
    return gr.parse_relations(_outputs(t)).drop("properties")


@query("SELECT src, dst, rtype FROM edges WHERE src IN (SELECT entity_id FROM nodes WHERE etype <> 'region') AND dst IN (SELECT entity_id FROM nodes WHERE etype <> 'region')")
def e15_dangling(t):
    return gr.without_dangling(t.sql(GRAPH_EDGES), t.sql(GRAPH_NODES).filter("etype <> 'region'")).select("src", "dst", "rtype")


_LOADS = "SELECT entity_id, name, etype, substr(entity_id, 2, 1) AS society, CAST(1 AS BIGINT) AS doc_id, concat('first ', name) AS properties, 1 AS load_no FROM {nodes} UNION ALL SELECT entity_id, upper(name), etype, 'other', CAST(2 AS BIGINT), concat('second ', name), 2 FROM {nodes} WHERE etype = 'part'"


def _stored(t):
    return gr.upsert_entities(t.sql(_LOADS, nodes=t.sql(GRAPH_NODES)))


_ST = {"ld": _LOADS.replace("{nodes}", "nodes"), "st": "SELECT entity_id, arg_min(name, load_no) AS name, arg_min(etype, load_no) AS etype, arg_min(society, load_no) AS society, count(*) AS ref_count, arg_max(doc_id, load_no) AS doc_id, arg_max(properties, load_no) AS properties FROM ld GROUP BY entity_id"}


@query("SELECT * FROM st", **_ST)
def e16_upsert(t):
    return _stored(t)


@query("SELECT doc_id, count(*) AS n FROM (SELECT p.doc_id, p.entity_id AS src, o.entity_id AS dst FROM ent p JOIN ent o ON p.doc_id = o.doc_id AND o.etype = 'ship_type' WHERE p.etype = 'parameter') x WHERE dst IN (SELECT entity_id FROM ent WHERE name <> 'FPSO') GROUP BY doc_id", **_ALL)
def e17_relation_insert(t):
    e = gr.cut(gr.extract_entities(t.corpus))
    new = gr.constraints(e.filter("etype in ('parameter', 'ship_type')"))
    return gr.without_dangling(new, e.filter("name <> 'FPSO'")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT entity_id, CASE WHEN doc_id = 2 THEN ref_count - 1 ELSE ref_count END AS ref_count FROM st WHERE NOT (doc_id = 2 AND ref_count <= 1)", **_ST)
def e18_delete_document(t):
    return gr.delete_document(_stored(t), t.sql(GRAPH_EDGES), 2)[0].select("entity_id", "ref_count")


@query("SELECT count(*) AS n FROM st WHERE doc_id = 2", **_ST)
def e18_matched(t):
    return gr.matched_by(_stored(t), 2)


@query("SELECT src, dst, rtype FROM edges e WHERE NOT EXISTS (SELECT 1 FROM st WHERE doc_id = 2 AND (entity_id = e.src OR entity_id = e.dst))", **_ST)
def e18_delete_edges(t):
    return gr.delete_document(_stored(t), t.sql(GRAPH_EDGES), 2)[1].select("src", "dst", "rtype")


@query("SELECT entity_id, name, etype FROM (SELECT * FROM nodes WHERE contains(name, '0') ORDER BY entity_id LIMIT 200) WHERE etype <> 'region'")
def e19_lookup(t):
    return gr.lookup(t.sql(GRAPH_NODES), "0", ["part", "supplier", "customer", "nation"], 200)


@query("SELECT entity_id, name, etype FROM st WHERE society = '1' AND entity_id IN (SELECT dst FROM edges WHERE rtype <> 'part_of') AND etype IN ('supplier', 'nation')", **_ST)
def e19_lookup_by_ids(t):
    ids = t.sql(GRAPH_EDGES).filter("rtype <> 'part_of'").select(F.col("dst").alias("entity_id"))
    return gr.lookup(_stored(t), kinds=["supplier", "nation"], society="1", ids=ids).select("entity_id", "name", "etype")


@query("SELECT src, dst, rtype FROM edges WHERE rtype IN ('located_in', 'part_of') AND src IN (SELECT entity_id FROM nodes WHERE etype = 'supplier')")
def e20_out_edges(t):
    return gr.out_edges(t.sql(GRAPH_EDGES), t.sql(GRAPH_NODES).filter("etype = 'supplier'"), ["located_in", "part_of"]).select("src", "dst", "rtype")


_WALK = "SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS entity_id, 0 AS hop FROM part WHERE p_partkey % 100 = 0 UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.entity_id WHERE w.hop < 3"


@query("SELECT entity_id, min(hop) AS hop FROM walk GROUP BY entity_id", walk=_WALK)
def e21_traversal(t):
    seeds = t.part.filter("p_partkey % 100 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return gr.traverse(t.sql(GRAPH_EDGES), seeds, 3)[0]


@query("SELECT DISTINCT e.src, e.dst, e.rtype FROM walk w JOIN edges e ON e.src = w.entity_id WHERE w.hop < 2", walk="SELECT * FROM (SELECT entity_id, 0 AS hop FROM nodes WHERE contains(name, 'NATION_1') ORDER BY entity_id LIMIT 1000) UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.entity_id WHERE w.hop < 2")
def e22_topic_graph(t):
    return gr.topic_graph(t.sql(GRAPH_NODES), t.sql(GRAPH_EDGES), "NATION_1", 2, 1000)[1].select("src", "dst", "rtype")


# A part is like the next one; every fiftieth is asked for twice.
_MAPS = "SELECT concat('p', CAST(p_partkey AS STRING)) AS src, concat('p', CAST(p_partkey + 1 AS STRING)) AS dst, 'similar_to' AS rtype, CAST((p_partkey * 7) % 10 AS DOUBLE) / 10.0 AS confidence FROM {part}"


def _mapped(t):
    edges = t.sql(_MAPS)
    clauses = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5).cast("string").alias("society"))
    asked = t.part.filter("p_partkey % 50 in (3, 7)").select(F.lower("p_name").alias("clause"), (F.col("p_partkey") % 5).cast("string").alias("society"), ((F.col("p_partkey") + 1) % 5).cast("string").alias("target"))
    return edges, gr.cross_references(clauses, edges, asked)


_XR = {
    "mp": _MAPS.replace("{part}", "part").replace("/ 10.0", "/ 10.0::DOUBLE"), "cls": "SELECT concat('p', p_partkey) AS entity_id, p_name AS name, CAST(p_partkey % 5 AS VARCHAR) AS society FROM part",
    "asked": "SELECT lower(p_name) AS clause, CAST(p_partkey % 5 AS VARCHAR) AS society, CAST((p_partkey + 1) % 5 AS VARCHAR) AS target FROM part WHERE p_partkey % 50 IN (3, 7)",
    "xr": "SELECT clause, society, target, src, dst, found, confidence FROM (SELECT a.*, m.src, m.dst, d.name AS found, m.confidence, row_number() OVER (PARTITION BY a.clause, a.society, a.target ORDER BY m.confidence DESC, m.src, m.dst) AS r FROM (SELECT DISTINCT * FROM asked) a JOIN cls s ON s.society = a.society AND contains(lower(s.name), a.clause) JOIN mp m ON m.src = s.entity_id JOIN cls d ON d.entity_id = m.dst AND d.society = a.target) WHERE r = 1 AND confidence > 0.8",
}


@query("SELECT * FROM xr", **_XR)
def e23_cross_references(t):
    return _mapped(t)[1]


@query("SELECT src, dst, rtype, confidence FROM mp UNION ALL SELECT src, dst, 'similar_to', confidence FROM xr", **_XR)
def e24_write_back(t):
    edges, found = _mapped(t)
    keyed = edges.withColumn("relation_id", gr.relation_id(F.col("src"), F.col("dst"), F.col("rtype")))
    return gr.write_back(keyed, found).select("src", "dst", "rtype", "confidence")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS relations, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS chars, (SELECT round(avg(value), 6) FROM events) AS avg_latency")
def e25_statistics(t):
    """One row of totals: each a single-row aggregate, put side by side by their key."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("one", F.lit(1))
    parts = [
        one(t.documents, F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), one(t.sql(GRAPH_NODES), F.count("*").alias("entities")), one(t.sql(GRAPH_EDGES), F.count("*").alias("relations")),
        one(t.conversations, F.countDistinct("conv_id").alias("conversations")), one(t.events, F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("avg_latency")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "one")
    return out.drop("one")
