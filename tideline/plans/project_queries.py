"""Project analytics over customers (projects), orders and line items (their children)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.operators import projects as pj
from tideline.plans.registry import query
from tideline.plans.stored_queries import ALL, BM25_VIEWS, BM25_WORDS, stored_index


def _projects(t):
    return t.customer.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), "c_nationkey")


def _orders(t):
    return t.orders.withColumnRenamed("o_custkey", "project_id")


@query("""SELECT c_custkey AS project_id, coalesce(o.n, 0) AS n_orders, coalesce(v.n, 0) AS n_clauses, CAST(coalesce(v.k, 0) AS BIGINT) AS n_verified, CASE WHEN coalesce(v.n, 0) > 0 THEN round(v.k * 100.0::DOUBLE / v.n, 1) ELSE 0.0::DOUBLE END AS pct_verified FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS k FROM orders GROUP BY o_custkey) v ON v.o_custkey = c_custkey""")
def h1_dashboard(t):
    clauses = _orders(t).select("project_id", F.when(F.col("o_orderstatus") == "F", "verified").otherwise("open").alias("status"))
    return pj.dashboard(_projects(t), {"orders": _orders(t)}, clauses)


_PRIO = "CASE WHEN o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '%URGENT' THEN 'high' WHEN o_orderpriority LIKE '%MEDIUM' THEN 'medium' ELSE 'low' END"


@query(f"SELECT issue_id, priority FROM (SELECT o_orderkey AS issue_id, {_PRIO} AS priority, o_orderdate FROM orders) ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderdate DESC, issue_id LIMIT 50")
def h2_issues(t):
    rows = t.orders.select(F.col("o_orderkey").alias("issue_id"), F.expr(_PRIO).alias("priority"), "o_orderdate")
    return pj.issues(rows, "o_orderdate", 50).select("issue_id", "priority")


_VESSEL = "CASE o_orderkey % 3 WHEN 0 THEN 'tanker' WHEN 1 THEN 'container' ELSE 'none' END"


@query(f"""SELECT concat(project_id, '-', lpad(CAST(i - 1 AS VARCHAR), 3, '0')) AS clause_id, project_id, l[i] AS clause, 'unverified' AS status FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT concat('p', o_orderkey) AS project_id, CASE WHEN o_orderkey % 5 = 0 THEN [o_orderpriority, 'X'] WHEN {_VESSEL} = 'tanker' THEN {lx.TEMPLATES['tanker_dnv']} WHEN {_VESSEL} = 'container' THEN {lx.TEMPLATES['container_dnv']} END AS l FROM orders)) WHERE concat(project_id, '-', lpad(CAST(i - 1 AS VARCHAR), 3, '0')) NOT IN (SELECT concat('p', o_orderkey, '-000') FROM orders WHERE o_orderkey % 4 = 0)""")
def h3_compliance_rows(t):
    pid = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    given = F.when(F.col("o_orderkey") % 5 == 0, F.array("o_orderpriority", F.lit("X"))).otherwise(F.array().cast("array<string>"))
    projects = t.orders.select(pid.alias("project_id"), F.expr(_VESSEL).alias("vessel"), F.lit("DNV").alias("society"), given.alias("regulations"))
    existing = t.orders.filter("o_orderkey % 4 = 0").select(F.concat(pid, F.lit("-000")).alias("clause_id"))
    return pj.compliance_rows(projects, existing)


def _clauses(t):
    """Line items as clauses of their order, with no conclusions yet."""
    cid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    status = F.when(F.col("l_returnflag") == "A", "verified").otherwise("unverified")
    rows = t.lineitem.select(F.col("l_orderkey").alias("project_id"), cid.alias("clause_id"), F.concat(F.lit("clause "), F.col("l_linenumber").cast("string")).alias("clause"), status.alias("status"))
    return rows.dropDuplicates(["clause_id"]).withColumn("conclusions", F.array().cast("array<string>"))


# Three in four citations name a clause, the others (in capitals or not) the beginning of an id.
_REF = "CASE WHEN o_orderkey % 4 = 0 THEN concat(CAST(o_orderkey AS STRING), '-2-') ELSE concat('clause ', CAST(o_orderkey % 3 + 1 AS STRING)) END"


def _cited(t):
    return t.orders.select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("conclusion_id"), F.expr(_REF).alias("clause"))


_CL = "SELECT project_id, clause_id, any_value(clause) AS clause, min(status) AS status FROM (SELECT l_orderkey AS project_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS clause_id, concat('clause ', l_linenumber) AS clause, CASE WHEN l_returnflag = 'A' THEN 'verified' ELSE 'unverified' END AS status FROM lineitem) GROUP BY project_id, clause_id"
_UP = "SELECT c.clause_id, CASE WHEN n.k IS NOT NULL AND status <> 'verified' THEN 'needs_review' ELSE status END AS status, CASE WHEN status = 'verified' THEN '' ELSE coalesce(n.k, '') END AS conclusions FROM cl c LEFT JOIN (SELECT clause_id, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT min(clause_id) AS clause_id, concat('k', o_orderkey) AS k FROM cl JOIN (SELECT o_orderkey, " + _REF + " AS ref FROM orders) o ON project_id = o_orderkey AND (clause = ref OR contains(lower(clause_id), lower(substr(ref, 1, 20)))) GROUP BY o_orderkey) GROUP BY clause_id) n USING (clause_id)"


def _updated(t):
    return pj.compliance_from_citations(_clauses(t), _cited(t))


@query("SELECT * FROM up", cl=_CL, up=_UP)
def h4_compliance_update(t):
    return _updated(t).select("clause_id", "status", F.array_join("conclusions", ",").alias("conclusions"))


@query("""SELECT clause_id, CASE WHEN conclusions <> '' AND len(kept) = 0 AND status NOT IN ('verified', 'not_applicable') THEN 'unverified' ELSE status END AS status, array_to_string(kept, ',') AS conclusions
FROM (SELECT *, list_filter(string_split(conclusions, ','), lambda c: c <> '' AND coalesce(TRY_CAST(substr(c, 2) AS BIGINT), 2) % 3 <> 2) AS kept FROM up)""", cl=_CL, up=_UP)
def h5_compliance_rollback(t):
    """The conclusions of every third order are deleted."""
    deleted = t.orders.filter("o_orderkey % 3 = 2").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("conclusion_id"))
    return pj.rolled_back(_updated(t), deleted).select("clause_id", "status", F.array_join("conclusions", ",").alias("conclusions"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND contains(lower(text), 'tion') ORDER BY doc_id LIMIT 10")
def h6_document_search(t):
    docs = t.documents.withColumn("status", F.when(F.col("doc_id") % 2 == 0, "done").otherwise("new"))
    return pj.document_search(docs, "TION").select("doc_id")


_TOPIC = "SELECT source AS query_id, arg_min(text, doc_id) AS text FROM documents WHERE source IS NOT NULL GROUP BY source"


@query("""SELECT query_id, doc_id, score, source FROM mine UNION ALL SELECT query_id, chunk_id, round(0.5 + 0.4 * score / (score + 100.0::DOUBLE), 6), 'global' FROM (
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored WHERE source <> query_id) WHERE r <= 20
AND query_id NOT IN (SELECT query_id FROM mine WHERE score > 0.7 GROUP BY query_id HAVING count(*) >= 5)""",
       mine="SELECT source AS query_id, doc_id, CASE WHEN contains(substr(text, 1, 500), 'tionthe') OR contains(substr(text, 1, 500), 'enther') THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS score, 'project' AS source FROM documents WHERE source IS NOT NULL",
       held=ALL, topic=_TOPIC, **(BM25_VIEWS | {"asked_terms": f"SELECT DISTINCT query_id, CAST(NULL AS VARCHAR) AS asked, unnest({BM25_WORDS.format('text')}) AS term FROM topic"}))
def h7_scoped_search(t):
    """A source's own documents; the global hits are the best 20 documents of other sources by BM25 for the text of its first one."""
    docs = t.documents.filter("source is not null")
    topics = docs.groupBy(F.col("source").alias("query_id")).agg(F.min_by("text", "doc_id").alias("text"))
    queries = topics.select("query_id", F.array(F.lit("tionthe"), F.lit("enther")).alias("regulations"))
    hits = stored_index(t).search(topics.withColumn("own", F.col("query_id")), where=F.col("source") != F.col("own"))
    shared = hits.select("query_id", F.col("chunk_id").alias("doc_id"), (F.col("score") / (F.col("score") + 100.0)).alias("score"))
    return pj.scoped_search(queries, docs.select(F.col("source").alias("query_id"), "doc_id", "text"), shared)


@query("SELECT p_partkey, round(CASE WHEN contains(p_type, 'STEEL') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'brand#1') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(p_name), '1') THEN 0.3 WHEN contains(lower(p_type), '1') THEN 0.2 ELSE 0 END + CASE WHEN p_size < 18 THEN 0.1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END, 2)::DOUBLE AS score FROM part")
def h8_case_search(t):
    as_of = F.lit("2024-01-01").cast("date")
    score = pj.case_score(F.col("p_name"), F.col("p_type"), F.col("p_type"), F.col("p_brand"), F.date_sub(as_of, F.col("p_size") * 10), F.col("p_partkey") % 2 == 0, {"vessel": "STEEL", "society": "brand#1", "query": "1"}, as_of)
    return t.part.select("p_partkey", score.alias("score"))


# An order leads to a later one, unless its key ends a run; the proposals lead back.
_LINKS = "SELECT o_orderkey AS src, o_orderkey + 1 + o_orderkey % 3 AS dst FROM {orders} WHERE o_orderkey % 8 < 5"
_PROPOSED = "SELECT o_orderkey + 2 AS src, o_orderkey AS dst FROM {orders} UNION SELECT o_orderkey + 9, o_orderkey FROM {orders}"


@query("SELECT p.src, p.dst, count(w.src) > 0 AS circular FROM pr p LEFT JOIN (SELECT DISTINCT src, dst FROM walk WHERE here = src OR d = 5) w ON w.src = p.src AND w.dst = p.dst GROUP BY p.src, p.dst",
       lk="SELECT DISTINCT src, dst FROM (" + _LINKS.replace("{orders}", "orders") + ")", pr=_PROPOSED.replace("{orders}", "orders"), walk="SELECT src, dst, dst AS here, 0 AS d FROM pr UNION SELECT w.src, w.dst, l.dst, w.d + 1 FROM walk w JOIN lk l ON l.src = w.here WHERE w.here <> w.src AND w.d < 5")
def h9_cycles(t):
    return pj.circular(t.sql(_LINKS), t.sql(_PROPOSED))


# Three links from each order of the lower half of a run.
_BRANCHES = "SELECT o_orderkey AS src, o_orderkey + 1 + j.col AS dst FROM {orders} CROSS JOIN (VALUES (0), (1), (2)) AS j(col) WHERE o_orderkey % 8 < 3"


@query("SELECT p.src, p.dst, count(w.src) > 0 AS circular FROM pr p LEFT JOIN (SELECT DISTINCT src, dst FROM walk WHERE here = src OR d = 5) w ON w.src = p.src AND w.dst = p.dst GROUP BY p.src, p.dst",
       lk="SELECT DISTINCT src, dst FROM (" + _BRANCHES.replace("{orders}", "orders") + ")", pr=_PROPOSED.replace("{orders}", "orders"), walk="SELECT src, dst, dst AS here, 0 AS d FROM pr UNION SELECT w.src, w.dst, l.dst, w.d + 1 FROM walk w JOIN lk l ON l.src = w.here WHERE w.here <> w.src AND w.d < 5")
def h9_branching(t):
    return pj.circular(t.sql(_BRANCHES), t.sql(_PROPOSED))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id % 5, conv_id % 2 ORDER BY conv_id) + coalesce(last, -1) AS INTEGER) AS order_index FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0) LEFT JOIN (SELECT conv_id % 5 AS p, conv_id % 2 AS f, max(turn) AS last FROM conversations WHERE conv_id % 3 = 1 GROUP BY 1, 2) l ON l.p = conv_id % 5 AND l.f = conv_id % 2")
def h10_folder_order(t):
    place = [(F.col("conv_id") % 5).alias("project_id"), (F.col("conv_id") % 2).alias("folder")]
    existing = t.conversations.filter("conv_id % 3 = 1").select(*place, F.col("turn").alias("order_index"))
    new = t.conversations.filter("conv_id % 3 = 0").select(*place, "conv_id").distinct()
    return pj.folder_order(existing, new).select("conv_id", F.col("order_index").cast("int").alias("order_index"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_children FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def h11_project_list(t):
    return pj.listed(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_acctbal", 100).select("c_custkey", "n_children")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 4 = 0 THEN concat('bad ', props) END AS text FROM events")
def h12_json_columns(t):
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("bad "), F.col("props"))).otherwise(F.col("props"))
    return t.events.select("event_id", pj.decoded(raw, "k bigint").alias("d")).select("event_id", "d.value.k", "d.text")


@query("""SELECT event_id, (user_id % 50 = user_id % 10) OR (action <> 'admin' AND coalesce(CASE role WHEN 'viewer' THEN action IN ('read', 'comment') WHEN 'editor' THEN action IN ('read', 'comment', 'write') END, false)) AS allowed FROM (
SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'comment' WHEN 2 THEN 'write' ELSE 'admin' END AS action, CASE user_id % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' END AS role FROM events)""")
def h13_permissions(t):
    action = F.expr("CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'comment' WHEN 2 THEN 'write' ELSE 'admin' END")
    role = F.expr("CASE user_id % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' END")
    team = F.array(F.struct(F.lit(-1).cast("long").alias("user"), F.lit("owner").alias("role")), F.struct(F.col("user_id").alias("user"), role.alias("role")))
    allowed = pj.permitted(F.col("user_id") % 50, F.col("user_id") % 10, F.transform(team, lambda m: F.struct((m["user"] % 50).alias("user"), m["role"].alias("role"))), action)
    return t.events.select("event_id", allowed.alias("allowed"))


@query("SELECT u AS user, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY turn DESC, comment_id DESC) AS r FROM (SELECT DISTINCT unnest([conv_id % 7, turn % 7]) AS u, concat(conv_id, '/', turn) AS comment_id, turn FROM conversations)) WHERE r <= 50")
def h14_notifications(t):
    rows = t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"), F.col("turn").alias("at"), F.array(F.col("conv_id") % 7, F.col("turn") % 7).alias("mentions"))
    return pj.notifications(rows)


@query("SELECT 'projects' AS name, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 4 <> 0")
def h15_cascade(t):
    left = pj.without_projects({"projects": _projects(t).select("project_id"), "orders": _orders(t).select("project_id")}, _projects(t).filter("project_id % 4 = 0"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey FROM customer")
def h15_patch(t):
    changes = t.customer.filter("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "renamed").alias("c_name"), F.lit(99).alias("c_nationkey"))
    return pj.patched(t.customer.select("c_custkey", "c_name", "c_nationkey"), changes, "c_custkey", ["c_name"])
