"""Operators on small inputs with results worked out by hand, and those that SQL can't hold."""

import random

from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.operators import context as cx
from tideline.operators import graph as gr
from tideline.operators import projects as pj
from tideline.operators import research as rs
from tideline.operators import retrieval as rt
from tideline.operators import tables as tb
from tideline.plans.flagship import quoting
from tideline.sources import documents as sd

SF = "/root/testdata/sf0.01"


def test_approximate_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r["query_id"], r["chunk_id"]) for r in rt.dense_top_k(q, e, 10).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in rt.approximate_top_k(q, e, 10, sample=300).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def brute_chunks(text, cap):
    """Units (line or cut of one, and the table header it needs), then greedy packing."""
    units, rows, header = [], 0, ""
    for line in (x for x in text.split("\n") if x.strip(" ")):
        rows = rows + 1 if line.lstrip(" ").startswith("|") else 0
        header = "" if not rows else line if rows == 1 else f"{header}\n{line}" if rows == 2 else header
        own = header if rows > 2 and len(header) <= cap * 2 else ""
        room = max(1, 4 * cap - (len(own) + 1 if own else 0))
        units += [(line[i : i + room], own) for i in range(0, len(line), room)]
    out = []
    for piece, own in units:
        if out and max(1, len(f"{out[-1]}\n{piece}") // 4) <= cap:
            out[-1] = f"{out[-1]}\n{piece}"
        else:
            out.append(f"{own}\n{piece}" if own else piece)
    return out


def test_chunks_equal_brute_force(spark):
    rng = random.Random(5)
    row = lambda: "| " + " | ".join("x" * rng.randint(1, 30) for _ in range(3)) + " |"
    line = lambda: rng.choice(["", " ", "word " * rng.randint(1, 20), "y" * rng.randint(1, 900), "\n".join(row() for _ in range(rng.randint(1, 9)))])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["", "|a|\n|-|\n" + "|b|\n" * 300]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    got = {}
    for r in tb.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 50).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_tokens"] <= 50
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_chunks(t, 50), t
    assert all(x.startswith("|a|\n|-|") for x in got[81])
    alone = tb.chunks(spark.createDataFrame([(1, "a\nb")], "doc_id int, text string"), 50, merge_peers=False)
    assert alone.count() == 2


def test_parameters_begin_at_a_word(spark):
    texts = ["at 125 C, 40 °F and 12345 C; x12 mm, 7.5 mm, 3mm", "235 MPa and a355 MPa, 1.5.2 MPa", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(gr.parameters(F.col("t"))).collect()]
    assert got == [["125 C", "40 °F", "7.5 mm", "3mm"], ["235 MPa", "5.2 MPa"], None]


def test_citations_reach_clauses(spark):
    rows = [("p", "p-001", "Pt.1", "unverified", []), ("p", "p-002", "Pt.2", "verified", []), ("p", "DNV-Pt.3", "Pt.3 Ch.1", "unverified", ["old"]), ("q", "q-001", "Pt.1", "unverified", [])]
    clauses = spark.createDataFrame(rows, "project_id string, clause_id string, clause string, status string, conclusions array<string>")
    cited = spark.createDataFrame([("p", "k1", "Pt.1"), ("p", "k2", "Pt.2"), ("p", "k3", "dnv-pt.3"), ("p", "old", "Pt.3 Ch.1"), ("p", "k4", "Ch.1")], "project_id string, conclusion_id string, clause string")
    got = {r["clause_id"]: (r["status"], r["conclusions"]) for r in pj.compliance_from_citations(clauses, cited).collect()}
    assert got == {"p-001": ("needs_review", ["k1"]), "p-002": ("verified", []), "DNV-Pt.3": ("needs_review", ["old", "k3"]), "q-001": ("unverified", [])}


def test_context_sections(spark):
    packed = spark.createDataFrame([(1, "[Source a] text"), (3, "[Source b] more")], "query_id int, context string")
    facts = spark.createDataFrame([(1, i, f"fact {i}") for i in range(20)] + [(2, 0, "alone")], "query_id int, rank int, text string")
    entities = spark.createDataFrame([(1, i, f"e{i:02}", "ship") for i in range(30)], "query_id int, rank int, name string, etype string")
    relations = spark.createDataFrame([(q, i, "a", "of", f"b{i:02}") for i in range(12) for q in (1, 2)], "query_id int, rank int, src string, rtype string, dst string")
    got = {r["query_id"]: r["context"] for r in cx.context_sections(packed, facts, entities, relations).collect()}
    parts = got[1].split("\n\n")
    assert parts[0] == "## Key Facts\n" + "\n".join(f"- fact {i}" for i in range(15)) and parts[1] == "## Document Context\n[Source a] text"
    assert parts[2] == "## Knowledge Graph\n### Entities\n" + "\n".join(f"- e{i:02} (ship)" for i in range(20))
    assert parts[3] == "### Relations\n" + "\n".join(f"- a -> of -> b{i:02}" for i in range(10))
    assert got[2] == "## Key Facts\n- alone" and got[3] == "## Document Context\n[Source b] more"


def test_iterated_retrieval(spark):
    """Rounds against a loop over queries; scores come from a table."""
    scores = {("q1", ""): 0.2, ("q1", "x"): 0.6, ("q2", ""): 0.7, ("q3", ""): 0.3, ("q3", "x"): 0.1, ("q3", "xy"): 0.3}
    table = spark.createDataFrame([(q, len(e), s) for (q, e), s in scores.items()], "query_id string, n int, score double")
    queries = spark.createDataFrame([(q, "key") for q in ("q1", "q2", "q3", "q4")], "query_id string, text string")

    def retrieve(asked):
        return asked.select("query_id", (F.size(F.split("text", " ")) - 1).alias("n")).join(table, ["query_id", "n"]).select("query_id", "score")

    got = {r["query_id"]: (r["round"], r["score"]) for r in cx.iterated(queries, retrieve, {"key": ["x", "y", "z"]}).collect()}
    assert got == {"q1": (1, 0.6), "q2": (0, 0.7), "q3": (0, 0.3), "q4": (0, 0.0)}


def test_spans_equal_finditer(spark):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choices("ab1 §é字.", k=rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"[ab]\d*", r"§\s*1", "é+", r"\d"):
        for r in df.select("t", tx.match_spans(F.col("t"), p).alias("s")).collect():
            assert [(x["s"], x["e"], x["m"]) for x in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(p, r["t"])]


def test_sections(spark):
    df = spark.createDataFrame([("Pt.4 Ch.3 §2.1",), ("Pt.4 Ch.3",), ("Ch.3 §2.1",), ("Ch.3",), ("Pt.4",), (None,)], "s string")
    assert [r[0] for r in df.select(tx.strip_section(F.col("s"))).collect()] == ["Pt.4 Ch.3", "Pt.4", "Ch.3", None, None, None]
    assert df.select(tx.fallback_levels(F.col("s"), 4)).first()[0] == ["Pt.4 Ch.3 §2.1", "Pt.4 Ch.3", "Pt.4", None]


def test_fusion(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "c"), (1, 1, 1, "b"), (1, 1, 2, "d")]
    out = rt.reciprocal_ranks(spark.createDataFrame(rows, "query_id int, list_no int, rank int, chunk_id string")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["b", "a", "d", "c"]
    assert abs(out[0]["score"] - (1 / 62 + 1 / 61)) < 1e-9


def test_metric_edges(spark):
    ranks = spark.createDataFrame([("h", "x", 1), ("h", "a", 2), ("n", "x", 1)], "query_id string, chunk_id string, rank int")
    rel = spark.createDataFrame([("h", "a"), ("h", "b"), ("e", "a")], "query_id string, chunk_id string")
    m = {r["query_id"]: r for r in rt.metrics(ranks, rel).collect()}
    assert (m["h"]["recall"], m["h"]["mrr"]) == (0.5, 0.5)
    assert (m["n"]["recall"], m["n"]["mrr"], m["n"]["ndcg"]) == (1.0, 1.0, 1.0)
    assert (m["e"]["recall"], m["e"]["mrr"], m["e"]["ndcg"]) == (0.0, 0.0, 0.0)


def test_entities(spark):
    docs = spark.createDataFrame([(1, "DH36, EH40 and AH32 steel, excluding NV500 for tugs. See Pt.4 Ch.3 §2.1."), (2, "  ")], "doc_id int, text string")
    names = {(r["etype"], r["name"]) for r in gr.extract_entities(docs).collect()}
    assert {n for k, n in names if k == "steel_grade"} == {"DH36", "EH40", "AH32"}
    assert not {n for k, n in names if k == "ship_type"}
    assert {n.rstrip(".") for k, n in names if k == "regulation_clause"} == {"Pt.4 Ch.3", "Ch.3 §2.1", "§2.1"}  # the last ends later, with the full stop


def test_conflicts(spark):
    v = spark.createDataFrame([("strength", "ABS", 1.5), ("strength", "DNV", 1.67), ("t", "ABS", 1.0), ("t", "DNV", 1.0)], "param string, society string, value double")
    rows = rs.conflicts(v).collect()
    assert len(rows) == 1 and rows[0]["difference_pct"] == 10.2 and rows[0]["severity"] == "warning"


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "src string, dst string, rtype string")
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    seen, walked = gr.traverse(edges, seeds, 1)
    assert {r["entity_id"] for r in seen.collect()} == {"a", "b", "c"} and walked.count() == 2
    seen, walked = gr.traverse(edges, seeds, 9)
    assert {r["entity_id"]: r["hop"] for r in seen.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2} and walked.count() == 4


def test_packing_stops_at_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x" * 40), (1, 2, "b", "x" * 400), (1, 3, "c", "x")], "query_id int, rank int, citation string, text string")
    assert cx.packed_context(hits, 60).first()["n_used"] == 1


def test_stored_tables(spark, tmp_path):
    files = spark.createDataFrame([("a.PDF", b"%PDF-1.7"), ("b.docx", b"PK\x03\x04zz"), ("c.xyz", b"????"), ("d.md", None)], "path string, content binary")
    got = {r["path"]: (r["format"], r["success"]) for r in sd.with_status(files).collect()}
    assert got == {"a.PDF": ("pdf", True), "b.docx": ("docx", True), "c.xyz": (None, False), "d.md": ("markdown", False)}
    docs = spark.createDataFrame([("d1", "é"), ("", "x"), ("d2", None)], "doc_id string, payload string")
    assert sd.write_documents(docs, str(tmp_path / "j")).count() == 2
    assert [r["payload"] for r in spark.read.json(str(tmp_path / "j")).collect()] == ["é"]


def test_quoting(spark):
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("benchmark", "documents")}
    found = quoting(t["benchmark"].select(F.col("item_id").alias("query_id"), "text"), t["documents"].select(F.col("doc_id").alias("chunk_id"), "text"))
    assert found.select("query_id").distinct().count() >= 15


def test_admissions_jump_over_the_refused(spark):
    """Against one event after the other, with users over several batches and limits that change."""
    rng = random.Random(6)
    limits = {"a": 2, "b": 5}
    rows = [(rng.randint(0, 3), i, rng.choice(["a", "a", "b", "free"]), rng.randint(0, 2000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, tier string, s long").withColumn("ts", F.timestamp_seconds("s"))
    held, want = {}, {}
    for user, event, tier, s in sorted(rows, key=lambda r: (r[3], r[1])):
        if tier not in limits:
            want[event] = True
            continue
        last = [h for h in held.get(user, []) if h > s - 60]
        want[event] = len(last) < limits[tier]
        held[user] = last + [s] * want[event]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {r["event_id"]: r["admitted"] for r in cx.admitted_window(df, 60, limits).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_circular_on_branching_graphs(spark):
    rng = random.Random(8)
    for n in (6, 25):
        links = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(2 * n)] + [(100 + i, 101 + i) for i in range(4)] + [(200 + i, 201 + i) for i in range(6)]
        asked = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(60)] + [(104, 100), (104, 101), (1, 200), (7, 7), (999, 998), (104, 100)]
        out = {}
        for a, b in links:
            out.setdefault(a, set()).add(b)

        def is_circular(src, dst):
            at = {dst}
            for _ in range(5):
                if src in at:
                    return True
                at = {y for x in at for y in out.get(x, ())}
            return bool(at)

        schema = "src long, dst long"
        got = pj.circular(spark.createDataFrame(links, schema), spark.createDataFrame(asked, schema)).collect()
        assert len(got) == len(asked) and all(r["circular"] == is_circular(r["src"], r["dst"]) for r in got)


def test_entities_of_some_types(spark):
    docs = spark.createDataFrame([(1, "EH36 plate, see Ch.9 and Section 4.2, except DH32 of Pt.3. Crane of the oil tanker, 12 mm."), (2, ""), (3, None)], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = gr.extract_entities(docs).cache()
    for of in [("regulation_clause",), ("parameter", "steel_grade", "equipment", "ship_type")]:
        some = gr.extract_entities(docs, of)
        assert rows(some) == rows(whole.filter(F.col("etype").isin(*of))) != []
