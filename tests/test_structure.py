"""Sections and their chunks, large word lists, model outputs, logs: against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.operators import context as cx
from tideline.operators import dictionary as dc
from tideline.operators import graph as gr
from tideline.operators import tables as tb
from tideline.sources import documents as sd

PAGE = """intro line
# A #
one
## B
two
two again
## B
three
### C
# D
### E ##
four

#no heading
##
five
## F
six"""


def brute_sections(text):
    stack, runs = [], []
    for line in (text or "").split("\n"):
        m = re.match(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", line)
        if m:
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
        elif line.strip(" "):
            path = [x[1] for x in stack]
            if runs and runs[-1][0] == path:
                runs[-1][1].append(line)
            else:
                runs.append((path, [line]))
    return [(p, "\n".join(lines)) for p, lines in runs]


def test_sections(spark):
    rng = random.Random(3)
    made = ["\n".join(rng.choice(["# A", "## B", "## B", "### C", "text", "more text", "", "###### Z"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts = [PAGE, "", None, "# only", "plain", *made]
    got = {}
    for r in tb.sections(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "run_no").collect():
        got.setdefault(r["doc_id"], []).append((r["path"], r["text"]))
    assert got == {i: brute_sections(t) for i, t in enumerate(texts) if brute_sections(t)}
    assert got[0] == [([], "intro line"), (["A"], "one"), (["A", "B"], "two\ntwo again\nthree"), (["D", "E"], "four\n#no heading\n##\nfive"), (["D", "F"], "six")]


def test_section_chunks(spark):
    text = "# A\n" + "\n".join(f"line {i} " + "x" * 30 for i in range(60)) + "\n## B\nshort\n## B\nshort too\n# C\n| h | k |\n|---|---|\n" + "\n".join(f"| {i} | {'y' * 20} |" for i in range(30))
    rows = tb.section_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 64).orderBy("position").collect()
    assert [r["position"] for r in rows] == [*range(len(rows))] and all(r["n_tokens"] <= 64 for r in rows)
    assert [r["text"] for r in rows if r["path"] == ["A", "B"]] == ["short\nshort too"]
    for path, body in brute_sections(text):
        mine = [r["text"] for r in rows if r["path"] == path]
        if path == ["C"]:
            assert all(m.startswith("| h | k |\n|---|---|") for m in mine)
        else:
            assert "\n".join(mine) == body


def test_dictionary_spans(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 4))): f"n{i}" for i in range(60)} | {"": "none", "ä": "umlaut", "abc": "n999"}
    texts = ["".join(rng.choices("abcABC ä", k=200)) for _ in range(30)] + [None, "", "x" * 50_000 + "abc"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, s int")
    want = sorted((i, n, m.start(), m.start() + len(w)) for i, t in enumerate(texts) for w, n in words.items() if w and t for m in re.finditer(f"(?={re.escape(w)})", t.lower()))
    assert sorted(map(tuple, dc.spans(docs, words).collect())) == want
    table = spark.createDataFrame([*words.items(), ("abc", "zz")], "word string, name string")
    once = {(d, n, s, e): None for d, n, s, e in reversed(want)}
    first = {}
    for d, n, s, e in once:
        first[d, n] = min(first.get((d, n), (s, e)), (s, e))
    assert sorted(map(tuple, dc.spans(docs, table, first=True).collect())) == sorted((d, n, s, e) for (d, n), (s, e) in first.items())
    assert dc.spans(docs, {}).count() == 0
    with pytest.raises(ValueError):
        dc.spans(docs, words, most_bytes=10)


def test_ship_spans(spark):
    words = {"tug": "Tug", "tugboat": "Tug", "boat": "Boat", "lng carrier": "LNG", "carrier": "Carrier", "a.b": "Dot", "oat": "Oat"}
    texts = ["A TUGBOAT and a tug", "LNG carrier", "axb a.b", "", None, "tu gboat", "no", "carrier carrier"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", gr.ship_spans(F.col("text"), words).alias("x")).collect()
    for r in rows:
        low = (r["text"] or "").lower()
        assert [tuple(x) for x in r["x"] or []] == [(low.find(w), low.find(w) + len(w), n) for w, n in words.items() if w in low]


def test_packed_documents(spark, tmp_path):
    import base64
    import datetime

    rows = [(i, f"text {i} ü\n", bytes([i % 256]), datetime.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(500)] + [(None, "lost", b"", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw binary, at timestamp")
    path = str(tmp_path / "packed")
    assert [r["text"] for r in sd.write_packed(docs, path, file_bytes=8000).collect()] == ["lost"]
    files = sorted((tmp_path / "packed" / "lines").glob("part-*"))
    assert 3 < len(files) < 20  # by bytes, not by documents
    by_part = {int(f.name.split("-")[1]): f.read_bytes() for f in files}
    for r in spark.read.parquet(f"{path}/index").collect():
        d = json.loads(by_part[r["part"]][r["at"] : r["at"] + r["n_bytes"]])
        i = r["id"]
        assert d == {"doc_id": i, "text": f"text {i} ü\n", "raw": base64.b64encode(bytes([i % 256])).decode(), "at": f"2024-01-01T00:00:{i % 60:02d}.000000Z"}
    got = sd.read_packed(spark, path, spark.createDataFrame([(3,), (499,), (999,)], "doc_id long"))
    assert sorted(json.loads(r["value"])["doc_id"] for r in got.collect()) == [3, 499] and len([f for f in got.inputFiles() if "/lines/" in f]) <= 2
    assert sd.read_packed(spark, path).count() == 500 and sd.read_packed(spark, path, spark.createDataFrame([(-5,)], "doc_id long")).count() == 0


def brute_object(text):
    at = text.find("{")
    if at < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : i + 1]
    return None


def test_first_object(spark):
    rng = random.Random(1)
    texts = ["", "none", "{", "}{}", 'a {"x": "}\\"{"} b {}', '{"a": {"b": {}}} {', '\\{"\\\\"}'] + ["".join(rng.choices('{}"\\ab', k=rng.randint(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", gr.first_object(F.col("raw")).alias("x")).collect()
    assert [r["x"] for r in rows] == [brute_object(r["raw"]) for r in rows]


def test_model_outputs(spark):
    good = {"entities": [{"id": "a", "name": "A", "type": "t", "properties": {"k": {"d": 1}}}, {"name": "B"}, "no object", {"name": 7, "id": ""}], "relations": [{"source": "a", "target": "a"}, {"source": "a", "target": "x"}, 5, {"source": "a", "target": "a", "type": "is", "properties": []}]}
    raws = [json.dumps(good), "Text\n```json\n" + json.dumps(good) + "\n```", "nothing {", None, '{"entities": {"a": 1}, "relations": null}', "[1, 2]"]
    out = spark.createDataFrame(list(enumerate(raws)), "output_id long, raw string")
    rows = {r["output_id"]: r for r in gr.parsed_outputs(out).collect()}
    md5 = lambda s: __import__("hashlib").md5(s.encode()).hexdigest()
    for i in (0, 1):
        assert [tuple(e) for e in rows[i]["entities"]] == [("a", "A", "t", '{"k":{"d":1}}'), (md5("B:unknown"), "B", "unknown", "{}"), (md5("7:unknown"), "7", "unknown", "{}")]
        assert [tuple(r)[1:] for r in rows[i]["relations"]] == [("a", "a", "references", "{}"), ("a", "a", "is", "{}")]
    assert all(not rows[i]["entities"] and not rows[i]["relations"] for i in (2, 3, 4, 5))
    assert {(r["output_id"], r["entity_id"]) for r in gr.parse_entities(out).collect()} == {(0, "a"), (0, md5("B:unknown")), (0, md5("7:unknown"))}
    assert sorted((r["output_id"], r["relation_id"]) for r in gr.parse_relations(out).collect()) == sorted([(0, md5("a:a:references")), (0, md5("a:a:is"))])


def test_original_names(spark):
    rows = spark.createDataFrame([("s 5", "regulation_clause", "DNV", {"a": "1"}), ("EH36", "steel_grade", "DNV", {"a": "1"}), ("s 6", "equipment", "", None), ("s 7", "equipment", "LR", {"original_name": "old"})], "name string, kind string, society string, p map<string,string>")
    got = rows.select(gr.with_original(F.col("p"), F.col("name"), F.col("kind"), F.col("society")).alias("p"), gr.disambiguated(F.col("name"), F.col("kind"), F.col("society")).alias("n")).collect()
    assert [(r["n"], r["p"]) for r in got] == [("DNV-s 5", {"a": "1", "original_name": "s 5"}), ("EH36", {"a": "1"}), ("s 6", {}), ("LR-s 7", {"original_name": "s 7"})]


def test_query_metrics(spark):
    schema = "mode string, latency double"
    assert [tuple(r) for r in cx.query_metrics(spark.createDataFrame([], schema)).collect()] == [(None, 0, None)]
    got = cx.query_metrics(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 2, 1.5), ("b", 1, None), (None, 3, 1.5)], key=str)
    line = cx.log_rows(spark.createDataFrame([("u", "q" * 120, "simple", 12.34, 5)], "user_id string, query string, mode string, latency double, tokens int")).first()["line"]
    assert json.loads(line) == {"event": "query", "user_id": "u", "mode": "simple", "latency_ms": 12.3, "token_count": 5, "query_preview": "q" * 100}
