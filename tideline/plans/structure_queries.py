"""Chunks along headings, large word lists, query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import context as cx
from tideline.operators import dictionary as dc
from tideline.operators import tables as tb
from tideline.operators.retrieval import words
from tideline.plans.registry import query

_H = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
_MARKED = "SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN trim(x) = '' THEN x ELSE concat(CASE (i - 1 + doc_id) % 7 WHEN 0 THEN '# ' WHEN 2 THEN '## ' WHEN 5 THEN '### ' ELSE '' END, x) END) AS l FROM documents"
_AT = ", ".join(f"max(CASE WHEN rank = {k} THEN n END) OVER w AS a{k}, last_value(CASE WHEN rank = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN a{k} > greatest(-1, {', '.join(f'coalesce(a{j}, -1)' for j in range(1, k)) or '-1'}) THEN t{k} END" for k in range(1, 7))


def _headed(t):
    """The documents as Markdown: some of their lines become headings of three ranks."""
    sign = lambda i: F.when(i == 0, "# ").when(i == 2, "## ").when(i == 5, "### ").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(x) == "", x).otherwise(F.concat(sign((i + F.col("doc_id")) % 7), x)))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(
    "SELECT doc_id, CAST(run_no AS BIGINT) AS run_no, array_to_string(any_value(path), ' / ') AS path, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM runs GROUP BY doc_id, run_no",
    marked=_MARKED,
    lines=f"SELECT *, length(regexp_extract(line, '{_H}', 1)) AS rank, regexp_extract(line, '{_H}', 2) AS title FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM marked)",
    places=f"SELECT *, {_AT} FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)",
    paths=f"SELECT doc_id, n, line, list_filter([{_OPEN}], lambda x: x IS NOT NULL) AS path FROM places WHERE rank = 0 AND trim(line) <> ''",
    runs="SELECT *, sum(CASE WHEN path IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run_no FROM (SELECT *, lag(path) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM paths)",
)
def c1_sections(t):
    return tb.sections(_headed(t)).select("doc_id", "run_no", F.array_join("path", " / ").alias("path"), F.md5("text").alias("digest"))


@query()
def c1_section_chunks(t):
    return tb.section_chunks(_headed(t))


_LEX = r"SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 4"


@query("SELECT doc_id, word AS name, CAST(strpos(low, word) - 1 AS INTEGER) AS s, CAST(strpos(low, word) - 1 + length(word) AS INTEGER) AS e FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN lex ON contains(low, word)", lex=_LEX)
def e5_large_lexicon(t):
    """First spans of all words of four letters or more that benchmark items have."""
    lexicon = t.benchmark.select(F.explode(words(F.col("text"))).alias("word")).filter(F.length("word") >= 4).select("word", F.col("word").alias("name")).distinct()
    return dc.spans(t.documents, lexicon, first=True)


@query("""SELECT user_id, concat('{"event":"query","user_id":', user_id, ',"mode":"', event_type, '","latency_ms":', CAST(CAST(value AS DECIMAL(18, 0)) AS DOUBLE), ',"token_count":', event_id % 50, ',"query_preview":"', substr(repeat(concat(event_type, ' '), 20), 1, 100), '"}') AS line FROM events""")
def f14_log_rows(t):
    q = t.events.select("user_id", F.repeat(F.concat("event_type", F.lit(" ")), 20).alias("query"), F.col("event_type").alias("mode"), F.col("value").cast("decimal(18,0)").cast("double").alias("latency"), (F.col("event_id") % 50).alias("tokens"))
    return cx.log_rows(q)
