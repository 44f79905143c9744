"""Chunking and document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import tokens


def complexity(merged: Column, cross_page: Column, refs: Column, paren: Column, notes: Column, cols: Column, rows: Column, borderless: Column) -> Column:
    """struct(score, reasons): how hard a table is to read."""
    marks = [(merged > 3, 1, "merged cells"), (cross_page, 2, "crosses pages"), (refs, 2, "footnote references"), (paren, 1, "parenthetical values"), (notes, 1, "footnotes"), ((cols > 8) | (rows > 50), 1, "large"), (borderless, 1, "borderless")]
    score = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n, _ in marks))
    return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(c, r) for c, _, r in marks))).alias("reasons"))


def quality_gate(score: Column) -> Column:
    return F.when(score <= 0, "pass").when(score <= 2, "low_confidence").otherwise("blocked")


def stored(review_required: Column) -> Column:
    """Whether a chunk goes to the vector table: only a true flag holds it back."""
    return ~F.coalesce(review_required, F.lit(False))


def _lines(md: Column) -> Column:
    return F.filter(F.transform(F.split(md, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def headers(tables: DataFrame) -> DataFrame:
    """table_id, headers, rows (arrays of cells): lines before the first separator and after it."""
    lines = tables.withColumn("lines", _lines(F.col("markdown")))
    rule = F.array_position(F.transform("lines", lambda x: x.rlike(r"^[|:\-\s]*-[|:\-\s]*$")), True).cast("int")
    empty = F.array().cast("array<array<string>>")
    ok = (F.size("lines") >= 2) & (F.col("at") > 0)
    out = lines.withColumn("at", rule)
    return out.select("table_id", F.when(ok, F.transform(F.slice("lines", F.lit(1), F.col("at") - 1), _cells)).otherwise(empty).alias("headers"), F.when(ok, F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), _cells)).otherwise(empty).alias("rows"))


def annotated_cells(tables: DataFrame) -> DataFrame:
    """One row per cell: its column header by index, its row's first cell, and the path of both."""
    h = headers(tables).select("table_id", F.get("headers", F.lit(0)).alias("head"), F.posexplode("rows").alias("row_no", "row"))
    c = h.select("table_id", "head", "row_no", "row", F.posexplode("row").alias("col_no", "cell"))
    column = F.coalesce(F.get("head", F.col("col_no")), F.lit(""))
    first = F.when(F.col("col_no") > 0, F.get("row", F.lit(0))).otherwise(F.lit(""))
    c = c.select("table_id", "row_no", "col_no", "cell", column.alias("col_header"), first.alias("row_header"))
    named = F.array_join(F.filter(F.array("col_header", "row_header"), lambda x: x != ""), " / ")
    return c.withColumn("header_path", F.when(named == "", F.col("cell")).otherwise(named))


def split_groups(fragments: DataFrame, transitive: bool = False) -> DataFrame:
    """Fragments (doc_id, page, has_headers, markdown; pages of one number by text) with group_no: a headerless fragment on the next page continues its predecessor.

    Unless transitive, the predecessor itself must have headers, so a third headerless page begins anew.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "markdown", "has_headers")
    follows = (F.col("page") == F.lag("page").over(order) + 1) & ~F.col("has_headers")
    if not transitive:
        follows = follows & F.lag("has_headers").over(order)
    return fragments.withColumn("group_no", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order))


def merged_fragments(grouped: DataFrame, marker: str = "\n<!-- continued -->\n") -> DataFrame:
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), marker)
    return grouped.groupBy("doc_id", "group_no").agg(texts.alias("markdown"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_fragments"))


def chunks(docs: DataFrame, max_tokens: int = 512, merge_peers: bool = True, repeat_table_header: bool = True) -> DataFrame:
    """doc_id, position, text, n_tokens: pieces of a document in order, none over max_tokens (by the estimate of a quarter of
    the characters).

    Lines that aren't blank are the units. A line over the cap is cut at the cap. The rows of a table (lines that begin with a
    bar) after its first two lines carry the header with them where a new piece begins at one, if the header takes at most
    half of the cap. merge_peers: units are packed as long as they fit; else each is a piece of its own.
    """
    most = 4 * max_tokens  # in characters; one more would still round down, but joining adds one
    plain = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    is_row = lambda x: F.ltrim(x).startswith("|")
    unit = F.struct(F.lit("").alias("text"), F.lit("").alias("header"))

    # A table's header is its first line and the rule below it; every further row is told it.
    def told(acc, x):
        rows = F.when(is_row(x), acc["rows"] + 1).otherwise(0)
        header = F.when(rows == 1, x).when(rows == 2, F.concat(acc["header"], F.lit("\n"), x)).when(rows == 0, F.lit("")).otherwise(acc["header"])
        here = F.when((rows > 2) & F.lit(repeat_table_header) & (F.length(header) <= most / 2), header).otherwise(F.lit(""))
        return F.struct(rows.alias("rows"), header.alias("header"), F.array_append(acc["out"], F.struct(x.alias("text"), here.alias("header"))).alias("out"))

    none = F.slice(F.array(unit), 1, 0)
    lines = F.aggregate(plain, F.struct(F.lit(0).alias("rows"), F.lit("").alias("header"), none.alias("out")), told, lambda acc: acc["out"])
    # Lines over the cap are cut; with a header there has to be room for it.
    room = lambda x: F.greatest(F.lit(1), most - F.when(x["header"] == "", 0).otherwise(F.length(x["header"]) + 1))
    cuts = lambda x: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(x["text"]) / room(x)).cast("int") - 1)),
        lambda i: F.struct(F.substring(x["text"], (i * room(x) + 1).cast("int"), room(x).cast("int")).alias("text"), x["header"].alias("header")),
    )
    units = F.flatten(F.transform(lines, cuts))
    alone = lambda x: F.when(x["header"] == "", x["text"]).otherwise(F.concat(x["header"], F.lit("\n"), x["text"]))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    more = lambda acc, x: F.concat(acc["open"], F.lit("\n"), x["text"])
    fits = lambda acc, x: (tokens(more(acc, x)) <= max_tokens) & F.lit(merge_peers)
    step = lambda acc, x: F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), alone(x).alias("open"))).when(
        fits(acc, x), F.struct(acc["done"].alias("done"), more(acc, x).alias("open"))
    ).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), alone(x).alias("open")))
    packed = F.aggregate(units, start, step, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda x: x != ""))
    return docs.select("doc_id", F.posexplode(packed).alias("position", "text")).withColumn("n_tokens", tokens(F.col("text")))


def sections(docs: DataFrame, levels: int = 6, heading: str = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$") -> DataFrame:
    """doc_id, run_no, path (titles from the highest heading down), text: the lines below each heading of a document.

    A heading ends those of its own and lower rank. Neighbouring sections of one path are one run; a section without text has
    no row; lines before the first heading have the path []. heading: groups 1 (as many signs as its rank) and 2 (title).
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rank = F.length(F.regexp_extract("line", heading, 1))
    lines = lines.withColumn("rank", rank).withColumn("title", F.when(rank > 0, F.regexp_extract("line", heading, 2)))
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    last = {k: F.max(F.when(F.col("rank") == k, F.col("line_no"))).over(so_far) for k in range(1, levels + 1)}
    title = {k: F.last(F.when(F.col("rank") == k, F.col("title")), ignorenulls=True).over(so_far) for k in last}
    lines = lines.withColumns({f"at{k}": last[k] for k in last} | {f"title{k}": title[k] for k in last})
    # A title holds as long as no heading of a higher rank came after it.
    open_ = lambda k: F.col(f"at{k}") > F.coalesce(F.greatest(*(F.col(f"at{j}") for j in range(1, k)), F.lit(-1)), F.lit(-1)) if k > 1 else F.col("at1").isNotNull()
    path = F.array_compact(F.array(*(F.when(open_(k), F.col(f"title{k}")) for k in last)))
    text = lines.withColumn("path", path).filter((F.col("rank") == 0) & (F.trim("line") != "")).select("doc_id", "line_no", "line", "path")
    new = F.coalesce(F.col("path") != F.lag("path").over(so_far), F.lit(True))
    text = text.withColumn("run_no", F.sum(new.cast("int")).over(so_far))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return text.groupBy("doc_id", "run_no").agg(F.first("path").alias("path"), joined.alias("text"))


def section_chunks(docs: DataFrame, max_tokens: int = 512, merge_peers: bool = True, repeat_table_header: bool = True) -> DataFrame:
    """doc_id, position, path, text, n_tokens: chunks() of every section run, so none goes over a heading; small neighbours of one
    path are packed together. The windows and folds are sequential in a document, which has to fit a task."""
    found = sections(docs)
    pieces = chunks(found.select(F.struct("doc_id", "run_no", "path").alias("doc_id"), "text"), max_tokens, merge_peers, repeat_table_header)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("run_no", "in_run")) - 1
    flat = pieces.select("doc_id.doc_id", "doc_id.run_no", "doc_id.path", F.col("position").alias("in_run"), "text", "n_tokens")
    return flat.withColumn("position", place).select("doc_id", "position", "path", "text", "n_tokens")


def token_batches(rows: DataFrame, by: str, order: str, cost: str, budget: int = 6000, most: int = 200) -> DataFrame:
    """by, batch_no, n_rows, n_tokens: rows taken in order into batches within the budget and the number of rows.

    A row over the budget is a batch of its own. The fold is sequential in each group, which therefore has to be small.
    """
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("items"))
    batch = lambda n, t: F.struct(n.cast("long").alias("n"), t.cast("long").alias("t"))
    start = F.struct(F.array().cast("array<struct<n:bigint,t:bigint>>").alias("done"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
    full = lambda a, x: (a["n"] > 0) & ((a["t"] + x["c"] > budget) | (a["n"] >= most))
    step = lambda a, x: F.when(full(a, x), F.struct(F.array_append(a["done"], batch(a["n"], a["t"])).alias("done"), F.lit(1).cast("long").alias("n"), x["c"].alias("t"))).otherwise(F.struct(a["done"].alias("done"), (a["n"] + 1).alias("n"), (a["t"] + x["c"]).alias("t")))
    done = F.aggregate("items", start, step, lambda a: F.array_append(a["done"], batch(a["n"], a["t"])))
    return items.select(by, F.posexplode(done).alias("batch_no", "b")).select(by, "batch_no", F.col("b.n").alias("n_rows"), F.col("b.t").alias("n_tokens"))


def bind_figures(text: Column, links: Column, placeholder: str, missing: str = "[figure missing]") -> Column:
    """The k-th placeholder becomes the k-th link; those left over become a fixed mark."""
    parts = F.split(text, placeholder, -1)
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(links, i - 1), F.lit(missing)), p)))
    return F.array_join(filled, "")
