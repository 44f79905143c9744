"""Query complexity, decomposition, evidence, and numeric requirement conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicon as lx


def mentioned(query: Column, societies=lx.SOCIETIES) -> Column:
    """Societies whose lower-cased name is a substring, in list order."""
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(query), F.lit(s.lower())), s) for s in societies)))


def complexity(query: Column, history_hits: Column) -> Column:
    """0 to 15: societies, references, deep, scope and domain words, and a history of which the last three name a society."""
    low = F.lower(query)

    def words(lists, points: int) -> Column:
        plain, bounded = lists
        hits = [F.contains(query, F.lit(w)) for w in plain] + [low.rlike(rf"\b{w}\b") for w in bounded]
        return reduce(lambda a, b: a + b, (F.when(h, points).otherwise(0) for h in hits))

    reference = F.when(query.rlike(r"(?i)Pt\.\s*\d+.*Ch\.\s*\d+"), 2).when(query.rlike(r"(?i)(?:Pt\.|Ch\.|§)\s*\d"), 1).otherwise(0)
    score = F.size(mentioned(query)) + reference + words(lx.DEEP, 2) + words(lx.SCOPE, 2) + words(lx.DOMAIN, 1) + F.when(history_hits, 3).otherwise(0)
    return F.least(F.lit(15), score)


def suggestion(score: Column) -> Column:
    return F.when(score >= 11, "auto").when(score >= 8, "strong").when(score >= 5, "suggest").otherwise("none")


def last_three_mention(messages: DataFrame) -> DataFrame:
    """Messages with whether they and the two before them all name a society."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    hit = (F.size(mentioned(F.col("text"))) > 0).cast("int")
    return messages.withColumn("hit", hit).withColumn("history_hits", (F.count("*").over(w) == 3) & (F.min("hit").over(w) == 1)).drop("hit")


def decomposed(queries: DataFrame, most: int = 8) -> DataFrame:
    """query_id, no, question, search_query, estimate: one sub-question per society, or one for all."""
    s = F.slice(mentioned(F.col("query")), 1, most)
    q = queries.withColumn("s", F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(None).cast("string"))))
    q = q.withColumn("estimate", F.least(F.size("s") * 15 + 25, F.lit(120))).select("query_id", "query", "estimate", F.posexplode("s").alias("no", "society"))
    named = F.col("society").isNotNull()
    return q.select(
        "query_id", (F.col("no") + 1).alias("no"),
        F.when(named, F.concat("society", F.lit(" requirements for: "), F.substring("query", 1, 80))).otherwise(F.substring("query", 1, 120)).alias("question"),
        F.when(named, F.concat("society", F.lit(" "), F.substring("query", 1, 100))).otherwise(F.substring("query", 1, 150)).alias("search_query"), "estimate",
    )


def evidence(sources: DataFrame) -> DataFrame:
    """The first row of every (query_id, chunk_id) by source_no and rank."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("source_no", "rank")
    return sources.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def standards(queries: DataFrame, codes: DataFrame) -> DataFrame:
    """query_id, code, title, score: the first code (by pos) that the upper-cased query contains."""
    hits = queries.join(F.broadcast(codes), F.contains(F.upper("query"), F.upper("code")))  # a list of codes
    return hits.groupBy("query_id").agg(F.min_by("code", "pos").alias("code"), F.min_by("title", "pos").alias("title")).withColumn("score", F.lit(0.8))


def graph_evidence(entities: DataFrame, score: float = 0.6) -> DataFrame:
    text = F.format_string("[KG] %s: %s", "etype", "name")
    return entities.select(F.concat(F.lit("kg-"), F.md5(text)).alias("chunk_id"), text.alias("text"), F.lit(score).alias("score"))


def first_urls(results: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("url").orderBy(order)
    return results.filter("url is not null and url <> ''").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def augmented(query: Column, tags: Column) -> Column:
    """The query with the suffix of each of its strategies. The suffixes are fixed values."""
    suffixes = [("standards", "ISO ASTM API standard"), ("cases", "marine accident report MAIB NTSB"), ("regulations_imo", "IMO SOLAS MARPOL MSC MEPC circular")]
    return F.concat_ws(" ", query, *(F.when(F.array_contains(tags, tag), s) for tag, s in suffixes))


def requirements(chunks: DataFrame, patterns=lx.REQUIREMENTS, unit_pattern: bool = False) -> DataFrame:
    """param, society, value from (seq, society, text): the last value in order of chunk, pattern and match.

    The last pattern has no parameter; with unit_pattern its values count as 'requirement'.
    """
    text = F.col("text")
    found = []
    for i, p in enumerate(patterns[:2] + ([patterns[2]] if unit_pattern else [])):
        values = F.regexp_extract_all(text, F.lit(p), F.lit(2 if i < 2 else 1))
        names = F.regexp_extract_all(text, F.lit(p), F.lit(1)) if i < 2 else F.transform(values, lambda _: F.lit("requirement"))
        found.append(F.zip_with(names, values, _requirement(i)))
    rows = chunks.filter("society is not null").select("society", "seq", F.posexplode(F.concat(*found)).alias("n", "x"))
    rows = rows.select("society", "seq", "n", "x.param", F.expr("try_cast(x.value as double)").alias("value")).filter("value is not null")
    return rows.groupBy("param", "society").agg(F.max_by("value", F.struct("seq", "n")).alias("value"))


def _requirement(pattern: int):
    def pair(name: Column, value: Column) -> Column:
        return F.struct(normalised(name).alias("param"), value.alias("value"), F.lit(pattern).alias("pattern"))

    return pair


def normalised(name: Column, names: dict[str, str] = lx.PARAMETER_NAMES) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[low], low)


def conflicts(values: DataFrame) -> DataFrame:
    """Pairs of societies (in name order) whose values of a parameter differ, with the difference in per cent of the larger."""
    a, b = (values.select("param", F.col("society").alias(f"society_{x}"), F.col("value").alias(f"value_{x}")) for x in "ab")
    j = a.join(b, "param").filter("society_a < society_b and abs(value_a - value_b) >= 0.001")
    j = j.withColumn("difference_pct", F.bround(F.abs(F.col("value_a") - F.col("value_b")) / F.greatest("value_a", "value_b") * 100, 1))
    return j.withColumn("severity", F.when(F.col("difference_pct") >= 10, "warning").otherwise("info"))


def findings(pairs: DataFrame, most: int = 5) -> DataFrame:
    """One row: the first conflicts as lines with confidence 0.5, or a fixed line with 0.7."""
    line = F.format_string("%s: %s and %s differ", "param", "society_a", "society_b")
    top = pairs.orderBy("param", "society_a", "society_b").limit(most).select("param", "society_a", "society_b", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("param", "society_a", "society_b", "line"))), lambda x: x["line"]), "\n")
    return top.agg(F.count("*").alias("n"), lines.alias("text")).select(F.when(F.col("n") == 0, "no conflicts found").otherwise(F.col("text")).alias("finding"), F.when(F.col("n") == 0, 0.7).otherwise(0.5).alias("confidence"))
