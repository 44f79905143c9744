"""Rule-based entities and relations, merging, a property graph in two tables, and traversal.

entities: entity_id, name, etype, doc_id; relations: relation_id, src, dst, rtype, confidence.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import lexicon as lx
from tideline.functions.text import as_re2, match_spans


#: Characters of a clause, at most, by which names are looked up.
PIECE = 32


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none and runs on this machine (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def first_seen(names: Column) -> Column:
    return F.array_distinct(names)


def steel_grades(text: Column) -> Column:
    return first_seen(F.regexp_extract_all(text, F.lit(as_re2(lx.STEEL_GRADE)), F.lit(0)))


def equipment(text: Column) -> Column:
    return first_seen(F.regexp_extract_all(text, F.lit(as_re2(lx.EQUIPMENT)), F.lit(0)))


def parameters(text: Column) -> Column:
    return first_seen(F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(as_re2(p)), F.lit(0)) for p in lx.PARAMETERS)), lambda x: F.trim(x)))


def spans(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*(match_spans(text, p) for p in patterns)))


def clause_spans(text: Column, patterns=lx.CLAUSES) -> Column:
    """Clause spans by start, longest first, without those that lie inside what is kept; an overlap that ends later stays."""
    found = F.array_sort(spans(text, patterns), lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["e"] != b["e"], F.when(a["e"] > b["e"], -1).otherwise(1)).otherwise(0))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))
    step = lambda acc, x: F.when(x["e"] > acc["last"], F.struct(x["e"].alias("last"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def ship_types(text: Column, words: dict[str, str] = lx.SHIP_TYPES) -> Column:
    """Canonical names whose word is a substring of the lower-cased text, each once, in dictionary order."""
    low = F.lower(text)
    return first_seen(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), name) for w, name in words.items()))))


def ship_spans(text: Column, words: dict[str, str] = lx.SHIP_TYPES) -> Column:
    """First spans of the words in the lower-cased text, in dictionary order.

    One pass finds the longest word that begins at each place; others that begin there are its beginnings. Only the words that
    this shows to be there are then looked for. (Word lists of more than some dozens: dictionary.spans().)
    """
    longest = sorted(words, key=lambda w: (-len(w), w))
    firsts = "".join(sorted({re.escape(w[0]) for w in words}))
    at_place = f"(?=[{firsts}])(?=({'|'.join(map(re.escape, longest))}))"
    known = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(name).alias("m")) for w, name in words.items()))
    spans_of = lambda d, at: F.struct((at - 1).alias("s"), (at - 1 + F.length(d["w"])).alias("e"), d["m"].alias("m"))

    def there(low):
        met = F.array_distinct(F.regexp_extract_all(low, F.lit(at_place), F.lit(1)))
        present = lambda met: F.filter(known, lambda d: F.exists(met, lambda m: F.startswith(m, d["w"])))
        return F.transform(F.flatten(F.transform(F.array(met), present)), lambda d: spans_of(d, F.instr(low, d["w"])))

    return F.flatten(F.transform(F.array(F.lower(text)), there))


def not_negated(text: Column, found: Column, patterns=lx.NEGATIONS) -> Column:
    """Spans that overlap no exception (from its word to the next full stop); exceptions are looked for once a text."""
    outside = lambda negated: F.filter(found, lambda m: ~F.exists(negated, lambda n: (m["s"] < n["e"]) & (m["e"] > n["s"])))
    return F.get(F.transform(F.array(spans(text, patterns)), outside), F.lit(0))


def entity_id(name: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws(":", name, kind))


def relation_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws(":", src, dst, kind))


def extract_entities(docs: DataFrame, of: tuple[str, ...] | None = None) -> DataFrame:
    """entity_id, name, etype, doc_id from (doc_id, text): all rules, exceptions left out, one row per name, type and document.

    of: the types that are wanted; no rule depends on another, so the others' patterns aren't looked for.
    """
    text = F.col("text")
    rules = [("steel_grade", spans(text, [lx.STEEL_GRADE])), ("regulation_clause", clause_spans(text)), ("equipment", spans(text, [lx.EQUIPMENT])), ("parameter", spans(text, lx.PARAMETERS)), ("ship_type", ship_spans(text))]

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.trim(m["m"]).alias("name"), F.lit(kind).alias("etype")))

    kinds = [named(*rule) for rule in rules if of is None or rule[0] in of]
    found = F.transform(not_negated(text, F.concat(*kinds)), lambda m: F.struct(m["name"].alias("name"), m["etype"].alias("etype")))
    rows = docs.filter(F.trim("text") != "").select("doc_id", F.explode(F.array_distinct(found)).alias("x")).select("doc_id", "x.name", "x.etype")
    return rows.select(entity_id(F.col("name"), F.col("etype")).alias("entity_id"), "name", "etype", "doc_id")


def clause_references(entities: DataFrame) -> DataFrame:
    """References between the clauses of a document: every pair in name order."""
    c = entities.filter("etype = 'regulation_clause'")
    a, b = (c.select("doc_id", F.col("entity_id").alias(i), F.col("name").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    return a.join(b, "doc_id").filter(F.col("a") < F.col("b")).select("doc_id", "src", "dst", F.lit("references").alias("rtype"), F.lit(1.0).alias("confidence"))


def constraints(entities: DataFrame) -> DataFrame:
    """Every parameter of a document constrains its grades, equipment and ship types."""
    p = entities.filter("etype = 'parameter'").select("doc_id", F.col("entity_id").alias("src"))
    o = entities.filter(F.col("etype").isin("steel_grade", "equipment", "ship_type")).select("doc_id", F.col("entity_id").alias("dst"))
    return p.join(o, "doc_id").select("doc_id", "src", "dst", F.lit("constrains").alias("rtype"), F.lit(1.0).alias("confidence"))


def best_of(rows: DataFrame, keys: list[Column], priority: str = "priority", seq: str = "seq") -> DataFrame:
    """One row per key: the highest priority, of these the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(priority), F.desc(seq))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def merge_entities(rows: DataFrame) -> DataFrame:
    return best_of(rows, [F.lower("name"), F.col("etype")])


def merge_relations(rows: DataFrame) -> DataFrame:
    return best_of(rows, [F.col("src"), F.col("dst"), F.col("rtype")])


def disambiguated(name: Column, kind: Column, society: Column, kinds: tuple[str, ...] = ("regulation_clause", "equipment")) -> Column:
    return F.when(kind.isin(*kinds) & society.isNotNull() & (society != ""), F.concat_ws("-", society, name)).otherwise(name)


def with_original(properties: Column, name: Column, kind: Column, society: Column, kinds: tuple[str, ...] = ("regulation_clause", "equipment")) -> Column:
    """map<string,string> of an entity: where disambiguated() changes the name, original_name holds what it was."""
    kept = F.map_filter(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, _: k != "original_name")
    changed = kind.isin(*kinds) & society.isNotNull() & (society != "")
    return F.when(changed, F.map_concat(kept, F.create_map(F.lit("original_name"), name))).otherwise(F.coalesce(properties, F.create_map().cast("map<string,string>")))


def _shallow(depth: int = 6) -> str:
    """A pattern of balanced objects of up to ``depth`` levels at the start of a text."""
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    inner = ""
    for _ in range(depth):
        inner = r'\{(?:[^"{}]++|' + quoted + (f"|{inner}" if inner else "") + r")*+\}"
    return "(?s)^" + inner


def first_object(text: Column) -> Column:
    """The text from the first { to the } that balances it; braces within strings don't count, nor quotes after a backslash in
    one. Null if there is none. Objects of few levels are found by a pattern, others by a fold over runs of plain characters and
    single signs."""
    tail = F.nullif(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(""))
    signs = lambda tail: F.regexp_extract_all(tail, F.lit(r'(?s)["{}\\]|[^"{}\\]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a, x):
        plain = a["escaped"] | (a["end"] > 0)
        quote = ~plain & (x == '"')
        brace = ~plain & ~a["quoted"]
        depth = a["depth"] + F.when(brace & (x == "{"), 1).when(brace & (x == "}"), -1).otherwise(0)
        at = a["at"] + F.length(x)
        return F.struct(
            depth.alias("depth"), F.when(quote, ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"), (~a["escaped"] & a["quoted"] & (x == "\\")).alias("escaped"),
            at.alias("at"), F.when((a["end"] == 0) & brace & (x == "}") & (depth == 0), at).otherwise(a["end"]).alias("end"),
        )

    folded = lambda tail: F.aggregate(signs(tail), start, step, lambda a: F.when(a["end"] > 0, F.substring(tail, F.lit(1), a["end"])))
    found = lambda tail: F.coalesce(F.nullif(F.regexp_extract(tail, _shallow(), 0), F.lit("")), folded(tail))
    return F.get(F.transform(F.array(tail), found), F.lit(0))


def parsed_outputs(outputs: DataFrame) -> DataFrame:
    """output_id, entities, relations (arrays) of raw model outputs (output_id, raw).

    The whole text as JSON, else its first balanced object, else nothing. What isn't a list of objects is left out. A missing
    name is '', a missing type 'unknown' or 'references', a missing id the hash of name and type, properties that aren't an
    object '{}'. Relations between ids that the same output doesn't name are dropped.
    """
    value = F.coalesce(F.try_parse_json(F.trim("raw")), F.try_parse_json(first_object(F.col("raw"))))
    text = lambda x, path: F.try_variant_get(x, path, "string")
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")

    def properties(x):
        p = F.try_variant_get(x, "$.properties", "variant")
        return F.when(is_object(p), F.to_json(p)).otherwise(F.lit("{}"))

    def entity(x):
        name, kind = F.coalesce(text(x, "$.name"), F.lit("")), F.coalesce(text(x, "$.type"), F.lit("unknown"))
        given = F.nullif(text(x, "$.id"), F.lit(""))
        return F.struct(F.coalesce(given, entity_id(name, kind)).alias("entity_id"), name.alias("name"), kind.alias("etype"), properties(x).alias("properties"))

    def relation(x):
        src, dst, kind = F.coalesce(text(x, "$.source"), F.lit("")), F.coalesce(text(x, "$.target"), F.lit("")), F.coalesce(text(x, "$.type"), F.lit("references"))
        return F.struct(relation_id(src, dst, kind).alias("relation_id"), src.alias("src"), dst.alias("dst"), kind.alias("rtype"), properties(x).alias("properties"))

    listed = lambda v, name: F.filter(F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), is_object)
    # What is used more than once is bound as the element of an array.
    both = lambda v: F.struct(F.transform(listed(v, "entities"), entity).alias("e"), F.transform(listed(v, "relations"), relation).alias("r"))

    def closed(x):
        ids = F.array(F.transform(x["e"], lambda e: e["entity_id"]))
        kept = F.get(F.transform(ids, lambda known: F.filter(x["r"], lambda r: F.array_contains(known, r["src"]) & F.array_contains(known, r["dst"]))), F.lit(0))
        return F.struct(x["e"].alias("entities"), kept.alias("relations"))

    return outputs.select("output_id", F.get(F.transform(F.transform(F.array(value), both), closed), F.lit(0)).alias("p")).select("output_id", "p.entities", "p.relations")


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that comes first by (output_id, n), n left out. Most go before the shuffle, so that a key that every
    output names isn't sorted in one task."""
    rest = [c for c in rows.columns if c not in ("output_id", "n", key)]
    first = rows.groupBy(key).agg(F.min(F.struct("output_id", "n", *rest)).alias("x"))
    return first.select(*(F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns if c != "n"))


def parse_entities(outputs: DataFrame) -> DataFrame:
    """output_id, entity_id, name, etype, properties, confidence of raw model outputs; of an id the first stays."""
    rows = parsed_outputs(outputs).select("output_id", F.posexplode("entities").alias("n", "x")).select("output_id", "n", "x.*", F.lit(0.9).alias("confidence"))
    return first_of(rows, "entity_id")


def parse_relations(outputs: DataFrame) -> DataFrame:
    """output_id, relation_id, src, dst, rtype, properties, confidence of raw model outputs; of an id the first stays."""
    rows = parsed_outputs(outputs).select("output_id", F.posexplode("relations").alias("n", "x")).select("output_id", "n", "x.*", F.lit(0.9).alias("confidence"))
    return first_of(rows, "relation_id")


def without_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("entity_id").distinct()
    return relations.join(ids.select(F.col("entity_id").alias("src")), "src", "left_semi").join(ids.select(F.col("entity_id").alias("dst")), "dst", "left_semi")


def upsert_entities(loads: DataFrame) -> DataFrame:
    """entity_id, name, etype, society, ref_count, doc_id, properties from rows with load_no: counted loads; name, type and
    society of the first, document and properties of the last."""
    kept = [F.min_by(c, "load_no").alias(c) for c in ("name", "etype", "society") if c in loads.columns]
    return loads.groupBy("entity_id").agg(*kept, F.count("*").alias("ref_count"), *(F.max_by(c, "load_no").alias(c) for c in ("doc_id", "properties") if c in loads.columns))


def matched_by(entities: DataFrame, doc_id: int) -> DataFrame:
    """n: how many entities the deletion of a document touches."""
    return entities.filter(F.col("doc_id") == doc_id).agg(F.count("*").alias("n"))


def delete_document(entities: DataFrame, relations: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame]:
    """Entities and relations after a document goes: its edges fall, its entities lose a reference, the last one takes them.

    matched_by() tells how many entities that concerns.
    """
    gone = entities.filter(F.col("doc_id") == doc_id).select("entity_id")
    left = relations.join(gone.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("entity_id", "dst"), "dst", "left_anti")
    mine = F.coalesce(F.col("doc_id") == doc_id, F.lit(False))
    return entities.filter(~(mine & (F.col("ref_count") <= 1))).withColumn("ref_count", F.when(mine, F.col("ref_count") - 1).otherwise(F.col("ref_count"))), left


def lookup(entities: DataFrame, name: str | None = None, kinds: list[str] | None = None, limit: int | None = None, society: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Entities whose name has the text, of a society, of the ids (entity_id), in id order up to the limit; types are filtered after it."""
    out = entities if name is None else entities.filter(F.contains("name", F.lit(name)))
    if society is not None:
        out = out.filter(F.col("society") == society)
    if ids is not None:
        out = out.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    if limit is not None:
        out = out.orderBy("entity_id").limit(limit)
    return out if kinds is None else out.filter(F.col("etype").isin(*kinds))


def out_edges(relations: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    out = relations.join(ids.select(F.col("entity_id").alias("src")).distinct(), "src", "left_semi")
    return out if kinds is None else out.filter(F.col("rtype").isin(*kinds))


def traverse(relations: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, most: int = 10**9) -> tuple[DataFrame, DataFrame]:
    """(entity_id, hop) reached from seeds by out-edges, and every edge out of a frontier once.

    A hop is one join; it ends early when nothing new is reached, or once ``most`` entities are (without cutting any off).
    """
    edges = relations if kinds is None else relations.filter(F.col("rtype").isin(*kinds))
    seen = cut(seeds.select("entity_id").distinct().withColumn("hop", F.lit(0)))
    frontier, walked, total = seen, None, seen.count()
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("entity_id").alias("src")), "src", "left_semi")
        walked = step if walked is None else walked.union(step)
        frontier = cut(step.select(F.col("dst").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti").withColumn("hop", F.lit(hop)))
        n = frontier.count()
        seen, total = seen.union(frontier), total + n
        if not n or total >= most:
            break
    return seen, walked.distinct()


def topic_graph(entities: DataFrame, relations: DataFrame, topic: str, depth: int = 2, most: int = 50) -> tuple[DataFrame, DataFrame]:
    return traverse(relations, lookup(entities, topic, limit=most), depth, most=most)


def cross_references(entities: DataFrame, relations: DataFrame, asked: DataFrame, least: float = 0.8, kinds=("similar_to", "equivalent_to")) -> DataFrame:
    """For asked (clause, society, target): the best mapping edge from a clause of society to one of target, over ``least``.

    Of edges between the same names and societies the best is kept first. Names that hold a clause are found by equality, with
    all their pieces of the length of the clause (or of its first PIECE characters), not by trying all pairs.
    """
    e = entities.select("entity_id", F.lower("name").alias("low"), "name", F.col("society").alias("society"))
    src, dst = e.select(F.col("entity_id").alias("src"), "low", "society"), e.select(F.col("entity_id").alias("dst"), F.col("name").alias("found"), F.col("society").alias("target"))
    edges = relations.filter(F.col("rtype").isin(*kinds) & (F.col("confidence") > least)).select("src", "dst", "confidence").join(src, "src").join(dst, "dst")
    best = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("confidence"), "src", "dst"))
    named = edges.withColumn("r", best("low", "society", "target")).filter("r = 1").drop("r")
    low, size = F.lower("clause"), lambda c: F.least(F.length(c), F.lit(PIECE))
    wanted = asked.select("clause", "society", "target").distinct().withColumn("piece", F.substring(low, F.lit(1), size(low)))
    sizes = wanted.filter("piece is not null").select(F.length("piece").alias("n")).distinct()  # PIECE + 1 rows at most
    names = named.select("low").distinct().join(F.broadcast(sizes), F.length("low") >= F.col("n"))
    at = F.when(F.col("n") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.length("low") - F.col("n") + 1, F.lit(1))))
    pieces = names.select("low", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("low"), i, F.col("n"))))).alias("piece"))
    # Clauses and names meet once each, before societies and edges come to them.
    pairs = wanted.select("clause", "piece").distinct().join(pieces, "piece").filter(F.contains("low", F.lower("clause"))).select("clause", "low")
    hits = wanted.select("clause", "society", "target").join(pairs, "clause").join(named, ["low", "society", "target"])
    return hits.withColumn("r", best("clause", "society", "target")).filter("r = 1").select("clause", "society", "target", "src", "dst", "found", "confidence")


def write_back(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Relations with a similar_to edge for each mapping whose ends exist."""
    new = found.filter("src is not null and dst is not null").select(relation_id(F.col("src"), F.col("dst"), F.lit("similar_to")).alias("relation_id"), "src", "dst", F.lit("similar_to").alias("rtype"), "confidence")
    return relations.unionByName(new)
