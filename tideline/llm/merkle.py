"""Operator 13: a Merkle manifest of a table, by sibling-shift self-joins.

Nodes of a level are rows (g, i): the i-th of group g. Every level is joined with itself at the computed indices of a node's
siblings (slot offsets one and two, in runs of three), and the rows of slot zero give the parents. A level is written once;
paths then come down from the root, one join a level, so a leaf meets a third as many parents and no key is hot: the index is
part of every key. Sizes go by levels of a third each, so all levels together hold half as many rows again as there are leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: Children of a node.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nothing() -> Column:
    return F.lit(b"")


def encoded(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':', and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp (the source, so that null comes first), leaf, tampered (null where the tampered text has the same leaf).

    Texts are hashed where they stand; only digests go on.
    """
    docs = docs.select(*(F.col(n).cast("string" if n in ("source", "lang", "text") else "long").alias(n) for n in FIELDS))
    of = lambda text: digest(F.concat(*(encoded(F.col(n)) for n in FIELDS[:-1]), encoded(text)))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, of(F.replace("text", F.lit("\n"), F.lit(""))))
    grp = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select("doc_id", grp.alias("grp"), of(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows sorted over all partitions, written once, with part and at (ascending over parts and within them)."""
    there = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows needn't share a partition
    at = F.monotonically_increasing_id()
    out = there.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").drop("row").withColumn("at", at)
    return staged(out).withColumn("part", F.shiftright("at", 33))


def runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, part, first, n_part, before, n: where each group begins in each part. As many rows as parts and groups at most."""
    found = rows.groupBy(*by, "part").agg(F.min("at").alias("first"), F.count("*").alias("n_part"))
    group = Window.partitionBy(*by)
    earlier = F.sum("n_part").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", F.coalesce(earlier, F.lit(0))).withColumn("n", F.sum("n_part").over(group))


def with_siblings(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes (g, i, n, h) with l and r, the digests of the siblings before and after them, and up, the parent's, at slot zero."""
    slot = F.pmod(F.col("i"), F.lit(FANOUT))
    there = nodes.select(F.col("g").alias("g_"), F.col("i").alias("i_"), F.col("h").alias("h_"))
    out = nodes.select("g", "i", "n", "h", *more)
    for k in range(1, FANOUT):
        target = F.col("i") - slot + F.pmod(slot + k, F.lit(FANOUT))
        out = out.withColumn("j", target).join(there, (F.col("g") == F.col("g_")) & (F.col("j") == F.col("i_")), "left")
        out = out.withColumn(f"s{k}", F.coalesce("h_", nothing())).drop("g_", "i_", "h_", "j")
    # The sibling of offset k stands before the node if its slot, slot + k, wraps around.
    wraps = lambda k: slot + k >= FANOUT
    before = F.concat(*(F.when(wraps(k), F.col(f"s{k}")).otherwise(nothing()) for k in range(1, FANOUT)))
    after = F.concat(*(F.when(wraps(k), nothing()).otherwise(F.col(f"s{k}")) for k in range(1, FANOUT)))
    up = F.when(slot == 0, digest(hexed(F.concat("h", after))))
    return out.select("g", "i", "n", "h", *more, before.alias("l"), after.alias("r"), up.alias("up"))


def parents(level: DataFrame) -> DataFrame:
    """The next level's nodes."""
    return level.filter("up is not null").select("g", F.expr(f"i div {FANOUT}").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.col("up").alias("h"))


def climb(nodes: DataFrame, most: int, *more: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels with siblings from the leaves up, each written once, and the single nodes that remain at each level.

    most: nodes of the largest group. ``more`` columns stay with the leaves, single ones too.
    """
    levels, tops = [], [nodes.filter("n = 1").select("g", "h")]
    while most > 1:
        level = staged(with_siblings(nodes if more else nodes.filter("n > 1"), *more))
        nodes, more = parents(level.filter("n > 1")), ()
        levels.append(level)
        tops.append(nodes.filter("n = 1").select("g", "h"))
        most = -(-most // FANOUT)
    return levels, tops


def descend(level: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """Nodes with the path from them to the root: their own siblings, then the parent's path (of above: g, i, path, subroot)."""
    own = F.array(F.struct("l", "r"))
    x = level.withColumn("j", F.expr(f"i div {FANOUT}")).join(above.select(F.col("g").alias("g_"), F.col("i").alias("i_"), "path", "subroot"), (F.col("g") == F.col("g_")) & (F.col("j") == F.col("i_")))
    return x.select("g", "i", *more, F.when(F.col("n") > 1, F.concat(own, "path")).otherwise(F.col("path")).alias("path"), "subroot")


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex, that a leaf's hex and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(hexed(x["l"]), a, hexed(x["r"])).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (doc_id, source, lang, n_chars, text).

    Null fields count as '-', a null source is a group of its own and comes first, a null doc_id comes first in its group and is
    never tampered with. Rows of one id stand in the order of their leaves; repeated rows are leaves each, and as they are alike
    it doesn't matter which is which. A lone leaf is its subroot, a lone subroot the root; without siblings the proof is the
    digest of nothing. An empty table gives no rows. Other columns are ignored. Texts of any length are hashed whole.
    """
    base = placed(leaves(docs), ["grp", "doc_id", "leaf", "tampered"])
    spread = runs(base, ["grp"])
    groups = placed(spread.groupBy("grp").agg(F.max("n").alias("n")), ["grp"])
    total = runs(groups, [])
    groups = groups.join(total.select("part", "first", "before", F.col("n").alias("n_groups")), "part").select("grp", "n", "n_groups", (F.col("at") - F.col("first") + F.col("before")).alias("g"))
    groups = staged(groups)
    most, n_groups = groups.agg(F.max("n"), F.max("n_groups")).first()  # two numbers
    here = spread.join(groups.select("grp", "g"), "grp").select("grp", "part", "first", "before", "n", "g")
    nodes = base.join(here, ["grp", "part"]).select("g", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n", F.col("leaf").alias("h"), "doc_id", "tampered")
    nodes = staged(nodes)

    levels, tops = climb(nodes, most or 0, "doc_id", "tampered")
    if not levels:  # every source has one row
        levels = [nodes.select("*", nothing().alias("l"), nothing().alias("r"))]
    alone = reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(k)) for k, t in enumerate(tops)])
    alone = staged(alone.select("g", "level", F.col("h").alias("subroot")))

    upper = alone.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups or 0).cast("long").alias("n"), F.col("subroot").alias("h"))
    above, ends = climb(upper, n_groups or 0)
    top = ends[-1].first()  # one row
    root = F.lit(top["h"].hex() if top else None).cast("string")
    kind = "array<struct<l:binary,r:binary>>"
    path = ends[-1].select("g", F.lit(0).cast("long").alias("i"), F.array().cast(kind).alias("path"), nothing().alias("subroot"))
    for level in reversed(above):
        path = descend(level, path)
    peaks = staged(path.select(F.col("i").alias("g"), "path").join(alone, "g").select("g", F.lit(0).cast("long").alias("i"), "path", "subroot", "level"))

    down = peaks.filter(F.col("level") == len(tops) - 1).drop("level")
    for k in range(len(levels) - 1, 0, -1):
        down = descend(levels[k], down).unionByName(peaks.filter(F.col("level") == k).drop("level"))
    if len(tops) > 1:
        down = down.unionByName(peaks.filter("level = 0").drop("level"))
    x = descend(levels[0], down, "h", "doc_id", "tampered")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: hexed(F.concat(p["l"], p["r"]))), "").cast("binary"), 256)
    x = x.select("doc_id", hexed(F.col("h")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded(hexed(F.coalesce("tampered", "h")), F.col("path")).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(name: str, text: str | None = None) -> str:
    v = text or f"CAST({name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END"


_LEAF = "sha256(concat({}))"
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: unicode(c)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT))))"
ORACLE_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF.format(', '.join(_field(n) for n in FIELDS))} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295::UBIGINT) % 2 = 0
      THEN {_LEAF.format(', '.join([*(_field(n) for n in FIELDS[:-1]), _field('text', "replace(text, chr(10), '')")]))} END AS tampered
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, dense_rank() OVER (ORDER BY grp) - 1 AS g FROM base),
tree AS (SELECT 0 AS level, g, i, n, leaf AS h FROM numbered
  UNION ALL SELECT level + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY level, g, i // 3, n),
peaks AS (SELECT g, level AS height, h AS subroot, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, n, subroot AS h FROM peaks
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (SELECT d.g, d.i AS leaf_no, v.level AS level, t.i, t.h, t.i < p.i AS before
  FROM numbered d JOIN peaks k ON k.g = d.g, LATERAL (SELECT unnest(range(0, k.height)) AS level) v
  JOIN (SELECT * FROM tree WHERE n > 1) p ON p.g = d.g AND p.level = v.level AND p.i = d.i // CAST(power(3, v.level) AS BIGINT)
  LEFT JOIN tree t ON t.g = p.g AND t.level = p.level AND t.i // 3 = p.i // 3 AND t.i <> p.i
  UNION ALL SELECT d.g, d.i, k.height + p.level, t.i, t.h, t.i < p.i
  FROM numbered d JOIN peaks k ON k.g = d.g JOIN (SELECT * FROM top WHERE n > 1) p ON p.i = d.g // CAST(power(3, p.level) AS BIGINT)
  LEFT JOIN top t ON t.level = p.level AND t.i // 3 = p.i // 3 AND t.i <> p.i),
sides AS (SELECT g, leaf_no, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE before), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE NOT before), '') AS r FROM steps GROUP BY ALL),
walk AS (SELECT g, i AS leaf_no, 0 AS level, coalesce(tampered, leaf) AS h FROM numbered
  UNION ALL SELECT w.g, w.leaf_no, w.level + 1, sha256(concat(s.l, w.h, s.r)) FROM walk w JOIN sides s ON s.g = w.g AND s.leaf_no = w.leaf_no AND s.level = w.level),
ends AS (SELECT g, leaf_no, arg_max(h, level) AS folded_root FROM walk GROUP BY g, leaf_no),
proofs AS (SELECT g, leaf_no, string_agg(concat(l, r), '' ORDER BY level) AS proof FROM sides GROUP BY g, leaf_no)
SELECT d.doc_id, d.leaf, k.subroot, z.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = z.h AS verified
FROM numbered d JOIN peaks k ON k.g = d.g JOIN ends e ON e.g = d.g AND e.leaf_no = d.i LEFT JOIN proofs p ON p.g = d.g AND p.leaf_no = d.i, (SELECT h FROM top WHERE n = 1) z
"""
