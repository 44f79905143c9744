"""Operator 4: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of digests of its paragraphs. A sketch deals them to blocks of 18 cells; a digest goes to one cell of each
third of its block, and a cell holds the exclusive or of its digests, whose last bits check the first and so tell a single
digest from several. Two sketches of one size subtract cell by cell; cells that hold a single digest then give it up, which
empties others (peeling), until the digests that differ are known. If a block keeps some, its
digests are sketched larger and peeled again. Likeness is shared over all digests.

A fingerprint can always be peeled by itself: a block that can't is stored four times larger, and so on. So two fingerprints
tell their difference whatever their sizes: the digests of the smaller one are peeled and sketched in the larger one's size,
and likewise those of a block whose difference can't be peeled. The likeness is a function of the two strings alone; the
digests that the expressions below take beside the cells are what the cells peel to.

The next document is found by a window within ranges of ids; the first row of a range also stands at the end of the range
before it, so one shuffle of the texts is enough and no range is a whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a third of a block; digests a block is sized for; rounds of peeling; enlargements, each by four.
THIRD, LOAD, ROUNDS, TRIES = 6, 12, 8, 4
#: Bits of a digest that check the others.
CHECK = (1 << 24) - 1
#: What a paragraph is: a line, and of lines over this many characters each sentence.
LONG_PARAGRAPH = 400
#: Rows of a range of ids, and ranges at most (their borders go through the driver; past it ranges grow, and are sorted on disk).
RANGE_ROWS, MOST_RANGES = 400, 20_000


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs that have a word, in order: 40 bits of hash, then 24 that check them."""
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda p: F.when(F.length(p) > LONG_PARAGRAPH, F.split(p, r"(?<=[.!?])[ \t]+")).otherwise(F.array(p))))
    return F.array_distinct(F.transform(F.filter(cut, lambda p: F.length(F.btrim(p, F.lit(" \t\r\x0b\x0c"))) > 0), lambda p: _checked(F.xxhash64(p))))


def _checked(h: Column) -> Column:
    high = h.bitwiseAND(F.lit(~CHECK))
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(CHECK)))


def blocks_for(n: Column) -> Column:
    """The least power of two of blocks for n digests."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.ceil(n / LOAD), F.lit(1))))).cast("int")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(k: Column) -> Column:
    """A digest and its cell in each third of a block."""
    at = [(F.pmod(F.shiftrightunsigned(k, 9 * i + 36), F.lit(THIRD)) + THIRD * i).cast("int") for i in range(3)]
    return F.struct(k.alias("k"), *(p.alias(f"p{i}") for i, p in enumerate(at)))


def _into(cell: Column, j: Column, entries: Column) -> Column:
    """The cell after the entries that belong to it are added, or taken out: both are exclusive or."""
    hit = lambda e: (e["p0"] == j) | (e["p1"] == j) | (e["p2"] == j)
    return F.aggregate(entries, cell, lambda a, e: F.when(hit(e), a.bitwiseXOR(e["k"])).otherwise(a))


def _digits(k: Column, above: Column) -> Column:
    """What deals a digest to blocks; digits that have dealt it to ``above`` blocks before are passed over."""
    return F.floor(F.shiftrightunsigned(k, 24) / above)


def _outer(blocks: Column) -> Column:
    """Keys are dealt twice, each time to about the root of all blocks."""
    return F.pow(F.lit(2), F.floor(F.log2(blocks) / 2)).cast("long")


def sketch(keys: Column, blocks: Column, above: Column | None = None, whole: bool = False) -> Column:
    """array (block) of arrays (cell) of long. whole: so that every block can be peeled, some of them larger."""
    zero = F.lit(0).cast("long")
    above = F.lit(1) if above is None else above
    outer = _outer(blocks)

    def plain(own: Column) -> Column:
        return _bound(F.transform(own, _placed), lambda entries: F.transform(F.sequence(F.lit(0), F.lit(3 * THIRD - 1)), lambda j: _into(zero, j, entries)))

    def block(own: Column) -> Column:
        if not whole:
            return plain(own)

        def larger(n: int) -> Column:
            return _bound(sketch(own, F.lit(4**n), blocks), lambda cells: F.when(_given_up(peel(cells)) == F.size(own), F.flatten(cells)))

        # Past the last size the digests themselves are listed; their number then isn't one of cells.
        listed = F.when(F.size(own) % (3 * THIRD) == 0, F.array_append(own, F.get(own, F.lit(0)))).otherwise(own)
        return _bound(plain(own), lambda cells: F.when(_given_up(peel(F.array(cells))) == F.size(own), cells).otherwise(F.coalesce(*(larger(n) for n in range(1, TRIES)), listed)))

    def group(g: Column) -> Column:
        some = F.filter(keys, lambda k: F.pmod(_digits(k, above), outer) == g)
        inner = (blocks / outer).cast("long")
        dealt = lambda some: F.transform(F.sequence(F.lit(0), (inner - 1).cast("int")), lambda b: block(F.filter(some, lambda k: F.pmod(F.floor(_digits(k, above) / outer), inner) == b)))
        return _bound(some, dealt)

    return F.flatten(F.transform(F.sequence(F.lit(0), (outer - 1).cast("int")), group))


def _of_block(keys: Column, i: Column, blocks: Column) -> Column:
    """The keys that sketch() deals to block i."""
    outer = _outer(blocks)
    inner = (blocks / outer).cast("long")
    return F.filter(keys, lambda k: (F.pmod(_digits(k, F.lit(1)), outer) == F.floor(i / inner)) & (F.pmod(F.floor(_digits(k, F.lit(1)) / outer), inner) == F.pmod(i.cast("long"), inner)))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell; the sketches have one number of blocks. Null for a block that one of them stores larger."""
    plain = lambda x: F.size(x) == 3 * THIRD
    return F.zip_with(a, b, lambda x, y: F.when(plain(x) & plain(y), F.zip_with(x, y, lambda c, e: c.bitwiseXOR(e))))


def peel(difference: Column) -> Column:
    """array<long> of every block: the digests that differ, or null if cells are left."""

    def once(state: Column) -> Column:
        single = F.array_distinct(F.filter(state["cells"], lambda c: (c != 0) & (_checked(c) == c)))

        def without(fresh: Column) -> Column:
            cells = F.transform(state["cells"], lambda c, j: _into(c, j, fresh))
            return F.struct(cells.alias("cells"), F.concat(state["found"], F.transform(fresh, lambda e: e["k"])).alias("found"), (F.size(fresh) == 0).alias("still"))

        return _bound(F.transform(single, _placed), without)

    def block(cells: Column) -> Column:
        begin = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.forall(cells, lambda c: c == 0).alias("still"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), begin,
            lambda s, _: F.when(s["still"], s).otherwise(once(s)),
            lambda s: F.when(F.forall(s["cells"], lambda c: c == 0), s["found"]),
        )

    return F.transform(difference, lambda cells: F.when(cells.isNotNull(), block(cells)))


def _given_up(peeled: Column) -> Column:
    """How many digests the blocks gave up; null if one keeps some."""
    return _bound(peeled, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.aggregate(p, F.lit(0), lambda n, x: n + F.size(x))))


def peeled_count(a: Column, b: Column) -> Column:
    """How many digests only one of two sketches has; null if a block keeps some."""
    return _given_up(peel(subtract(a, b)))


def difference_size(a: Column, b: Column, a_cells: Column, b_cells: Column, a_size: Column, b_size: Column) -> Column:
    """How many digests differ, by sketches of the larger of the rows' sizes (the rows' own where that is their size).

    a, b: the digests that the cells peel to. A block whose difference can't be peeled, or that is stored larger, is
    sketched again from its digests alone, four times larger each time; past the last size the sets themselves tell.
    """
    size = F.greatest(a_size, b_size)
    own = subtract(F.when(a_size == size, a_cells).otherwise(sketch(a, size)), F.when(b_size == size, b_cells).otherwise(sketch(b, size)))

    def again(i: Column) -> Column:
        def larger(sides: Column) -> Column:
            x, y = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
            tries = [peeled_count(sketch(x, F.lit(4**n), size), sketch(y, F.lit(4**n), size)) for n in range(1, TRIES)]
            return F.coalesce(*tries, F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)))

        return _bound(F.array(_of_block(a, i, size), _of_block(b, i, size)), larger)

    each = F.transform(peel(own), lambda p, i: F.when(p.isNotNull(), F.size(p)).otherwise(again(i)))
    return F.when(a == b, F.lit(0)).otherwise(F.aggregate(each, F.lit(0), lambda n, x: n + x))


def likeness(a: Column, b: Column, d: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d))


def serialised(cells: Column, digest: Column) -> Column:
    """The text's digest and, after a colon each, the cells of every block in hex."""
    return F.concat_ws(":", digest, F.array_join(F.transform(cells, lambda b: F.array_join(F.transform(b, lambda c: F.hex(c)), ",")), ":"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, size, cells and the same (next) of the next document by doc_id (after the last: the first)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("at", F.coalesce("doc_id", F.lit(2**63 - 1)))
    n = d.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    row = d.agg(F.min("at").alias("least"), F.percentile_approx("at", shares or [0.5], 20 * ranges + 1000).alias("cuts")).first()
    starts = sorted({x for x in (row["cuts"] or []) if x > row["least"]}) if shares else []
    cuts = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(F.get(cuts, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("at"), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
    )
    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(len(starts).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(starts)).alias("hi")), halve, lambda s: s["lo"])
    d = d.withColumn("keys", paragraph_digests(F.col("text"))).withColumn("size", blocks_for(F.size("keys")))
    d = d.withColumn("cells", sketch(F.col("keys"), F.col("size"), whole=True)).withColumn("bucket", bucket)
    stand = lambda b, copy, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"), F.lit(wrap).alias("wrap"))
    stands = F.array_compact(F.array(
        stand(F.col("bucket"), False, False),
        F.when(F.get(cuts, F.col("bucket") - 1) == F.col("at"), stand(F.col("bucket") - 1, True, False)),
        F.when(F.col("at") == F.lit(row["least"]).cast("long"), stand(F.lit(len(starts)), True, True)),
    ))
    d = d.withColumn("s", F.explode(stands)).select("doc_id", "text", "keys", "size", "cells", "at", "s.bucket", "s.copy", "s.wrap")
    order = Window.partitionBy("bucket").orderBy("wrap", "at", "text", "copy")
    return d.withColumn("next", F.lead(F.struct("text", "keys", "size", "cells")).over(order)).filter(~F.col("copy")).select("doc_id", "text", "keys", "size", "cells", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Null text is empty; an empty text has no paragraphs, and is like another such text alone. Null ids come last. Rows of one
    doc_id follow each other by text. A paragraph that a text repeats counts once. An empty table gives no rows; a table of
    one row has itself as its next. Repeated rows are each a row, and the next of one another. Very long texts have more
    blocks. Other columns are ignored.
    """
    d = with_next(docs)
    n = F.length("text").cast("long")
    quarter = F.floor(F.length("text") / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next.text", F.lit(1), quarter)))
    d = d.select("doc_id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "keys", "size", "cells", F.col("next.keys").alias("next_keys"), F.col("next.size").alias("next_size"), F.col("next.cells").alias("next_cells"), paragraph_digests(F.col("edited")).alias("edited_keys"), F.md5(F.col("text").cast("binary")).alias("digest"), F.md5(F.col("edited").cast("binary")).alias("edited_digest"))
    d = d.withColumn("edited_size", blocks_for(F.size("edited_keys")))
    d = d.withColumns({"edited_cells": sketch(F.col("edited_keys"), F.col("edited_size"), whole=True)})
    d = d.withColumns({
        "d_edited": difference_size(*map(F.col, ("keys", "edited_keys", "cells", "edited_cells", "size", "edited_size"))),
        "d_next": difference_size(*map(F.col, ("keys", "next_keys", "cells", "next_cells", "size", "next_size"))),
    })
    return d.select(
        "doc_id", "n_chars", "edited_sha256",
        serialised(F.col("cells"), F.col("digest")).alias("fingerprint"),
        serialised(F.col("edited_cells"), F.col("edited_digest")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("d_edited")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("d_next")).alias("near_next"),
    )
