"""Operator 2: weak supervision over quality rules, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document, by two thresholds of one measure. The rules come in
families, each of a kind of fault. A document is good or has one of these faults; expectation-maximisation over the histogram
of vote patterns (at most 3 ** rules rows, whatever the corpus) estimates the share of each, and how often each rule, where
it votes, votes bad on good documents and on those of each fault. A document is kept by its posterior probability of having
no fault. Nothing is held back from the data: a rule that errs as often here as there tells nothing, a bad vote that its
family doesn't share is outvoted, and a fault that its own family mostly denies is none. (One class for all faults would not
do: documents of two faults have nothing in common, so that the estimate can put one of them to the good ones.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, staged

ROUNDS = 25
#: Documents' worth of prior behind each estimate; what the prior takes for the chance that a rule, where it votes, votes bad
#: on a document of its own fault, of another one, and on a good one; and for the share of each fault.
PRIOR_WEIGHT, OWN, OTHER, NONE, SHARE = 2.0, 0.7, 0.05, 0.03, 0.05
#: A fault counts as one if its family's mean chance to vote bad on it is over this.
FAULT_FROM = 0.4
KEEP_FROM = 0.5


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that only rules read.

    carry: with the whole row of docs as __row.
    """
    count = lambda pattern: F.size(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([F.struct(*docs.columns).alias("__row")] if carry else []))
    d = d.withColumn("words", word_array(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    d = d.select(
        "doc_id", "words", *(["__row"] if carry else []),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count("[A-Z]").alias("n_capitals"),
        count("!").alias("n_shouts"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda x, i: x == F.get("words", i - 1))).cast("long").alias("n_stutter"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_marked"),
    )
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])
    d = d.withColumn("mean_chars", F.col("word_chars") / F.greatest("n_words", F.lit(1)))
    d = d.withColumn("windows", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), window))).drop("words")
    # Only texts with a repeated window are sorted: equal windows stand together, then their positions are put in order.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    twin = lambda s, i: (s["h"] == F.get("ordered", i - 1)["h"]) | (s["h"] == F.get("ordered", i + 1)["h"])
    d = d.withColumn("places", F.sort_array(F.transform(F.filter("ordered", twin), lambda s: s["i"]))).drop("ordered")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def votes() -> list[Column]:
    """The rules: thresholds are shares of words, letters or lines, the same for texts of any length."""
    words, chars, lines = (F.greatest(c, F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def rule(measure: Column, bad: float, good: float) -> Column:
        """Bad over one threshold, good up to the other (or the reverse, where good is more)."""
        high, low = (measure > bad, measure <= good) if bad > good else (measure < bad, measure >= good)
        return F.when(high, -1).when(low, 1).otherwise(0)

    return [
        rule(F.col("n_words"), 10, 30),
        rule(F.col("n_symbols") / chars, 0.05, 0.005),
        rule(F.col("n_marked") / words, 0.15, 0.02),
        rule(F.col("n_capitals") / chars, 0.5, 0.2),
        rule(F.col("n_shouts") / words, 0.25, 0.02),
        rule(F.col("n_repeat_words") / words, 0.2, 0.05),
        rule(F.col("n_stutter") / words, 0.3, 0.03),
        rule(F.col("n_dup_lines") / lines, 0.5, 0.05),
        F.when(F.col("n_words").between(10, 1000), rule(F.col("n_distinct") / words, 0.25, 0.4)).otherwise(0),
        F.when(~F.col("mean_chars").between(2, 15), -1).when(F.col("mean_chars").between(3, 10), 1).otherwise(0),
    ]


#: The rules (by their place in votes()) of each kind of fault: marks, shouting, repetition, form.
FAMILIES = ((1, 2), (3, 4), (5, 6, 7, 8), (0, 9))


def prior(fault: int, rule: int, families=FAMILIES) -> float:
    return NONE if not fault else OWN if rule in families[fault - 1] else OTHER


def posteriors(patterns: DataFrame, families=FAMILIES) -> DataFrame:
    """votes, posterior from rows (votes array<int>, n long): one row per pattern, fitted by expectation-maximisation.

    families: tuples of the rules of each fault; every rule is in one at most.
    """
    packed = patterns.groupBy().agg(F.collect_list(F.struct("votes", "n")).alias("p"), F.sum("n").alias("all"))
    classes, rules = range(len(families) + 1), len(votes())
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  computed once
    logs = lambda share, bad: F.struct(F.log(share).alias("share"), bad.alias("bad"), F.transform(bad, lambda b: F.log(b)).alias("if_bad"), F.transform(bad, lambda b: F.log(1 - b)).alias("if_good"))

    def shares(v: Column, model: Column) -> Column:
        """The posterior of each class."""
        said = F.transform(model, lambda c: F.aggregate(
            F.zip_with(v, F.arrays_zip(c["if_bad"].alias("bad"), c["if_good"].alias("good")), lambda x, w: F.when(x < 0, w["bad"]).when(x > 0, w["good"]).otherwise(F.lit(0.0))), c["share"], lambda a, x: a + x))
        weights = bound(said, lambda e: F.transform(e, lambda x: F.exp(x - F.array_max(e))))
        return bound(weights, lambda w: F.transform(w, lambda x: x / total(w, lambda y: y)))

    def step(model: Column) -> Column:
        scored = F.transform("p", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), shares(p["votes"], model).alias("q")))

        def refit(s: Column) -> Column:
            def of(c: int) -> Column:
                mass = lambda x: x["n"] * F.get(x["q"], F.lit(c))
                first = F.array(*(F.lit(prior(c, k, families)) for k in range(rules)))

                def rate(first_rate: Column, k: Column) -> Column:
                    tally = lambda hit: total(s, lambda x: F.when(hit(F.get(x["votes"], k)), mass(x)).otherwise(0.0))
                    return (tally(lambda v: v < 0) + PRIOR_WEIGHT * first_rate) / (tally(lambda v: v != 0) + PRIOR_WEIGHT)

                return bound(F.transform(first, rate), lambda bad: logs((total(s, mass) + 1) / (F.col("all") + len(classes)), bad))

            return F.array(*map(of, classes))

        return bound(scored, refit)

    begin = F.array(*(logs(F.lit(SHARE if c else 1 - SHARE * len(families)), F.array(*(F.lit(prior(c, k, families)) for k in range(rules)))) for c in classes))
    fitted = packed.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda m, _: step(m)))

    def faulty(c: int) -> Column:
        bad = F.get("model", F.lit(c))["bad"]
        return sum((F.get(bad, F.lit(k)) for k in families[c - 1]), F.lit(0.0)) / len(families[c - 1]) > FAULT_FROM

    told = fitted.select("p", "model", F.array(F.lit(False), *(faulty(c) for c in classes[1:])).alias("faulty")).select("model", "faulty", F.explode("p").alias("x"))
    clean = total(F.arrays_zip(shares(F.col("x.votes"), F.col("model")).alias("q"), F.col("faulty").alias("f")), lambda z: F.when(z["f"], 0.0).otherwise(z["q"]))
    return told.select(F.col("x.votes").alias("votes"), clean.alias("posterior"))


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior for every row.

    Null and empty texts have no words and fail the base rule. Repeated rows give repeated rows; a null doc_id is judged as
    any other; an empty table gives none; columns other than doc_id and text are ignored, whatever their names. Very long
    texts are taken whole, as one array of words.
    """
    f = features(docs)
    bits = votes()
    f = staged(f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*bits).alias("votes")))
    fit = posteriors(f.groupBy("votes").agg(F.count("*").alias("n")))
    # At most 3 ** rules rows are sent to all tasks.
    return f.join(F.broadcast(fit), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
        (~_failed() & (F.col("posterior") >= KEEP_FROM)).alias("kept"), F.round("posterior", 6).alias("posterior"),
    )


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; each is judged by its own text, so ids don't matter.

    Texts are gone through once: the rows are written with their votes, which are then counted and judged, and never shuffled.
    """
    rules = votes()
    rows = staged(features(docs, carry=True).select("__row", F.array(*rules).alias("votes"), _failed().alias("failed")))
    fit = posteriors(rows.groupBy("votes").agg(F.count("*").alias("n")))
    good = fit.filter(F.col("posterior") >= KEEP_FROM).select("votes")
    # At most 3 ** rules rows are sent to all tasks.
    return rows.filter("not failed").join(F.broadcast(good), "votes", "left_semi").select("__row.*")


__all__ = ["features", "judged", "kept", "posteriors", "votes", "word_array"]
