"""Context building, history, budgets and usage in batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import tokens

#: tier -> tokens, shares of retrieval, history and generation.
TIERS = {"basic": (4000, 0.30, 0.20, 0.50), "pro": (8000, 0.40, 0.20, 0.40), "enterprise": (16000, 0.50, 0.20, 0.30)}
DAILY = {"basic": 3, "pro": 10}
PER_WINDOW = {"basic": 30, "pro": 120}


def tagged_union(sources: dict[str, DataFrame], errors: dict[str, str] | None = None) -> DataFrame:
    """Rows of all sources with their source; a failed source is one row with an error."""
    out = None
    for name, df in sources.items():
        part = df.withColumns({"source": F.lit(name), "error": F.lit(None).cast("string")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for name, message in (errors or {}).items():
        row = out.sparkSession.createDataFrame([(name, message)], "source string, error string")
        out = out.unionByName(row, allowMissingColumns=True)
    return out


def packed_context(hits: DataFrame, max_tokens: int) -> DataFrame:
    """query_id, n_used, n_tokens, context from (query_id, rank, citation, text): ranks in order up to the first overflow."""
    line = F.concat(F.lit("[Source "), F.col("citation"), F.lit("] "), F.col("text"))
    running = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = hits.withColumn("line", line).withColumn("cost", tokens(F.col("line"))).withColumn("total", running).filter(F.col("total") <= max_tokens)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n")
    return fits.groupBy("query_id").agg(F.count("*").alias("n_used"), F.sum("cost").alias("n_tokens"), joined.alias("context"))


def context_sections(passages: DataFrame, facts: DataFrame, entities: DataFrame, relations: DataFrame, most: tuple[int, int, int] = (15, 20, 10)) -> DataFrame:
    """query_id, context: key facts, then packed passages, then entities and relations, with the most of each.

    passages: (query_id, context) as packed_context() makes them; facts: (query_id, rank, text); entities: (query_id, rank,
    name, etype); relations: (query_id, rank, src, rtype, dst). Empty sections have no heading, and relations need entities.
    """

    def listed(rows: DataFrame, line: Column, n: int, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", line))
        first = rows.select("query_id", nth.alias("nth"), line.alias("line")).filter(F.col("nth") <= n)
        return first.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias(name))

    dash = F.lit("- ")
    parts = passages.select("query_id", F.col("context").alias("passages"))
    parts = parts.join(listed(facts, F.concat(dash, "text"), most[0], "facts"), "query_id", "full")
    parts = parts.join(listed(entities, F.concat(dash, "name", F.lit(" ("), "etype", F.lit(")")), most[1], "entities"), "query_id", "full")
    parts = parts.join(listed(relations, F.concat(dash, "src", F.lit(" -> "), "rtype", F.lit(" -> "), "dst"), most[2], "relations"), "query_id", "left")
    # Headings of the sections: fixed values.
    sections = [
        F.concat(F.lit("## Key Facts\n"), "facts"), F.concat(F.lit("## Document Context\n"), "passages"),
        F.concat(F.lit("## Knowledge Graph\n### Entities\n"), "entities"), F.when(F.col("entities").isNotNull(), F.concat(F.lit("### Relations\n"), "relations")),
    ]
    return parts.select("query_id", F.concat_ws("\n\n", *sections).alias("context"))


def budget(tier: Column, query: Column, tiers: dict = TIERS) -> Column:
    """struct(total, retrieval, history, generation) in tokens; long queries take from generation, which keeps a tenth."""
    def of(i: int) -> Column:
        known = F.create_map(*(F.lit(x) for k, v in tiers.items() for x in (k, float(v[i]))))
        return F.coalesce(known[tier], F.lit(float(next(iter(tiers.values()))[i])))

    empty = F.coalesce(F.length(query), F.lit(0)) == 0
    factor = F.when(empty, 1.0).otherwise(F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.length(query) / 500.0)))
    part = lambda share: (of(0) * share).cast("int")
    rest = (of(0) - part(of(1) * factor) - part(of(2))) / of(0)
    generation = F.when(empty, of(3)).otherwise(F.greatest(F.lit(0.1), rest))
    return F.struct(of(0).cast("int").alias("total"), part(of(1) * factor).alias("retrieval"), part(of(2)).alias("history"), part(generation).alias("generation"))


def citations(hits: DataFrame) -> DataFrame:
    """query_id, idx, file, regulation, excerpt: distinct sources in rank order."""
    key = ["query_id", "file", F.coalesce("regulation", F.lit("")).alias("regulation")]
    first = hits.select(*key, "rank", "text").groupBy("query_id", "file", "regulation").agg(F.min("rank").alias("rank"), F.min_by("text", "rank").alias("text"))
    w = Window.partitionBy("query_id").orderBy("rank", "file", "regulation")
    return first.select("query_id", F.row_number().over(w).alias("idx"), "file", "regulation", F.substring("text", 1, 200).alias("excerpt"))


def used_citations(cited: DataFrame, answers: DataFrame) -> DataFrame:
    mark = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    return cited.join(answers, "query_id").filter(F.contains("answer", mark)).drop("answer")


def compressed_history(messages: DataFrame, max_tokens: int) -> DataFrame:
    """conv_id, place, turn, role, text: system messages first, then what fits of the rest from the newest back.

    The last two others always stay; the first that doesn't fit is cut to what is left and ends the scan.
    """
    m = messages.withColumn("sys", F.col("role") == "system").withColumn("cost", tokens(F.col("text")))
    back = Window.partitionBy("conv_id", "sys").orderBy(F.desc("turn"))
    whole = Window.partitionBy("conv_id")
    m = m.withColumn("age", F.when(~F.col("sys"), F.row_number().over(back)))
    m = m.withColumns({"others": F.count("age").over(whole), "needed": F.sum(F.when(F.col("sys") | (F.col("age") <= 2), F.col("cost")).otherwise(0)).over(whole)})
    older = F.when(F.col("age") > 2, F.col("cost")).otherwise(0)
    m = m.withColumn("before", F.sum(older).over(back.rowsBetween(Window.unboundedPreceding, 0)) - older)
    left = F.lit(max_tokens) - F.col("needed") - F.col("before")
    must = F.col("sys") | (F.col("age") <= 2) | (F.col("others") <= 2)
    whole_fits = left >= F.col("cost")
    m = m.withColumn("left", left).filter(must | (F.col("left") > 0))
    text = F.when(must | whole_fits, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.greatest(F.lit(0), F.col("left") * 4 - 3).cast("int")), F.lit("...")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("sys"), "turn"))
    return m.select("conv_id", place.alias("place"), "turn", "role", text.alias("text"))


def expanded_query(query: Column, i: int, synonyms: dict[str, list[str]]) -> Column:
    """The query with the i-th synonym of every key that it contains."""
    extra = [F.when(F.contains(F.lower(query), F.lit(k)), F.lit(v[i])) for k, v in synonyms.items() if i < len(v)]
    return F.concat_ws(" ", query, *extra) if extra else query


def iterated(queries: DataFrame, retrieve, synonyms: dict, rounds: int = 3, enough: float = 0.5) -> DataFrame:
    """query_id, round, score: the round with the best top score; a query that reaches ``enough`` is not asked again.

    retrieve(queries) gives hits (query_id, score) for all unfinished queries at once; a query without hits has score 0.
    """
    from tideline.operators.graph import cut

    best, open_ = None, queries
    for i in range(rounds):
        top = retrieve(open_).groupBy("query_id").agg(F.max("score").alias("score"))
        now = cut(open_.select("query_id").join(top, "query_id", "left").select("query_id", F.lit(i).alias("round"), F.coalesce("score", F.lit(0.0)).alias("score")))
        best = now if best is None else best.union(now)
        open_ = open_.join(now.filter(F.col("score") >= enough), "query_id", "left_anti").withColumn("text", expanded_query(F.col("text"), i, synonyms))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "round")
    return best.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def prompts(asked: DataFrame, templates: DataFrame, default: str) -> DataFrame:
    """asked (id, lang, value) with its filled template: of its language, else English, else the default."""
    own = templates.select("id", "lang", F.col("template").alias("own"))
    english = templates.filter("lang = 'en'").select("id", F.col("template").alias("english"))
    j = asked.join(F.broadcast(own), ["id", "lang"], "left").join(F.broadcast(english), "id", "left")  # a table of templates
    return j.withColumn("prompt", F.replace(F.coalesce("own", "english", F.lit(default)), F.lit("{value}"), F.col("value"))).drop("own", "english")


def usage(messages: DataFrame) -> DataFrame:
    """conv_id, prompt_tokens, completion_tokens, total_tokens."""
    spent = lambda c: F.coalesce(F.sum(F.when(c, tokens(F.col("text")))), F.lit(0))
    out = messages.groupBy("conv_id").agg(spent(F.col("role") != "assistant").alias("prompt_tokens"), spent(F.col("role") == "assistant").alias("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def limit_of(tier: Column, limits: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[tier]


def admitted_daily(events: DataFrame, limits: dict = DAILY) -> DataFrame:
    """Events (user_id, tier, ts, event_id) with admitted: the first of a user's day up to the tier's limit; no limit, all."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    limit = limit_of(F.col("tier"), limits)
    return events.withColumn("admitted", limit.isNull() | (F.row_number().over(w) <= limit))


def admissions(us: np.ndarray, held: np.ndarray, limit: int, span: int) -> np.ndarray:
    """Which of the ascending times are admitted, after those held: fewer than limit were in the span before."""
    if limit <= 0:
        return np.zeros(0, np.int64)
    times, taken, i = [*held[-limit:].tolist()], [], 0
    while i < us.size:
        if len(times) >= limit:  # the next is the first after the limit-th last admitted leaves the window
            i = max(i, int(np.searchsorted(us, times[-limit] + span)))
            if i >= us.size:
                break
        taken.append(i)
        times.append(int(us[i]))
        i += 1
    return np.array(taken, np.int64)


def admitted_window(events: DataFrame, seconds: int = 60, limits: dict = PER_WINDOW) -> DataFrame:
    """user_id, event_id, admitted: fewer than the limit were admitted in the last ``seconds``; the refused don't count.

    Users are dealt out, and their events go by in order of time: what is held of a user is the last admitted times, at most
    the limit, however many events there are; work follows the admitted, as the refused between two of them are jumped over. Users without a limit (none for their tier) are all admitted.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", us.alias("us"), "event_id", limit_of(F.col("tier"), limits).alias("limit"))
    free, bound = rows.filter("limit is null"), rows.filter("limit is not null")
    user, event = (rows.schema[c].dataType.simpleString() for c in ("user_id", "event_id"))

    most = max([*limits.values(), 1])

    def run(batches):
        last, held = None, np.zeros(0, np.int64)
        for batch in batches:
            us, limit, who = batch["us"].to_numpy(), batch["limit"].to_numpy(), batch["user_id"]
            new = (who != who.shift()).to_numpy() | np.append(True, np.diff(limit) != 0) if len(batch) else np.zeros(0, bool)
            cuts, out = [*np.flatnonzero(new), len(batch)], np.zeros(len(batch), bool)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if who.iloc[lo] != last:
                    last, held = who.iloc[lo], np.zeros(0, np.int64)
                taken = admissions(us[lo:hi], held, int(limit[lo]), seconds * 1_000_000)
                out[lo + taken] = True
                held = np.concatenate([held, us[lo + taken]])[-most:]
            yield batch[["user_id", "event_id"]].assign(admitted=out)

    ordered = bound.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    judged = ordered.mapInPandas(run, f"user_id {user}, event_id {event}, admitted boolean")
    return judged.unionByName(free.select("user_id", "event_id", F.lit(True).alias("admitted")))


def window_usage(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Events with n_window: how many of the user's lie less than ``seconds`` back, itself included."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("us", us).withColumn("n_window", F.count("*").over(w)).drop("us")


def query_metrics(log: DataFrame) -> DataFrame:
    """mode, n, avg_latency: one row per mode and one (null) for all, which is there for an empty log too, with 0."""
    modes = log.groupBy("mode").agg(F.count("*").alias("n"), F.sum("latency").alias("spent"), F.count("latency").alias("known"))
    total = modes.agg(F.lit(None).cast(log.schema["mode"].dataType).alias("mode"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("spent").alias("spent"), F.sum("known").alias("known"))
    return modes.unionByName(total).select("mode", "n", F.round(F.col("spent") / F.nullif("known", F.lit(0)), 1).alias("avg_latency"))


def log_rows(queries: DataFrame, preview: int = 100) -> DataFrame:
    """One JSON line for each query (user_id, query, mode, latency, tokens): latency to one digit, the query's first characters."""
    row = F.struct(F.lit("query").alias("event"), "user_id", "mode", F.bround("latency", 1).alias("latency_ms"), F.col("tokens").alias("token_count"), F.substring("query", 1, preview).alias("query_preview"))
    return queries.select("user_id", F.to_json(row).alias("line"))


def conversation_list(conversations: DataFrame, messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    j = conversations.join(n, "conv_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long")))
    return j.orderBy(F.desc_nulls_last("last_turn"), "conv_id").offset(offset).limit(limit)


def message_history(messages: DataFrame, owned: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.join(owned.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
