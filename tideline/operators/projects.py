"""Project analytics: dashboards, compliance, scoped search, permissions, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicon as lx


def dashboard(projects: DataFrame, children: dict[str, DataFrame], compliance: DataFrame) -> DataFrame:
    """project_id, n_<child>..., n_clauses, n_verified, pct_verified (0 without clauses); children are counted before the join."""
    out = projects.select("project_id")
    for name, df in children.items():
        out = out.join(df.groupBy("project_id").agg(F.count("*").alias(f"n_{name}")), "project_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    done = compliance.groupBy("project_id").agg(F.count("*").alias("n_clauses"), F.sum(F.when(F.col("status") == "verified", 1).otherwise(0)).alias("n_verified"))
    out = out.join(done, "project_id", "left").fillna(0, ["n_clauses", "n_verified"])
    return out.withColumn("pct_verified", F.when(F.col("n_clauses") > 0, F.round(F.col("n_verified") * 100.0 / F.col("n_clauses"), 1)).otherwise(0.0))


def issue_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def issues(rows: DataFrame, newest: str, limit: int) -> DataFrame:
    """High before medium before other, then the newest."""
    return rows.orderBy(issue_rank(F.col("priority")), F.desc(newest), "issue_id").limit(limit)


def compliance_rows(projects: DataFrame, existing: DataFrame, templates: dict[str, list[str]] = lx.TEMPLATES) -> DataFrame:
    """clause_id, project_id, clause, status: the project's regulations, or its template's; ids that exist are left alone."""
    known = F.create_map(*(x for k, v in templates.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    chosen = F.when(F.size("regulations") > 0, F.col("regulations")).otherwise(known[F.concat_ws("_", "vessel", F.lower("society"))])
    rows = projects.select("project_id", F.posexplode(chosen).alias("no", "clause"))
    rows = rows.select(F.format_string("%s-%03d", "project_id", "no").alias("clause_id"), "project_id", "clause", F.lit("unverified").alias("status"))
    return rows.join(existing.select("clause_id"), "clause_id", "left_anti")


def compliance_from_citations(clauses: DataFrame, cited: DataFrame) -> DataFrame:
    """clauses with status and conclusions after citations (project_id, conclusion_id, clause).

    A citation hits clauses of its project that equal it, or whose id contains its first 20 characters (case aside); of
    these the first by id. Unless that is verified, it needs review then and notes the conclusion once.
    """
    hit = (F.col("clause") == F.col("c")) | F.contains(F.lower("clause_id"), F.lower(F.substring("c", 1, 20)))
    c = cited.select("project_id", "conclusion_id", F.col("clause").alias("c"))
    met = clauses.select("project_id", "clause_id", "clause").join(c, "project_id").filter(hit)
    first = met.groupBy("project_id", "conclusion_id", "c").agg(F.min("clause_id").alias("clause_id"))
    new = first.groupBy("clause_id").agg(F.array_sort(F.collect_set("conclusion_id")).alias("new"))
    j = clauses.join(new, "clause_id", "left")
    touched = F.col("new").isNotNull() & (F.col("status") != "verified")
    return j.withColumns({
        "conclusions": F.when(touched, F.array_union("conclusions", "new")).otherwise(F.col("conclusions")), "status": F.when(touched, "needs_review").otherwise(F.col("status")),
    }).drop("new")


def rolled_back(clauses: DataFrame, deleted: list[str] | DataFrame) -> DataFrame:
    """clauses after conclusions are deleted (ids, or a DataFrame of conclusion_id): those left without any go back to
    unverified, unless settled."""
    if isinstance(deleted, list):
        left, held = F.array_except("conclusions", F.array(*map(F.lit, deleted))), clauses
    else:
        gone = clauses.select("clause_id", F.explode("conclusions").alias("conclusion_id")).join(deleted.select("conclusion_id").distinct(), "conclusion_id")
        held = clauses.join(gone.groupBy("clause_id").agg(F.collect_set("conclusion_id").alias("gone")), "clause_id", "left")
        left = F.coalesce(F.array_except("conclusions", "gone"), F.col("conclusions"))
    lost = (F.size(left) == 0) & (F.size("conclusions") > 0) & ~F.col("status").isin("verified", "not_applicable")
    return held.withColumn("status", F.when(lost, "unverified").otherwise(F.col("status"))).withColumn("conclusions", left).select(*clauses.columns)


def document_search(docs: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return docs.filter((F.col("status") == "done") & F.contains(F.lower("text"), F.lit(text.lower()))).orderBy("doc_id").limit(limit)


def scoped_search(queries: DataFrame, own: DataFrame, shared: DataFrame, base: float = 0.70, bonus: float = 0.10, cap: float = 0.95, enough: int = 5, good: float = 0.7, few: int = 10_000) -> DataFrame:
    """query_id, doc_id, score, source: own hits at 0.70 (more if the first 500 characters name a regulation of the query),
    and global ones at 0.5 + 0.4 * score for queries with fewer than five good own hits.

    queries: (query_id, regulations); own: (query_id, doc_id, text); shared: (query_id, doc_id, score). Up to ``few`` queries are
    sent to where the own documents lie, so a project that holds most of them isn't gathered; more are joined by query_id.
    """
    if len(queries.select("query_id").head(few + 1)) <= few:
        queries = F.broadcast(queries)
    named = F.exists("regulations", lambda r: F.contains(F.substring("text", 1, 500), r))
    mine = own.join(queries, "query_id").select("query_id", "doc_id", F.least(F.lit(cap), F.when(named, base + bonus).otherwise(base)).alias("score"), F.lit("project").alias("source"))
    full = mine.filter(F.col("score") > good).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
    rest = shared.join(full, "query_id", "left_anti").select("query_id", "doc_id", F.round(0.5 + 0.4 * F.col("score"), 6).alias("score"), F.lit("global").alias("source"))
    return mine.unionByName(rest)


def case_score(name: Column, description: Column, vessel: Column, society: Column, updated: Column, complete: Column, wanted: dict, as_of: Column) -> Column:
    """Vessel 0.3, society 0.2, name 0.3 or description 0.2, recent 0.1, complete 0.1. The clock is a parameter."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w.lower()))
    return F.round(
        F.when(F.contains(vessel, F.lit(wanted["vessel"])), 0.3).otherwise(0.0) + F.when(has(society, wanted["society"]), 0.2).otherwise(0.0)
        + F.when(has(name, wanted["query"]), 0.3).when(has(description, wanted["query"]), 0.2).otherwise(0.0)
        + F.when(F.datediff(as_of, updated) < 180, 0.1).otherwise(0.0) + F.when(complete, 0.1).otherwise(0.0), 2)


def circular(links: DataFrame, proposed: DataFrame, depth: int = 5) -> DataFrame:
    """proposed (src, dst) with circular: whether a walk from dst along links meets src, or is still going after ``depth`` steps.

    Whether a walk can go on that long is known of dst alone, by as many semi-joins back from the links' ends. Of the others
    walks meet in the middle: what dst reaches in the first steps, once for each dst, and what reaches src in the last.
    """
    from tideline.operators.graph import cut

    edges = cut(links.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    deep = edges.select("at").distinct()
    for _ in range(depth - 1):
        deep = cut(edges.join(deep.withColumnRenamed("at", "to"), "to", "left_semi").select("at").distinct())
    pairs = proposed.select("src", "dst").distinct()
    open_ = cut(pairs.join(deep.withColumnRenamed("at", "dst"), "dst", "left_anti"))

    def reached(start: str, here: str, there: str, steps: int) -> DataFrame:
        last = open_.select(start, F.col(start).alias("met")).distinct()
        found = last
        for _ in range(steps):
            last = cut(last.join(edges.select(F.col(here).alias("met"), F.col(there).alias("next")), "met").select(start, F.col("next").alias("met")).distinct())
            found = found.union(last)
        return found.distinct()

    back = depth // 2
    ahead, behind = reached("dst", "at", "to", depth - back), reached("src", "to", "at", back)
    meet = open_.join(ahead, "dst").join(behind, ["src", "met"]).select("src", "dst").distinct()
    found = pairs.join(deep.withColumnRenamed("at", "dst"), "dst", "left_semi").select("src", "dst").union(meet).withColumn("hit", F.lit(True))
    return proposed.join(found, ["src", "dst"], "left").withColumn("circular", F.coalesce("hit", F.lit(False))).drop("hit")


def folder_order(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (project_id, folder, conv_id) with order_index after the folder's last."""
    last = existing.groupBy("project_id", "folder").agg(F.max("order_index").alias("last"))
    w = Window.partitionBy("project_id", "folder").orderBy("conv_id")
    return new.join(last, ["project_id", "folder"], "left").withColumn("order_index", F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).drop("last")


def listed(parents: DataFrame, children: DataFrame, key: str, newest: str, limit: int) -> DataFrame:
    n = children.groupBy(key).agg(F.count("*").alias("n_children"))
    return parents.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).orderBy(F.desc(newest), key).limit(limit)


def decoded(text: Column, schema: str) -> Column:
    """struct(value, text): the parsed JSON, or the text where it doesn't parse."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    fine = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    return F.struct(F.when(fine, value).alias("value"), F.when(~fine, text).alias("text"))


def permitted(user: Column, owner: Column, team: Column, action: Column, permissions: dict = lx.PERMISSIONS) -> Column:
    """The owner may all; else the role in team (array of struct user, role) decides; admin is the owner's alone."""
    role = F.get(F.filter(team, lambda m: m["user"] == user), F.lit(0))["role"]
    allowed = F.create_map(*(x for r, a in permissions.items() for x in (F.lit(r), F.array(*map(F.lit, a)))))[role]
    return (user == owner) | (F.coalesce(F.array_contains(allowed, action), F.lit(False)) & (action != "admin"))


def notifications(comments: DataFrame, most: int = 50) -> DataFrame:
    """user, comment_id: one per mention, each user's newest."""
    each = comments.select(F.explode(F.array_distinct("mentions")).alias("user"), "comment_id", "at")
    w = Window.partitionBy("user").orderBy(F.desc("at"), F.desc("comment_id"))
    return each.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("user", "comment_id")


def without_projects(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the projects in doomed (project_id)."""
    ids = doomed.select("project_id").distinct()
    return {n: df.join(ids, "project_id", "left_anti") for n, df in tables.items()}


def patched(rows: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """rows with the non-null new values of the allowed columns; other columns of changes are ignored."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in allowed if c in changes.columns))
    j = rows.join(new, key, "left")
    return j.withColumns({c: F.coalesce(f"new_{c}", c) for c in allowed if f"new_{c}" in j.columns}).drop(*(f"new_{c}" for c in allowed))
