"""Operator 8: URL rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted by host; each level's bad rate is shrunk toward its parent's (host to registered domain
to suffix to all) by a beta-binomial prior whose strength is found by moments. A host is blocked if the lower bound of its
posterior bad rate exceeds the threshold; the bound is the beta posterior's mean less 1.645 of its standard deviations (its
normal approximation). Explicit rules come first; the longest that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import staged

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
THRESHOLD, Z = 0.5, 1.645
#: Suffixes of several labels under which domains are registered; any other host's suffix is its last label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.in", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr")
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 200.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_labels(h: Column, suffixes=SUFFIXES) -> Column:
    """How many labels of a host without port are its suffix."""
    n = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        n = F.when(F.substring_index(h, ".", -k).isin(*(s for s in suffixes if s.count(".") + 1 == k)), k).otherwise(n)
    return n


def levels(h: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host; a port belongs to neither."""
    bare = F.regexp_replace(h, ":[0-9]*$", "")
    labels, n = F.split(bare, r"\."), suffix_labels(bare, suffixes)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return last(n + 1), last(n)


def matched(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def reputations(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, bad, rate, bound from rows (host, n, bad), one per host: rate is the posterior mean, bound its lower bound.

    A level whose groups show no more spread than chance gets the strongest prior. Hosts without labels take their domain's
    rate. The three strengths and the overall rate are single numbers; the counts stay distributed.
    """
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = staged(outcomes.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")))  # counted once
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 0.5) / (n + 1.0)

    def strength(level: DataFrame) -> float:
        rate = F.col("bad") / F.col("n")
        spread, chance = level.filter("n > 0").agg(F.avg((rate - overall) * (rate - overall)), F.avg(overall * (1 - overall) / F.col("n"))).first()
        extra = (spread or 0.0) - (chance or 0.0)
        return STRONGEST if extra <= 0 else min(STRONGEST, max(WEAKEST, overall * (1 - overall) / extra - 1))

    a, b, c = strength(suffixes), strength(domains), strength(hosts)
    suffixes = suffixes.select("suffix", ((F.col("bad") + a * overall) / (F.col("n") + a)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + b * F.col("suffix_rate")) / (F.col("n") + b)).alias("domain_rate"))
    total, rate = F.col("n") + c, (F.col("bad") + c * F.col("domain_rate")) / (F.col("n") + c)
    return hosts.join(domains, "domain").select("host", "n", "bad", rate.alias("rate"), (rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    labels (doc_id, quality) tell the outcome of the page with that page_id: quality 0 is bad; null or absent is no outcome,
    and of several the worst counts. Null urls, and those without ://, have an empty host and path, fit no rule, and share
    the reputation of the empty host. Repeated rows are each judged; a null page_id has no outcome; an empty table gives
    none; other columns are ignored; urls of any length are taken whole.
    """
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    worst = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).cast("long").alias("bad"))
    counts = p.join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = reputations(counts, suffixes).filter(F.col("bound") > THRESHOLD).select("host", F.lit("block").alias("reputation"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return p.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("reputation"), F.lit("allow")).alias("verdict"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
w AS (SELECT doc_id, CASE WHEN min(quality) = 0 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS lab, count(w.bad) AS n, coalesce(sum(w.bad), 0) AS bad
       FROM p LEFT JOIN w ON p.page_id = w.doc_id GROUP BY host),
h1 AS (SELECT *, CASE WHEN array_to_string(list_slice(lab, -2, -1), '.') IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au',
       'co.in', 'co.jp', 'co.nz', 'co.za', 'com.br', 'com.cn', 'com.mx', 'com.tr') THEN 2 ELSE 1 END AS k FROM h0),
h AS (SELECT host, n, bad, array_to_string(list_slice(lab, -k - 1, -1), '.') AS dom, array_to_string(list_slice(lab, -k, -1), '.') AS suf FROM h1),
d AS (SELECT suf, dom, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suf, dom),
s AS (SELECT suf, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suf),
o AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0)::DOUBLE AS m FROM s),
x AS (SELECT 's' AS lvl, n, bad FROM s UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h),
e AS (SELECT lvl, avg((bad / n::DOUBLE - m) * (bad / n::DOUBLE - m)) - avg(m * (1 - m) / n) AS extra, any_value(m) AS m FROM x, o WHERE n > 0 GROUP BY lvl),
k AS (SELECT lvl, CASE WHEN extra <= 0 THEN 200.0 ELSE least(200.0, greatest(2.0, m * (1 - m) / extra - 1)) END AS k FROM e),
kk AS (SELECT m, coalesce((SELECT k FROM k WHERE lvl = 's'), 200.0) AS a, coalesce((SELECT k FROM k WHERE lvl = 'd'), 200.0) AS b, coalesce((SELECT k FROM k WHERE lvl = 'h'), 200.0) AS c FROM o),
sr AS (SELECT suf, (bad + a * m) / (n + a) AS r FROM s, kk),
dr AS (SELECT dom, (bad + b * r) / (n + b) AS r FROM d JOIN sr USING (suf), kk),
hr AS (SELECT host, (bad + c * r) / (n + c) AS rate, n + c AS total FROM h JOIN dr USING (dom), kk),
bl AS (SELECT host FROM hr WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5),
j AS (SELECT page_id, host, path,
        (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS r1,
        (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS r2,
        (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS r3,
        (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS r4 FROM p)
SELECT page_id, host, path,
  CASE WHEN r1 THEN 'example.net/en/' WHEN r2 THEN 'example.com/de/' WHEN r3 THEN 'org/fr/' WHEN r4 THEN 'net/' END AS rule,
  CASE WHEN r1 THEN 'allow' WHEN r2 THEN 'block' WHEN r3 THEN 'allow' WHEN r4 THEN 'block'
       WHEN host IN (SELECT host FROM bl) THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
