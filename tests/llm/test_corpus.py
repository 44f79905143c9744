"""Corpus operators against brute force, planted cases and odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import classifier, fingerprints, html_text, near_dedup, quality_rules, substrings, url_filter
from tideline.llm.common import text_chunks

WORDS = [a + b for a in "ka lo mi ne tu ra so vi".split() for b in "ban dor fel gim hus jat kel lom pir".split()]
ODD = [None, "", " \n\t ", "one", "x" * 5000, "same same same", "same same same", "a b c d e f g h i j " * 400, "é ü \x85 字 " * 30]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def table(spark, texts, first=0):
    """With columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", "s", len(t or ""), "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score int")


# ---------------------------------------------------------------- 2


def brute_features(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    rng = random.Random(4)
    clean = [prose(rng, rng.randint(40, 200)) for _ in range(60)]
    junk = [" ".join(f"{w}###" for w in prose(rng, 80).split()) for _ in range(10)]
    loops = [prose(rng, 12) * 9 for _ in range(10)]
    texts = ODD + clean + junk + loops + ["l one two\n" * 6]
    rows = {r["doc_id"]: r for r in quality_rules.judged(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        b = brute_features(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
    kept = {i for i, r in rows.items() if r["kept"]}
    at = len(ODD)
    assert kept >= set(range(at, at + 60))
    assert not kept & set(range(at + 60, at + 80))
    assert quality_rules.judged(table(spark, [])).count() == 0
    assert quality_rules.kept(table(spark, texts)).columns == table(spark, []).columns


def plain_em(patterns):
    """The posterior of every pattern (tuple of votes) to its count, by loops."""
    j, k, c = len(quality_rules.votes()), quality_rules.PRIOR_WEIGHT, range(len(quality_rules.FAMILIES) + 1)
    first = [[quality_rules.prior(i, r) for r in range(j)] for i in c]
    bad, share = first, [quality_rules.SHARE if i else 1 - quality_rules.SHARE * (len(c) - 1) for i in c]

    def shares(v):
        e = [share[i] * math.prod(bad[i][r] if v[r] < 0 else 1 - bad[i][r] for r in range(j) if v[r]) for i in c]
        return [x / sum(e) for x in e]

    for _ in range(quality_rules.ROUNDS):
        q = {v: [n * x for x in shares(v)] for v, n in patterns.items()}
        bad = [[(sum(m[i] for v, m in q.items() if v[r] < 0) + k * first[i][r]) / (sum(m[i] for v, m in q.items() if v[r]) + k) for r in range(j)] for i in c]
        share = [(sum(m[i] for m in q.values()) + 1) / (sum(patterns.values()) + len(c)) for i in c]
    faulty = [i > 0 and np.mean([bad[i][r] for r in quality_rules.FAMILIES[i - 1]]) > quality_rules.FAULT_FROM for i in c]
    return {v: sum(x for x, f in zip(shares(v), faulty) if not f) for v in patterns}


def fitted(spark, patterns):
    rows = quality_rules.posteriors(spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")).collect()
    return {tuple(r["votes"]): r["posterior"] for r in rows}


def drawn(rng, n, share, hit, miss):
    """Vote patterns of n documents; each fault has a share, its rules vote bad at the rate hit, others at miss (by rule)."""
    j, patterns = len(quality_rules.votes()), collections.Counter()
    for _ in range(n):
        fault = rng.choices(range(len(quality_rules.FAMILIES) + 1), [1 - 4 * share, *[share] * 4])[0]
        own = quality_rules.FAMILIES[fault - 1] if fault else ()
        patterns[tuple(0 if rng.random() < 0.1 else -1 if rng.random() < (hit if r in own else miss[r]) else 1 for r in range(j))] += 1
    return patterns


def test_posteriors_equal_plain_em(spark):
    patterns = drawn(random.Random(1), 400, 0.05, 0.8, [0.05] * 10)
    got, want = fitted(spark, patterns), plain_em(patterns)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_votes_are_weighed(spark):
    """One bad vote is outvoted by its family, several aren't, and a rule that only guesses tells nothing."""
    patterns = drawn(random.Random(2), 6000, 0.05, 0.9, [0.02] * 8 + [0.5, 0.02])  # rule 8, of repetition, guesses
    good = [1] * 10
    one, three, guess = list(good), list(good), list(good)
    one[7] = guess[8] = three[5] = three[6] = three[7] = -1
    patterns.update({tuple(x): 1 for x in (one, three, guess, good)})
    got = fitted(spark, patterns)
    assert got[tuple(one)] > 0.5 > got[tuple(three)] and got[tuple(good)] > 0.99 and got[tuple(guess)] > 0.99


def test_kept_is_not_all_must_pass(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    fired = F.exists(F.array(*quality_rules.votes()), lambda v: v < 0)
    rows = quality_rules.judged(docs).join(quality_rules.features(docs).select("doc_id", fired.alias("fired")), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    assert any(r["fired"] and r["posterior"] >= 0.5 for r in rows) and any(r["fired"] and r["posterior"] < 0.5 for r in rows)
    known = [r for r in rows if r["quality"] is not None and not r["base_failed"]]
    assert len(known) > 200 and np.mean([r["kept"] == (r["quality"] == 1) for r in known]) > 0.99


# ---------------------------------------------------------------- 3

PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head&amp;line</h1><p>First  para\n with <b>bold</b> text.<p>Second.<br>Line</article><footer>&copy; us</footer>", "Head&line\n\nFirst para with bold text.\n\nSecond. Line"),
    ("", ""), (None, ""), ("just words", "just words"), ("<p>Yes.</p>", "Yes."), ("<body><h1>Title</h1><p>One two three.</p><p>No.</p></body>", "Title\n\nOne two three.\n\nNo."), ("<p>", ""),
    ('<body><div class="cookie-notice">We use cookies to serve you better each and every day</div><main><p>The main text goes on for a good number of words here.</p><script>var a="</p>";</script></main><div id="comments"><p>Great post, I have to say that I liked it a lot</p></div><aside class="sidebar"><p>Related things that you may like to read as well</p></aside></body>', "The main text goes on for a good number of words here."),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>a<!-- x <p>never</p>", "a"), ("<article><form><p>Sign up with your mail address now</p></form><p>Text</p></article>", "Text"),
]


def test_main_text(spark):
    rows = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    for i, (h, want) in enumerate(PAGES):
        assert got[i]["text"] == want, h
        assert got[i]["n_chars"] == len(got[i]["text"])


def hard_page(rng):
    """A page whose blocks can't all be told by themselves, and its main text."""
    said = lambda lo, hi: prose(rng, rng.randint(lo, hi))
    link = lambda n: f'<a href="/x">{prose(rng, n)}</a>'
    text, parts = [], []
    for kind in [0, *rng.choices([0, 1, 2, 3, 4, 5], [5, 2, 2, 2, 1, 1], k=8), 0]:
        x = said(3, 60)
        if kind == 0:
            parts.append(f"<p>{x}</p>")
        elif kind == 1:  # a paragraph that is a link, in the run of the text
            parts.append(f'<p><a href="/y">{x}</a></p>')
        elif kind == 2:  # a paragraph whose class sounds like boilerplate
            parts.append(f'<p class="{rng.choice(["search-results", "notice", "related", "copyright"])}">{x}</p>')
        elif kind == 3:  # a box within the text
            x = None
            parts.append(f'<div class="{rng.choice(["ad", "newsletter", "promo"])}"><p>{said(5, 90)}</p></div>')
        elif kind == 4:
            x = None
            parts.append("<ul>" + "".join(f"<li>{link(rng.randint(1, 6))}</li>" for _ in range(rng.randint(3, 7))) + "</ul>")
        else:
            parts.append(f"<h2>{x}</h2>")
        if x:
            text.append(x)
        if kind == 3 or kind == 4:  # text goes on after a box
            text.append(said(3, 60))
            parts.append(f"<p>{text[-1]}</p>")
    before = f'<nav><ul>{"".join(f"<li>{link(2)}</li>" for _ in range(5))}</ul><p>{said(5, 40)}</p></nav><div class="cookie-notice"><p>{said(10, 90)}</p></div>'
    after = f'<section id="comments">{"".join(f"<div><p>{said(5, 60)}</p></div>" for _ in range(3))}</section><footer><p>{said(5, 60)}</p></footer>'
    return f"<html><body>{before}<article>{''.join(parts)}</article>{after}</body></html>", text


def test_the_cut_decides():
    """Labels of the cut are better than those of the costs alone."""
    rng = random.Random(13)
    changed = total = 0
    score = {"cut": [0, 0, 0], "alone": [0, 0, 0]}  # found, kept, true
    for _ in range(200):
        page, text = hard_page(rng)
        found = html_text.blocks(page)
        cut, alone = html_text.labelled(found), [s > 0 for _, s, _ in found]
        changed += sum(a != b for a, b in zip(cut, alone, strict=True))
        total += len(found)
        for name, side in (("cut", cut), ("alone", alone)):
            kept = collections.Counter(t for (t, _, _), k in zip(found, side, strict=True) if k)
            for i, n in enumerate(((kept & collections.Counter(text)).total(), kept.total(), len(text))):
                score[name][i] += n
    f1 = {name: 2 * hit / (kept + true) for name, (hit, kept, true) in score.items()}
    print("labels changed by the cut", changed, "of", total, f1)
    assert changed > 0.03 * total and f1["cut"] > 0.96 and f1["cut"] > f1["alone"] + 0.05


def test_extract_equals_the_least_cut_of_all(spark):
    """extract() against all labellings of pages of few blocks."""
    rng = random.Random(14)
    pages = []
    while len(pages) < 25:
        page, _ = hard_page(rng)
        page = page[page.index("<article>") : page.index("</article>")]
        if 1 < len(html_text.blocks(page)) <= 12:
            pages.append(page)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))).collect()}
    for i, page in enumerate(pages):
        found = html_text.blocks(page)
        last, edges = {}, [(k, k + 1, html_text.ADJACENT) for k in range(len(found) - 1)]
        for k, (_, _, parent) in enumerate(found):
            if parent in last:
                edges.append((last[parent], k, html_text.SIBLING))
            last[parent] = k
        cost = lambda m: sum(abs(s) for k, (_, s, _) in enumerate(found) if (s > 0) != bool(m >> k & 1)) + sum(w for a, b, w in edges if (m >> a & 1) != (m >> b & 1))  # noqa: B023, E731
        best = min(range(1 << len(found)), key=cost)
        assert got[i] == "\n\n".join(t for k, (t, _, _) in enumerate(found) if best >> k & 1)
    odd = html_text.extract(spark.createDataFrame([(None, None, "<p>a b</p>"), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in odd) == ["", "", "a b"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        score = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a) if rng.random() < 0.5}
        cost = lambda side: sum(abs(s) for s, x in zip(score, side) if (s > 0) != x) + sum(w for (a, b), w in edges.items() if side[a] != side[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.minimum_cut(score, edges)) - best) < 1e-9


# ---------------------------------------------------------------- 4


def listed(fingerprint):
    """The digests that a fingerprint's cells peel to."""
    out = set()
    for block in fingerprint.split(":")[1:]:
        cells = [int(x, 16) for x in block.split(",")]
        assert len(cells) % 18 == 0  # none of these is listed
        for s in range(0, len(cells), 18):
            part = cells[s : s + 18]
            while any(part):
                k = next(c for c in part if c and checked(c) == c)
                out.add(k)
                for i in range(3):
                    part[6 * i + (k >> (9 * i + 36)) % 6] ^= k
    return out


def checked(c):
    high = c & ~0xFFFFFF
    signed = high - (1 << 64) if high >> 63 else high
    return high | xxhash.xxh64_intdigest(signed.to_bytes(8, "little", signed=True), 42) & 0xFFFFFF


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = ODD + ["\n".join(prose(rng, 12) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    texts += [texts[-1], texts[-1] + "\nmore text"]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(table(spark, texts)).collect()}

    def pieces(t):
        cut = [x for p in t.split("\n") for x in (re.split(r"(?<=[.!?])[ \t]+", p) if len(p) > 400 else [p])]
        return {x for x in cut if x.strip(" \t\r\x0b\x0c")}

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - like(pieces(t), pieces(edited))) < 1e-9
        assert abs(got[i]["near_next"] - like(pieces(t), pieces(after))) < 1e-9
        for other, near in ((got[i]["edited_fingerprint"], "near_edited"), (got[(i + 1) % len(texts)]["fingerprint"], "near_next")):
            a, b = listed(got[i]["fingerprint"]), listed(other)  # of the strings alone
            assert abs(got[i][near] - like(a, b)) < 1e-9
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[0]["fingerprint"] == got[1]["fingerprint"] != got[3]["fingerprint"]
    assert fingerprints.fingerprints(table(spark, ["only one"])).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(table(spark, [])).count() == 0


# ---------------------------------------------------------------- 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(6)
    for _ in range(4000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randint(0, 3) for _ in range(rng.randint(0, 3))]
        most = rng.randint(0, 8)
        assert near_dedup.within(a, b, most) == (edits(a, b) <= most)


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(25)]
    texts = list(base)
    for i in range(10):  # three near copies of each of the first ten
        for _ in range(3):
            w = base[i].split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w[:-1] + ["end."]))
    hub = prose(rng, 120).split()
    big = [" ".join(x if k != j % 120 else f"n{j}" for k, x in enumerate(hub)) for j in range(60)]  # a group over SMALL_GROUP
    texts += big + [base[3], base[3]] + ODD
    rows = near_dedup.classes(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    of = {r["doc_id"]: r["class_id"] for r in rows}
    for i in range(10):
        assert {of[25 + 3 * i + j] for j in range(3)} == {of[i]} == {i}
    assert len({of[55 + j] for j in range(60)}) == 1
    assert of[115] == of[116] == 3
    assert len({of[i] for i in range(25)}) == 25
    odd = 117
    assert of[odd] == of[odd + 1] == odd and of[odd + 2] == odd + 2 and of[odd + 6] == odd + 5
    assert sum(r["kept"] for r in rows) == len(set(of.values()))
    kept = near_dedup.deduplicated(table(spark, texts))
    assert kept.count() == len(set(of.values())) and kept.columns == table(spark, []).columns
    assert near_dedup.classes(table(spark, [])).count() == 0
    null = table(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["class_id"] for r in near_dedup.classes(null.union(table(spark, ["a b"]))).orderBy("class_id").collect()] == [None, 0]


def test_recall_at_the_threshold(spark):
    """Pairs of texts of which a fifth of the words was changed at random places: nine of ten are found at least."""
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(150):
        w = [word() for _ in range(200)]
        other = list(w)
        for k in rng.sample(range(200), 40):
            other[k] = word()
        texts += [" ".join(w), " ".join(other)]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table(spark, texts)).collect()}
    assert sum(of[i] == of[i + 1] for i in range(0, 300, 2)) >= 0.9 * 150
    assert all(of[i] in (i, i - 1) for i in of)


def brute_classes(texts, meet):
    """Least index of every text's component under word edits, of the pairs that meet."""
    of = list(range(len(texts)))
    find = lambda x: x if of[x] == x else find(of[x])
    w = [t.split() for t in texts]
    for i in range(len(w)):
        for j in range(i):
            most = int(0.2 * max(len(w[i]), len(w[j])) + 1e-9)
            if find(i) != find(j) and meet(i, j) and near_dedup.within(w[i], w[j], most):
                a, b = sorted((find(i), find(j)))
                of[b] = a
    return [find(i) for i in range(len(w))]


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Copies with 2 to 18 of 100 words changed, two families that one text links, and a passage that many texts share."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(10**6)}"

    def changed(w, n):
        out = list(w)
        for k in rng.sample(range(len(w)), n):
            out[k] = word()
        return " ".join(out)

    hub = [word() for _ in range(100)]
    texts = [changed(hub, rng.randint(2, 18)) for _ in range(300)]
    far = hub[:70] + [word() for _ in range(30)]  # 30 words from the hub
    texts += [changed(far, rng.randint(0, 3)) for _ in range(60)] + [" ".join(hub[:85] + far[85:])]
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(60)]) for _ in range(150)]
    compared = []
    plain = near_dedup.verified

    def counted(pairs, bodies):
        compared.append(pairs.count())
        return plain(pairs, bodies)

    monkeypatch.setattr(near_dedup, "verified", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table(spark, texts)).collect()}
    want = brute_classes(texts, lambda i, j: True)
    assert [got[i] for i in range(len(texts))] == want
    assert len({want[i] for i in range(361)}) == 1 and len(set(want[361:])) == 150
    assert sum(compared) < 12 * len(texts), compared  # all pairs: 130,000


def test_texts_meet_in_one_of_the_groups_that_they_share(spark):
    rows = spark.createDataFrame([(g, i, 100, 0, 0, 0, 0) for g in range(12) for i in range(30)], "group long, id long, n_words long, p0 long, p1 long, p2 long, p3 long")
    members = near_dedup.grouped(rows).withColumns({"label": F.col("id"), "pivot": F.lit(True)})
    assert near_dedup.met(members).count() == near_dedup.met(members).distinct().count() == 30 * 29 // 2  # in every group: 12 times as many
    # A shared group that is no longer among the last ones still leaves the meeting in the first.
    rows = spark.createDataFrame([(g, i, 100, 0, 0, 0, 0) for i in range(2) for g in (0, 100, *range(1 + i, 90, 2))], "group long, id long, n_words long, p0 long, p1 long, p2 long, p3 long")
    rows = rows.unionByName(rows.filter("group > 0 and group < 100").withColumn("id", F.col("id") + 2))
    found = near_dedup.met(near_dedup.grouped(rows).withColumns({"label": F.col("id"), "pivot": F.lit(True)}))
    assert {tuple(r) for r in found.collect()} == {(0, 1), (0, 2), (1, 3)}


def joins(df):
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]


def test_only_texts_that_are_wanted_are_shuffled(spark):
    docs = table(spark, [f"text {i}" for i in range(50)])
    wanted = near_dedup._rows(docs).filter("doc_id % 10 = 0").select("doc_id", "id")
    found = near_dedup.bodies(docs, wanted.union(wanted))
    # Filters by the bitmap stand below the join.
    assert "getbit" not in joins(found)[0] and sum("__bucket" in j for j in joins(found)) == 1
    assert {r["id"] for r in found.collect()} == {r["id"] for r in wanted.collect()} and found.count() == 5
    # Texts without a passage to cut don't take part in the join with the cuts.
    assert sum("__doc" in j for j in joins(substrings.without_passages(docs))) == 1


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_no_text_is_shuffled_for_its_words(spark):
    """Only what tells the bitmap is; copies under other ids and repeated rows don't come twice."""
    docs = table(spark, [f"text {i % 25}" for i in range(50)])
    wanted = near_dedup._rows(docs).filter("doc_id < 25").select("doc_id", "id")
    assert not [e for e in exchanges(near_dedup.bodies(docs, wanted)) if re.search(r"\bid#|doc_id#", e)]
    for rows, ids in ((docs, wanted), (docs.union(docs), wanted), (docs, near_dedup._rows(docs).select("doc_id", "id"))):
        found = near_dedup.wanted_bodies(rows, ids).collect()
        assert len(found) == len({r["id"] for r in found}) == 25


def test_rows_that_are_alone_are_not_shuffled_whole(spark):
    rows = spark.createDataFrame([(g, i, 100, 0, 0, 0, 0) for i in range(40) for g in (i // 2, 1000 + i)], "group long, id long, n_words long, p0 long, p1 long, p2 long, p3 long")
    found = near_dedup.grouped(rows)
    assert sum("__bucket" in j for j in joins(found)) == 1
    assert sorted((r["group"], r["id"], r["n"], r["weight"]) for r in found.collect()) == [(i // 2, i, 2, 2) for i in range(40)]


def test_small_groups_are_paired_at_once(spark):
    rows = spark.createDataFrame([(g, 100 * g + i, 100, 0, 0, 0, 0) for g in range(3) for i in range(40)], "group long, id long, n_words long, p0 long, p1 long, p2 long, p3 long")
    members = near_dedup.grouped(rows).withColumns({"label": F.col("id"), "open": F.lit(True)})
    pairs, rest = near_dedup.candidates(members, near_dedup.MAIN, near_dedup.OTHERS)
    assert pairs.count() == 3 * 40 * 39 // 2 and rest.count() == 0


def test_one_id_with_several_texts(spark):
    a, b = ("one two three four five six seven eight nine ten", "quite another text of as many words as that one")
    rows = table(spark, [a, b, a, a]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 5).when(F.col("doc_id") == 2, 4).otherwise(4))
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in near_dedup.classes(rows).collect())
    assert got == [(4, 4, True), (4, 4, True), (5, 4, False), (5, 5, True)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.deduplicated(rows).collect()) == [(4, a), (5, b)]


# ---------------------------------------------------------------- 1


def test_compact_windows_equal_the_tree():
    rng = np.random.default_rng(8)
    for least in (1, 3, 5):
        values = (rng.permutation(40).astype(np.uint64) + np.uint64(1)) << np.uint64(30)
        left, at, right = substrings.compact_windows(values, np.array([0, 13]), np.array([13, 40]), least)
        want = set()
        for lo, hi in ((0, 13), (13, 40)):
            for c in range(lo, hi):
                a, b = c, c
                while a > lo and values[a - 1] > values[c]:
                    a -= 1
                while b < hi - 1 and values[b + 1] > values[c]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((a, c, b))
        assert set(zip(left.tolist(), at.tolist(), right.tolist())) == want


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    near = passage.split()
    near[30] = "other"
    short = prose(rng, 40)
    texts = [prose(rng, 80) + " " + passage + " " + prose(rng, 30), prose(rng, 90) + " " + passage, passage + " " + prose(rng, 700), prose(rng, 50) + " " + " ".join(near)]
    texts += [short + " " + prose(rng, 60), prose(rng, 60) + " " + short, prose(rng, 300), *ODD]
    rows = substrings.passages(table(spark, texts)).collect()
    found = {(r["doc_id"], r["source_id"]): r for r in rows}
    assert set(found) == {(1, 0), (2, 0), (3, 0)}
    for doc, start in ((1, 90), (2, 0), (3, 50)):
        r = found[(doc, 0)]
        assert abs(r["start"] - start) <= 4 and 52 <= r["n_words"] <= 70 and abs(r["source_start"] - 80) <= 4
    left = {r["doc_id"]: r for r in substrings.without_passages(table(spark, texts)).collect()}
    assert left[0]["text"] == texts[0] and left[6]["text"] == texts[6] and left[0]["key"] == "k"
    assert len(left[1]["text"].split()) < 100 and left[1]["n_chars"] == len(left[1]["text"])
    assert len(left) == len(texts)
    assert substrings.passages(table(spark, [])).count() == 0


def covered(texts, least=50):
    """Words of each text in a stretch of least words that also stands in an earlier one, word by word."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        out.append({k for i, g in enumerate(grams) if g in seen for k in range(i, i + least)})
        seen.update(grams)
    return out


def caught(spark, texts, words):
    """Share of the words of each text (sets of places) that passages() lists."""
    got = collections.defaultdict(set)
    for r in substrings.passages(table(spark, texts)).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    return [len(w & got[i]) / len(w) for i, w in enumerate(words) if w]


def test_rows_travel_by_part(spark):
    """Rows of a part come back whole and as they were, also where a part goes on in the next batch; a row holds many windows."""
    rng = np.random.default_rng(4)
    sizes = (8, 4, 1)
    rows = [rng.integers(-(2**63), 2**63, 5000), rng.integers(0, 2**32, 5000), rng.integers(0, 256, 5000)]
    part = rng.integers(0, 7, 5000)
    sent = pa.Table.from_batches([b for lo in range(0, 5000, 1000) for b in substrings.dealt([(part[lo : lo + 1000], *(r[lo : lo + 1000] for r in rows))], sizes)])
    assert sent.num_rows == 35
    got = list(substrings.gathered(sent.sort_by("part").to_batches(4), sizes))
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*got, strict=True)))) == sorted(zip(*(r.tolist() for r in rows)))
    of = dict(zip(zip(*(r.tolist() for r in rows)), part.tolist()))
    seen = [{of[k] for k in zip(*(x.tolist() for x in piece))} for piece in got]
    assert sum(len(s) for s in seen) == 7  # no part comes in two pieces
    words = random.Random(3)
    docs = table(spark, [prose(words, 2000) for _ in range(60)]).repartition(1)
    held = substrings.windows(docs)
    moved, there = held.agg(F.count("*"), F.sum(F.length("b0"))).first()
    assert there > 3 * moved
    assert substrings.stretches(substrings.meetings(held)).count() == 0


def test_decoys_hide_no_passage(spark):
    rng = random.Random(10)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    decoys, texts = [], []
    for part, whole in [(40, 60), (20, 60), (40, 80)] * 20:  # the first documents hold a part of the passage of two later ones
        passage = word(whole)
        at = rng.randrange(whole - part + 1)
        decoys.append(" ".join(word(60) + passage[at : at + part] + word(60)))
        texts += [" ".join(word(rng.randrange(30, 90)) + passage + word(60)) for _ in range(2)]
    twice = word(40)  # one sentence stands in very many documents, twice in some, and in three of them as part of a passage
    decoys += [" ".join(word(60) + twice + word(60) + (twice + word(20) if i % 3 == 0 else [])) for i in range(60)]
    longer = twice + word(30)
    texts += [" ".join(word(50) + longer + word(50)) for _ in range(3)]
    both = decoys + texts
    shares = caught(spark, both, covered(both))
    assert len(shares) == 62 and min(shares) > 0.8
    hidden = {r["doc_id"] for r in substrings.passages(table(spark, both)).collect()}
    assert hidden == {i for i, w in enumerate(covered(both)) if w}


def test_edited_passages_are_found(spark):
    """Passages of 50 words or more of which 0.8 of the shingles or more stand in the source."""
    rng = random.Random(12)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sources, texts, places = [], [], []
    while len(texts) < 150:
        passage = word(rng.choice([50, 55, 60, 100]))
        near = list(passage)
        for _ in range(rng.randint(1, max(1, len(near) // 25))):
            k = rng.randrange(1, len(near) - 1)
            near[k : k + rng.randrange(2)] = word(rng.randrange(2))
        known = set(grams(passage))
        hit = [g in known for g in grams(near)]
        if len(near) >= 50 and sum(hit) >= 0.8 * len(hit) and hit[0] and hit[-1] and not all(hit):
            sources.append(" ".join(word(60) + passage + word(60)))
            texts.append(" ".join(word(60) + near + word(60)))
            places.append(set(range(60, 60 + len(near))))
    shares = caught(spark, sources + texts, [set()] * len(sources) + places)
    assert sum(s >= 0.8 for s in shares) >= 149


# ---------------------------------------------------------------- 6


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    out = classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 50 and np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.97
    model = classifier.train(docs, labels, sample=200)
    odd = {r["doc_id"]: r["score"] for r in classifier.score(table(spark, ODD), model).collect()}
    assert len(odd) == len(ODD) and all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1] and odd[5] == odd[6]
    none = classifier.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in classifier.score(table(spark, ["a", None]), none).collect()} == {0.5}
    assert classifier.accepted(table(spark, ODD), labels.limit(0)).count() == 0


def test_attention_gradient(monkeypatch):
    """One step of the optimiser goes down the gradient that finite differences give."""
    rng = np.random.default_rng(0)
    x, base, y = rng.normal(size=(12, classifier.WIDTH)), np.array([0, 3, 4, 9, 12]), np.array([1.0, 0, 1, 0])
    fitted = classifier.fit(x, base, y)
    f = classifier.forward(fitted, x, base)
    assert np.allclose(np.add.reduceat(f["a"], base[:-1]), 1)
    assert np.all((f["score"] > 0.5) == (y == 1))
    monkeypatch.setattr(classifier, "EPOCHS", 0)
    model = classifier.fit(x, base, y, seed=1)
    model["c"] = rng.normal(size=classifier.HIDDEN)

    def loss(m):
        p = classifier.forward(m, x, base)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = classifier.gradients(model, x, base, y)
    for name in ("W", "b", "V", "U", "w", "c", "d"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in model[name].shape)
            up, down = ({**model, name: model[name].copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - got[name][at]) < 1e-6, name


def test_scores_ignore_neighbours():
    """Features of a text are the same alone, beside others, and in any order."""
    def features(texts):
        out = []
        for lo, hi, data, ends in text_chunks(pa.array(texts)):
            x, base = classifier.encode(data, ends)
            out += [x[base[i] : base[i + 1]] for i in range(hi - lo)]
        return out

    texts = ["abc def ghi", "      x y", "", " \n", None, "w " * 1000, "x" * 600_000 + " b c", "é ü " * 90, "lorem ipsum " * 70_000]
    together, reverse = features(texts), features(texts[::-1])[::-1]
    for t, a, b in zip(texts, together, reverse, strict=True):
        assert np.allclose(a, features([t])[0]) and np.allclose(a, b)


# ---------------------------------------------------------------- 8


def test_urls(spark):
    urls = ["http://A.example.NET/en/x?q#f", "http://example.net", "https://b.example.com/de/1", "http://c.org/fr/", "http://bad.site.org/x", "nothing", None, "http://net/x", "x://h?/p", "http://xexample.net/en/"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)] + [(100 + i, "http://bad.site.org/y", "k") for i in range(60)] + [(1000 + i, f"http://good{i % 9}.test/y", "k") for i in range(600)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(i, 1) for i in (*range(4), *range(1000, 1600))] + [(3, None), (None, 0)], "doc_id long, quality int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    want = {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"), 2: ("b.example.com", "/de/1", "example.com/de/", "block"), 3: ("c.org", "/fr/", "org/fr/", "allow"),
            4: ("bad.site.org", "/x", None, "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net", "/x", "net/", "block"), 8: ("h", "", None, "allow"), 9: ("xexample.net", "/en/", "net/", "block")}
    for i, w in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == w, i
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    twice = url_filter.judge(pages.limit(1).union(pages.limit(1)).withColumn("page_id", F.lit(None).cast("long")), labels).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_registered_domains(spark):
    hosts = {"www.bbc.co.uk": ("bbc.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.example.com:8080": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "x.notco.uk": ("notco.uk", "uk")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *(c.alias(n) for c, n in zip(url_filter.levels(F.col("host")), ("domain", "suffix"))))
    assert {r["host"]: (r["domain"], r["suffix"]) for r in rows.collect()} == hosts
    # One bad site under co.uk doesn't make others of that suffix bad.
    outcomes = spark.createDataFrame([("bad.co.uk", 80, 80), *((f"good{i}.co.uk", 20, 0) for i in range(20)), ("new.co.uk", 0, 0)], "host string, n long, bad long")
    bound = {r["host"]: r["bound"] for r in url_filter.reputations(outcomes).collect()}
    assert bound["bad.co.uk"] > 0.5 > bound["new.co.uk"]


# ---------------------------------------------------------------- odd rows


def test_null_ids_and_empty_tables(spark):
    docs = table(spark, ["a b c d", "a b c d", None, "x " * 300_000]).withColumn("doc_id", F.when(F.col("doc_id") == 3, 3).cast("long"))
    none = table(spark, [])
    labels = spark.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality_rules.judged(docs).count() == 4 and quality_rules.kept(none).count() == 0
    assert fingerprints.fingerprints(docs).count() == 4
    assert classifier.classify(docs, labels).count() == 4 and classifier.classify(none, labels).count() == 0
    assert substrings.passages(docs).count() == 0 and substrings.without_passages(none).count() == 0
    assert near_dedup.deduplicated(none).count() == 0 and near_dedup.deduplicated(docs).count() == 4


def test_passages_of_repeated_ids(spark):
    rng = random.Random(21)
    passage = prose(rng, 70)
    a, b, c = (prose(rng, 60) + " " + passage for _ in range(3))
    rows = table(spark, [a, b, b, c]).withColumn("doc_id", F.when(F.col("doc_id") > 0, 5).otherwise(1).cast("long"))
    found = substrings.passages(rows).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(5, 1)} and len(found) == 1
    left = [r["text"] for r in substrings.without_passages(rows).collect()]
    assert len(left) == 4 and sum(passage in t for t in left) in (2, 3)  # of one id only its least text is cut


# ---------------------------------------------------------------- pipeline


def test_stages_take_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", None), (10**12, " ", "en", "s", 1)], real.schema)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, real.limit(0)):
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packing":
                assert out.columns == real.columns and len(rows) <= docs.count(), name



def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"] for r in rows} < {r["doc_id"] for r in docs.select("doc_id").collect()}
    per = collections.defaultdict(int)
    for r in rows:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns and 0 < after.count() <= kept.count(), name
        path = str(tmp_path / name.replace(" ", "_"))
        after.write.parquet(path)
        kept = spark.read.parquet(path)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows}
