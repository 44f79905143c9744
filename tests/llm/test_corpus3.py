"""Alignment, nearest neighbours and the manifest against brute force, and odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import alignment, html_text, merkle, nearest
from tideline.llm.vocabulary import default_path

TEXTS = [
    "", None, " ", "a", "Hello world's  end\n\n ok", "don't we'll I'm", "naïve café 中文字符 😀😀  x　y", "x<|endoftext|>y </s> <s> <unk> <0x41>",
    "▁ a piece mark", "tab\t\tnew\r\nline   ", "é" * 300 + " the the the" * 50, "same words here again", "same words here again", "ab" * 5000,
    "\x00\x01 \x85 z", "1234567 67 ½ ²", "Thtion### oneron*** thand%%%", "word " * 30_000,
]


# ---------------------------------------------------------------- 11


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(default_path()), sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    a_tok.encode_special_tokens = True
    bs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in bs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in bs)}

    def piece(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    out, links, counts = [], [], collections.Counter()
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab, bb = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = lambda x: np.cumsum([len(y) for y in x]).tolist()
        ae, be = ends(ab), ends(bb)
        cuts = sorted({*ae} & {*be})
        of = lambda e: next(i for i, c in enumerate(cuts) if e <= c)
        place = {c: i for i, c in enumerate(cuts)}
        groups, k = [[[], []] for _ in cuts], 0
        for side, (ids, end) in enumerate(((a, ae), (b, be))):
            k = 0
            for i, e in zip(ids, end, strict=True):
                groups[k][side].append(str(i))
                k += e in place
        assert of(cuts[0]) == 0
        text = ";".join("|".join(",".join(s) for s in g) for g in groups)
        b_at = dict(zip(be, b, strict=True))
        found = [(i, b_at[e]) for i, e in zip(a, ae, strict=True) if e in b_at]
        counts.update(found)
        links.append(found)
        out.append((len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(*o[:3], len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), o[3]) for o, x in zip(out, links, strict=True)]


def test_alignment(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("n_a", "pair", "linked", "n", "groups_sha256")})
    want = brute_alignment(TEXTS)
    got = {r["doc_id"]: r for r in alignment.align(docs.repartition(3)).collect()}
    for i, w in enumerate(want):
        assert tuple(got[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == w, TEXTS[i]
    assert got[8]["n_a"] == 0 < got[9]["n_a"]
    assert alignment.align(docs.limit(0)).count() == 0
    odd = alignment.align(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["7", "7", "None"] and {r["count_sum"] for r in odd} == {6}


def test_components_are_the_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 300))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), size=int(rng.integers(0, n)), replace=False)) if n > 1 else np.zeros(0, np.int64), n) for _ in range(2))
        got_a, got_b = alignment.components(a, b)
        both = np.intersect1d(a, b)
        assert np.array_equal(got_a, np.searchsorted(both, a)) and np.array_equal(got_b, np.searchsorted(both, b))


def test_every_linked_pair_is_known():
    p = alignment.pair(default_path(), alignment.piece_path())
    assert p.pairs.size < 500_000  # what the counts can take at most
    for a, b in ((p.pairs >> 16)[:1000], (p.pairs & 0xFFFF)[:1000]), ((p.pairs >> 16)[-1000:], (p.pairs & 0xFFFF)[-1000:]):
        for x, y in zip(a, b, strict=True):
            x, y = p.a_bytes.joined(np.array([x])).tobytes(), p.b_bytes.joined(np.array([y])).tobytes()
            assert x.endswith(y) or y.endswith(x)


# ---------------------------------------------------------------- 12


def brute_nearest(ids, x, k, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != ids[i])
        by = others[np.lexsort((ids[others], d[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in by]
    return out


@pytest.mark.parametrize("kind", ["even", "groups", "short", "lopsided"])
def test_nearest(spark, kind):
    rng = np.random.default_rng(5)
    n, dims = 6000, {"short": 5, "lopsided": 90}.get(kind, 64)
    x = rng.normal(size=(n, dims))
    if kind == "groups":  # a third of the rows around one point, others in groups, and exact copies
        x[:2000] = x[0] + 0.05 * x[:2000]
        x[2000:5000] = x[rng.integers(5000, 6000, 3000)] + 0.3 * x[2000:5000]
        x[100:140] = x[100]
    if kind == "lopsided":
        x *= np.geomspace(1, 100, dims)
    ids = np.arange(n)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], "clash", 1) for i in ids], "vec_id long, embedding array<double>, part string, turn int").repartition(5)
    got = collections.defaultdict(list)
    for r in nearest.search(df, part_rows=2000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    want = brute_nearest(ids, x, 10)
    assert got.keys() == want.keys()
    true = {q: dict(v) for q, v in want.items()}
    assert np.mean([len({g[0] for g in got[q]} & true[q].keys()) / 10 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [r[2] for r in rows] == [*range(1, 11)] and [(s, v) for v, s, _ in rows] == sorted((s, v) for v, s, _ in rows)
        for v, s, _ in rows:
            assert v != q and abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 40))
    codes = nearest.learn(x[:1000])
    part = nearest.Part(np.arange(3000), x, codes)
    for q in range(20):
        code, met = part.code[q], np.zeros(3000, bool)
        for s in range(6):
            part.probed(code, s, met)
            assert met[np.bitwise_count(part.code ^ code) <= part.pieces * (s + 1) - 1].all()


def test_nearest_odd_rows(spark):
    v = lambda *x: [None if y is None else float(y) for y in x]
    rows = [(0, v(1, 0)), (1, v(0, 1)), (2, v(1, 1)), (3, None), (4, v(0, 0)), (5, v(None, 1)), (6, v(float("nan"), 1)), (7, v(float("inf"), 1)), (8, v(1, 2, 3)), (None, v(1, 1)), (2, v(1, 1)), (9, []), (100, v(1, 0)), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in nearest.search(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 2, 1.0), (0, 3, 1, 1.414214), (100, 1, 0, 0.0), (100, 2, 2, 1.0), (100, 3, 1, 1.414214)]
    assert nearest.search(df.limit(0)).collect() == [] and nearest.search(df.filter("vec_id = 3")).collect() == []
    assert nearest.search(df.filter("vec_id = 0")).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(30)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in nearest.search(same).orderBy("rank").collect()] == [(i, 0.0) for i in range(1, 11)]


# ---------------------------------------------------------------- 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha(*(field(x) for x in (*r[:4], text)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)

    def tree(level):
        proofs = [[] for _ in level]
        under = [[i] for i in range(len(level))]
        while len(level) > 1:
            for lo in range(0, len(level), 3):
                for i in range(lo, min(lo + 3, len(level))):
                    for leaf_no in under[i]:
                        proofs[leaf_no].append((level[lo:i], level[i + 1 : lo + 3]))
            under = [[x for u in under[lo : lo + 3] for x in u] for lo in range(0, len(level), 3)]
            level = [sha(*level[lo : lo + 3]) for lo in range(0, len(level), 3)]
        return level[0], proofs

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        there = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = there, *tree([leaf(r, r[4]) for r in there])
    root, upper = tree([trees[s][1] for s in order])
    out = []
    for g, s in enumerate(order):
        there, subroot, proofs = trees[s]
        for r, proof in zip(there, proofs, strict=True):
            path = proof + upper[g]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha(*(x for left, right in path for x in left + right)), h, h == root))
    return sorted(out, key=str)


def doc_rows(n, sources, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([f"text {i}", f"line\n{i}\nü", "", None, "x\n" * 3])) for i in range(n)]


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (1, [None]), (3, ["a"]), (4, ["a", "b"]), (90, ["a", "a", "a", "é", "z", None, "", "="]), (5, list("abcde"))])
def test_manifest(spark, n, sources):
    rows = doc_rows(n, sources, n)
    if n == 90:
        rows += [(None, "a", "en", 1, "null\nid"), (7, "a", "en", 1, "again"), (7, "a", "en", 1, "again"), (7, None, None, None, "y" * 300_000 + "\n")]
    if n == 5:
        rows = [(i, s, "en", 1, "t") for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in ("g", "i", "n", "h", "part", "at", "grp", "l", "r")})
    got = sorted((tuple(r[c] for c in MANIFEST) for r in merkle.manifest(df.repartition(3)).collect()), key=str)
    assert got == brute_manifest(rows)


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []


# ---------------------------------------------------------------- 3


def test_links_end_with_their_block(spark):
    """A link that isn't closed takes no text of later blocks with it; one around blocks still covers them."""
    long = "These words belong to the article and go on for long enough to be told from a menu by their number alone."
    pages = [
        f"<article><p>Text <a href=x>link</p><p>{long}</p><p>{long}</p></article>",
        f"<article><ul><li><a href=x>one<li>{long}</ul><p>{long}</p></article>",
        f"<article><p>{long}</p><a href=x><div>{long}</div></a><p>{long}</p></article>",
        "<article><p>" + f"{long} " * 20_000 + "</p></article>",
    ]
    rows = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(i, "http://a/b", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert rows[0].endswith(f"{long}\n\n{long}") and long in rows[1]
    assert [b for _, b, *_ in html_text.blocks(pages[2])][1] < [b for _, b, *_ in html_text.blocks(pages[2])][0]
    assert rows[3] == (f"{long} " * 20_000).strip()
