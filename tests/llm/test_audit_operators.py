import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import divergence, spelling, topk

DOCS = "doc_id long, text string, lang string, source string, term string, p long"


def far_by_hand(docs, least):
    """Every group with every kept term, in Python's whole numbers."""
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(lang or "", source or "", cut(text)) for _, text, lang, source, *_ in docs]
    df = Counter((lang, w) for lang, _, words in rows for w in set(words))
    kept, here, groups = defaultdict(list), defaultdict(Counter), defaultdict(set)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)
    for lang, source, words in rows:
        groups[lang].add(source)
        for w in words:
            if df[lang, w] >= least:
                here[lang, source][w] += 1
                here[lang, None][w] += 1
    out = set()

    def ranked(lang, source, part, items):
        for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
            if part == "pair" or i <= 50:
                out.add((lang, source, part, item, value, i))

    for lang in groups:
        v = len(kept[lang])
        p = {s: {w: 1 + 10**9 * (here[lang, s][w] + 5) // (sum(here[lang, s].values()) + 5 * v) for w in kept[lang]} for s in [*groups[lang], None]}
        for s in groups[lang]:
            ranked(lang, s, "pair", [(o, sum(abs(p[s][w] - p[o][w]) for w in kept[lang])) for o in groups[lang] if o != s])
            ranked(lang, s, "term", [(w, p[s][w] - p[None][w]) for w in kept[lang] if here[lang, s][w] and p[s][w] > p[None][w]])
    return out


@pytest.mark.parametrize(("vocabulary", "bundle"), [(1 << 20, 1 << 20), (0, 300)])
def test_divergence(spark, vocabulary, bundle, monkeypatch):
    rng = random.Random(3)
    words = ["Straße", "é", "the", "The", "a", "b", "日本", "ab-c", "x9y", " ", "𝒳", "ZZ", *(f"w{chr(97 + i)}" for i in range(60))]
    docs = [(i, " ".join(rng.choice(words[: 12 + 3 * (i % 17)]) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "S", None]), "clash", 0) for i in range(150)]
    docs += [(None, None, "en", "silent", "", 0), (1, "", "fr", "x", "", 0), (1, "a b", "fr", "y", "", 0), (2, "the " * 5000, "en", "s1", "", 0)] + [docs[0]] * 7
    monkeypatch.setattr(divergence, "PAIRS", 5)
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = divergence.divergence(df, min_documents=4, vocabulary=vocabulary, bundle=bundle).collect()
    want = far_by_hand(docs, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert divergence.divergence(df.filter(F.lit(False)), vocabulary=vocabulary).count() == 0


def test_shares_are_exact(spark):
    rows = [(10**12, 10**13, 10**9), (0, 0, 3), (0, 5, 0), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) if t + 5 * v else None for n, t, v in rows]


def test_postings_of_long_lists(spark):
    """A term's postings that come in several batches are one list."""
    rng = random.Random(4)
    nodes = [(i, "l", 40, rng.randrange(100)) for i in range(60)]
    shares = [("l", f"t{t}", node, rng.randrange(100, 500), zero) for t in range(40) for node, _, _, zero in nodes if rng.random() < 0.6]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = divergence.distances(spark.createDataFrame(nodes, "node long, lang string, terms long, zero long"), spark.createDataFrame(shares, "lang string, term string, node long, p long, zero long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {(t, n): p for _, t, n, p, _ in shares}
    want = {(a[0], b[0]): sum(abs(held.get((f"t{t}", a[0]), a[3]) - held.get((f"t{t}", b[0]), b[3])) for t in range(40)) for a in nodes for b in nodes if a[0] < b[0]}
    assert {(r["a"], r["b"]): r["d"] for r in got} == want


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_trie_finds_what_is_one_apart():
    rng = random.Random(5)
    for letters in ("ab", "abcdé"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, 7))) for _ in range(150)})
        got = list(spelling.trie_pairs(words))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b)}


def variants_by_hand(docs, every):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in best.items() if n[o] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("leaf", [20_000, 3])
def test_spelling_variants(spark, leaf):
    rng = random.Random(6)
    words = ["colour", "color", "colors", "cölor", "Straßen", "strassen", "abcde", "abcdf", "bcdef", "xabcde", "abcdefgh", "éàïôü", "éàïôÜ", "ab×cd÷", *("".join(rng.choice("ab") for _ in range(rng.randrange(5, 8))) for _ in range(80))]
    docs = [(i % 70, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60))) + " 日本 x_y 1colour2\n") for i in range(120)]
    docs += [(None, "colour colour"), (None, None), (3, ""), (4, "colour " * 3000)] + [docs[1]] * 3
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n long").repartition(4)
    got = spelling.spelling_variants(df, leaf=leaf, every=5).collect()
    want = variants_by_hand(docs, 5)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert spelling.spelling_variants(df.filter(F.lit(False))).count() == 0


def test_a_part_with_many_words_is_cut(spark):
    """All words share their first half, so the first cut leaves them together."""
    rng = random.Random(7)
    words = {"aaaaaa" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(300)} | {"aaaaaa" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(100)}
    n = {w: rng.randrange(3, 40) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), leaf=20).collect()
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    want = {(w, len(o), max(map(n.get, o)), min(o, key=lambda x: (-n[x], x))) for w, o in near.items() if o}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def products_by_hand(rows, k, every):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, x) in enumerate(whole):
        if q % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(whole) if a != b and len(x) == len(y))
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1))
    return out


def test_top_products(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 6)) * rng.lognormal(0, 1, (400, 1)) * [5, 3, 1, 0.5, 0.1, 0.01]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [(20, rows[20][1]), (20, rows[3][1]), (None, rows[5][1]), (2000, [0.0] * 6), (2001, [0.0] * 6), (-40, rows[7][1])]
    rows += [(2020, None), (2040, []), (2060, [1.0, None]), (2080, [float("nan")] * 6), (2100, [float("inf")] * 6), (2120, [1.0, 2.0]), (2121, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, row long, score string").repartition(5)
    want = products_by_hand(rows, 20, 20)
    for head, block, step in ((2048, 65_536, 1024), (30, 60, 16)):
        for name, value in (("HEAD", head), ("BLOCK", block), ("STEP", step)):
            monkeypatch.setattr(topk, name, value)
        got = topk.top_products(df).collect()
        assert Counter(map(tuple, got)) == want
    assert topk.top_products(df.filter("vec_id = 1")).count() == 0 and topk.top_products(df.filter("vec_id = 40")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(9)
    for top in (100, 2**27, 2**40):
        a, b = rng.integers(-top, top, (5, 8)), rng.integers(-top, top, (7, 8))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(s) * int(t) for s, t in zip(x, y)))) for y in b] for x in a]
        kind = topk.product_type(a, b)
        a, b = a.astype(kind), b.astype(kind)
        assert topk.products(a, b).tolist() == want
        assert topk.products_at(a, b, np.array([1, 4]), np.array([0, 6])).tolist() == [want[1][0], want[4][6]]


def test_search_leaves_out_nothing_that_counts():
    """Bounds prune, and what they leave is the whole result."""
    rng = np.random.default_rng(10)
    x = (rng.standard_normal((3000, 16)) * np.exp(rng.standard_normal((3000, 1))) * 0.7 ** np.arange(16) * 64).astype(np.int64)
    asked = x[::100]
    rotation = topk.Rotation(topk._floats(x).T @ topk._floats(x))
    q, score, ident, row = topk.search(asked, np.full(len(asked), -np.inf), x, np.arange(3000), np.arange(3000), 5, rotation)
    full = asked @ x.T
    for i in range(len(asked)):
        want = sorted(zip((-full[i]).tolist(), range(3000)))[:5]
        assert sorted(zip((-score[q == i]).tolist(), ident[q == i].tolist())) == want
    assert rotation.cuts and max(rotation.cuts) < 16
