import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import components, filters, simhash
from lexmill.llm.components import connected_components

DOC = "doc_id long, text string, fp string"


def brute_fingerprint(text, words=3):
    parts = (text or "").lower().split() if (text or "").isascii() else (text or "").encode().lower().split()
    parts = [p if isinstance(p, bytes) else p.encode() for p in parts]
    if not parts:
        return 0
    runs = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


def texts():
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    out = []
    for _ in range(12):
        base = rng.choices(vocab, k=150)
        for _ in range(5):
            edited = list(base)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(150)] = rng.choice(vocab)
            out.append(" ".join(edited))
    return [*out, out[0], None, "", " \n", "Ab", "aB", "a b", "É é", "x " * 20000]


def test_components_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOC)
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_components(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == fps
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert links and {i: g[1] for i, g in got.items()} == groups(fps, links)


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_pairs_are_complete(spark, tau):
    rng = random.Random(tau)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(tau + 3))) for b in base for _ in range(6)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), tau).collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= tau}
    assert got == want


def test_empty_and_null_ids(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(None, "a b c d", None), (7, "a b c d", None), (7, "q r s t", None)], DOC)
    assert sorted((str(r["id"]), r["component_id"]) for r in simhash.simhash_components(df).collect()) == [("7", 7), ("7", 7), ("None", 7)]


def test_near_duplicates_verify_similarity(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=300)
    near, far = list(base), list(base)
    near[10] = "zz"
    far[:150] = rng.choices(words, k=150)
    rows = [(5, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {5: 2, 2: 2, 3: 3, 4: 2, 9: 8, 8: 8}


def test_connected_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, None), (7, 7)]
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = {x for e in real for x in e}
    for chunk in (3, 10**6):
        monkeypatch.setattr(components, "CHUNK", chunk)
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == groups(nodes, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def similarity(a, b):
    x, y = ({tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} for p in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_lose_no_link(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = []
    for size in (12, 40, 150, 400) * 6:
        base = rng.choices(vocab, k=size)
        for _ in range(8):
            edited = list(base)
            for _ in range(rng.randrange(max(2, size // 30))):
                edited[rng.randrange(size)] = rng.choice(vocab)
            texts.append(" ".join(edited[rng.randrange(3) :]))
    notice = " ".join(rng.choices(vocab, k=60))
    texts += [f"{notice} {' '.join(rng.choices(vocab, k=rng.randrange(3, 30)))}" for _ in range(60)]
    found = {p: similarity(texts[p[0]], texts[p[1]]) for p in itertools.combinations(range(len(texts)), 2)}
    links = [p for p, s in found.items() if s >= 0.8]
    assert sum(found[p] < 0.85 for p in links) > 20 and sum(0.7 < s < 0.8 for s in found.values()) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == groups(range(len(texts)), links)


def test_equal_fingerprints_are_no_link(spark):
    rng = random.Random(7)
    line = " ".join(f"l{i}" for i in range(7))
    texts = [" ".join([line] * 100 + [f"w{rng.randrange(10**6)}" for _ in range(200)]) for _ in range(4)]
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts}) == 1
    assert max(similarity(a, b) for a, b in itertools.combinations(texts, 2)) < 0.1
    rows = [*enumerate(texts), (9, f"{texts[3]} {line}")]
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 9: 3}


def test_rows_without_ids_and_repeated_ids_stay_apart(spark):
    rng = random.Random(11)
    a, b, c = (" ".join(f"t{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (None, a), (None, c), (None, c), (1, b), (2, a + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df)
    assert sorted((str(r["id"]), str(r["component_id"]), r["kept"]) for r in got.collect()) == sorted(
        [("1", "1", True), ("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True), ("None", "None", True), ("2", "1", False)])
    left = filters.once(filters.without(df, got.filter("not kept")), got.filter("kept"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(1, a), (1, b), (None, c)]))


def test_a_large_group_meets_few_hubs(spark):
    """Near copies of one text: candidates grow with the group, not with its square."""
    rng = random.Random(13)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        t = list(base)
        t[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    seen = []
    real = simhash._verified

    def counted(*args):
        seen.append(args[-1].count())
        return real(*args)

    simhash._verified = counted
    try:
        got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        simhash._verified = real
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert sum(seen) < 10 * len(texts)


def test_near_duplicates_are_searched_by_fingerprints_first(spark):
    """The stage's first candidates come of the fingerprints, found by chains: those of equal ones and of ones two bits apart."""
    fps = [5, 5, 5, 6, 1 << 40, -1]
    reps = spark.createDataFrame([(10 + i, f) for i, f in enumerate(fps)], "node long, fp long")
    assert sorted(tuple(r) for r in simhash._by_fingerprint(reps).collect()) == [(10, 11), (10, 12), (10, 13)]
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, "a b c d e f g")]
    asked, real = [], simhash._verified
    simhash._verified = lambda *args: asked.append(args[-1].count()) or real(*args)
    try:
        got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        simhash._verified = real
    assert got == {1: 1, 2: 1, 3: 3} and asked[0] == 1


def test_stages_that_join_nothing_run_no_more_jobs(spark, monkeypatch):
    """Without candidates nothing is verified, without links no components are joined, and what a stage joined ends the search."""
    calls = []
    for name in ("_verified", "connected_components"):
        monkeypatch.setattr(simhash, name, lambda *args, name=name, real=getattr(simhash, name): calls.append(name) or real(*args))
    rng = random.Random(17)
    base, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(2))
    for rows, expected, asked in (
        ([(1, base), (2, other), (3, None)], {1: 1, 2: 2, 3: 3}, []),
        ([(1, base), (2, f"{base} x"), (3, other)], {1: 1, 2: 1, 3: 3}, ["_verified", "connected_components"]),
    ):
        calls.clear()
        got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == expected and calls == asked
