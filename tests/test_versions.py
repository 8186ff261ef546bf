import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lexmill.operators import graph, versions
from lexmill.sources import paging

CHANGES = "document_id long, path string, action string, text string, source string, effective date"


def test_texts_on_every_day(spark):
    """Against replaying all changes up to a day, one after another."""
    rng = random.Random(4)
    start = date(2020, 1, 1)
    paths = ["c1", "c1.d1", "c1.d1.k1", "c1.d1.k2", "c1.d2", "c2"]
    rows = [(d, rng.choice(paths), rng.choice(["insert", "replace", "replace", "repeal"]), f"t{i}", f"s{i:03}", start + timedelta(rng.randrange(12))) for d in (1, 2, 3) for i in range(25)]
    rows = [(*r[:3], None if r[2] == "repeal" else r[3], *r[4:]) for r in rows]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, (None, "c1", "insert", "t", "s", start), (4, "c1", "insert", "t", "s", None)]], CHANGES + ", extra string").repartition(3)
    v = versions.intervals(frame).cache()
    held = {}
    for d, path, action, text, source, day in sorted(rows, key=lambda r: (r[5], r[4])):
        for n in range(12):
            if start + timedelta(n) >= day:
                state = held.setdefault((d, n), {})
                for other in [p for p in state if p.startswith(f"{path}.") and action != "insert"]:
                    del state[other]
                state.pop(path, None)
                if action != "repeal":
                    state[path] = text
    asked = spark.createDataFrame([(d, start + timedelta(n)) for d in (1, 2, 3, 9) for n in range(-1, 12)] * 2, "document_id long, day date")
    got = {(r["document_id"], (r["day"] - start).days): (r["provisions"], r["full_text"]) for r in versions.texts_as_of(v, asked).collect()}
    assert got == {k: (len(s), "\n".join(s[p] for p in sorted(s, key=lambda p: p.split(".")))) for k, s in held.items() if s}
    assert {r["path"]: r["text"] for r in versions.as_of(v.filter("document_id = 1"), F.lit(start + timedelta(11))).collect()} == held[1, 11]
    chains = {(r["document_id"], r["path"]): r["sources"] for r in versions.chain(v).collect()}
    assert chains == {k: [r["source"] for r in sorted(v.collect(), key=lambda r: r["version"]) if (r["document_id"], r["path"]) == k] for k in chains}
    overlap = v.alias("a").join(v.alias("b"), F.expr("a.document_id = b.document_id and a.path = b.path and a.version < b.version and coalesce(a.valid_to, date'9999-01-01') > b.valid_from"))
    assert overlap.isEmpty() and versions.intervals(frame.filter("document_id = 99")).isEmpty()


def test_replaced_articles_name_their_successor(spark):
    day = lambda n: date(2020, 1, n)
    nodes = spark.createDataFrame([(7, "d1", "old"), (7, "d1.k1", "clause")], "document_id long, path string, text_content string")
    later = spark.createDataFrame([(7, "d1", "replace", "new", "amending", day(5)), (7, "d1", "repeal", None, "repealing", day(9))], CHANGES)
    got = versions.intervals(versions.original_provisions(nodes, F.lit(day(1))).unionByName(later)).orderBy("path", "version").collect()
    assert [(r["path"], r["version"], r["text"], r["valid_from"], r["valid_to"], r["source"], r["superseded_by"]) for r in got] == [
        ("d1", 1, "old", day(1), day(5), "7", "amending"), ("d1", 2, "new", day(5), day(9), "amending", "repealing"), ("d1.k1", 1, "clause", day(1), day(5), "7", "amending")]


def test_paths_cut_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 2), (3, 4), (1, 2), (None, 1), (4, None)]
    got = {tuple(r["path"]) for r in graph.path_lists(spark.createDataFrame(edges, "source long, target long"), hops=5).collect()}
    assert got == {(1, 2), (1, 2, 3), (1, 2, 3, 4), (2, 3), (2, 3, 1), (2, 3, 4), (3, 1), (3, 1, 2), (3, 4)}
    one = graph.path_lists(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(3,), (3,)], "start long"), 1)
    assert sorted(r["path"] for r in one.collect()) == [[3, 1], [3, 4]]


def read(pages, most, cap):
    """A reader that fetches page after page."""
    if 1 not in pages:
        return []
    total, rows = pages[1]
    size, wanted = len(rows), min(most, len(rows) if total is None else total)
    limit = min(-(-most // (size or 1)) + 1, cap)
    out, last, n = [(1, 0)], rows, 2
    have = len(rows)
    while have < wanted and last and n <= limit and n in pages:
        out.append((n, have))
        last = pages[n][1]
        have += len(last)
        n += 1
    return out


def test_pages_are_taken_until_one_is_empty(spark):
    rng = random.Random(5)
    listings = {f"l{i}": {n: (rng.choice([None, 3, 30, 500]), [f"r{n}.{j}" for j in range(rng.choice([0, 3, 5, 5, 5, 5]))]) for n in range(1, rng.randrange(2, 14)) if rng.random() < 0.95} for i in range(60)}
    rows = [(name, n, total, r) for name, pages in listings.items() for n, (total, r) in pages.items()] + [("l1", 99, 1, ["x"]), (None, 1, 1, ["x"]), ("none", 1, None, None)]
    df = spark.createDataFrame(rows, "listing string, page int, total long, rows array<string>").repartition(4)
    for most, cap in ((12, 50), (40, 4)):
        got = sorted((r["listing"], r["page"], r["taken"]) for r in paging.pages_taken(df, most, cap).collect())
        assert got == sorted((name, n, have) for name, pages in [*listings.items(), ("none", {1: (None, [])})] for n, have in read(pages, most, cap))
        flat = {(r["listing"], r["position"]): r["row"] for r in paging.listed(df, most, cap).collect()}
        want = {}
        for name, pages in listings.items():
            whole = [x for n, _ in read(pages, most, cap) for x in pages[n][1]]
            want |= {(name, i): x for i, x in enumerate(whole[:most])}
        assert flat == want
