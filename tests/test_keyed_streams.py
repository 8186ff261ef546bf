import random
import time

from pyspark.sql import functions as F

from lexmill.operators import edges
from lexmill.streaming import feed, keyed

VERSIONS = "document_id string, version long, ids array<string>, hashes array<string>"


def arrive(spark, log, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)


def test_diffs_of_versions(spark, tmp_path):
    """Version after version equals the batch form, replays and stragglers change nothing, any order ends in one state."""
    rng = random.Random(1)
    versions = [(d, v, ids := sorted(rng.sample("pqrst", rng.randrange(5))), [f"h{rng.randrange(3)}" for _ in ids]) for d in "abc" for v in range(1, 6)]
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    stream = lambda: keyed.chunk_diffs(feed.change_feed(spark, log, 1))
    arrive(spark, log, [[r for r in versions if r[1] in vs] for vs in ((1, 2), (3,))], VERSIONS)
    keyed.run_into(stream(), out)
    arrive(spark, log, [[r for r in versions if r[1] in (2, 3, 4, 5)] + [("a", 5, *versions[4][2:]), (None, 1, [], []), ("z", 1, None, None)]], VERSIONS)
    rows = keyed.run_into(stream(), out).select("document_id", "version", "id", "action", "content_hash")
    got = [tuple(r) for r in rows.collect()]
    state = {(d, v): dict(zip(ids, hashes)) for d, v, ids, hashes in versions}
    want = set()
    for (d, v), new in state.items():
        old = state.get((d, v - 1), {})
        want |= {(d, v, c, "upsert", h) for c, h in new.items() if old.get(c) != h} | {(d, v, c, "delete", None) for c in old if c not in new}
    assert len(got) == len(set(got)) and set(got) == want
    table = lambda v: spark.createDataFrame([(f"{d}:{c}", h) for (d, n), s in state.items() if n == v for c, h in s.items()], "id string, content_hash string")
    batch = {tuple(r) for r in feed.chunk_diff(table(4), table(5)).collect()}
    assert {(f"{d}:{c}", a, h) for d, v, c, a, h in got if v == 5} == {(i, a, h) for i, a, h in batch}
    final = {(d, c, h) for (d, v), s in state.items() if v == 5 for c, h in s.items()}
    assert {tuple(r) for r in keyed.index_state(rows.unionByName(rows.filter("version < 4"))).collect()} == final
    rng.shuffle(versions)
    other = f"file://{tmp_path}/other"
    arrive(spark, other, [versions[:7], versions[7:]], VERSIONS)
    rows = keyed.run_into(keyed.chunk_diffs(feed.change_feed(spark, other, 1)), f"file://{tmp_path}/out2")
    assert {tuple(r) for r in keyed.index_state(rows).collect()} == final


def test_edges_wait_for_their_targets(spark, tmp_path):
    schema = "citation string, document_id string, edge_id string, own string, inbound boolean, reference_type string, change_type string"
    docs = [(f"c{i}", f"d{i}", None, None, None, None, None) for i in range(6)]
    cards = [(f"c{i % 9}", None, f"e{i}", f"d{i % 5}", i % 4 == 0, "cites", None if i % 3 else "replace") for i in range(40)]
    rng, want = random.Random(2), None
    relations = spark.createDataFrame([(own, kind, change, not inbound, e, c) for c, _, e, own, inbound, kind, change in cards], "document_id string, reference_type string, change_type string, this_is_source boolean, raw_citation_text string, citation string")
    document = spark.createDataFrame([(d, c) for c, d, *_ in docs], "id string, citation_id string")
    batch = edges.split_relations(relations, document).filter("target_document_id is not null")
    want = sorted(map(str, batch.select("raw_citation_text", "source_document_id", "target_document_id", "reference_type", "change_type").collect()))
    for turn in range(2):
        rows = docs + cards + [(None, None, "e99", "d1", False, "cites", None)]
        rng.shuffle(rows)
        log = f"file://{tmp_path}/log{turn}"
        out = f"file://{tmp_path}/out{turn}"
        arrive(spark, log, [rows[:15], rows[15:30]], schema)
        keyed.run_into(keyed.bound_edges(feed.change_feed(spark, log, 1), salts=2), out)
        arrive(spark, log, [rows[30:]], schema)
        got = keyed.run_into(keyed.bound_edges(feed.change_feed(spark, log, 1), salts=2), out)
        got = got.select(F.col("id").alias("raw_citation_text"), "source_document_id", "target_document_id", "reference_type", "change_type")
        assert sorted(map(str, got.collect())) == want


def test_waiting_edges_cost_by_page(spark, tmp_path):
    """30,000 citations, half of whose edges come before their documents: a key for each took minutes."""
    schema = "citation string, document_id string, edge_id string, own string, inbound boolean, reference_type string, change_type string"
    log, n = f"file://{tmp_path}/log", 30_000
    docs = [(f"c{i}", f"d{i}", None, None, None, None, None) for i in range(n)]
    cards = [(f"c{i}", None, f"e{i}", "d", i % 3 == 0, "cites", None) for i in range(n + 100)]
    began = time.perf_counter()
    for rows in (cards[::2], docs + cards[1::2] + [("c0", "a-later", None, None, None, None, None)]):
        arrive(spark, log, [rows], schema)
        got = keyed.run_into(keyed.bound_edges(feed.change_feed(spark, log, 1), salts=2, pages=16), f"file://{tmp_path}/out")
    ends = lambda i: (f"d{i}", "d") if i % 3 == 0 else ("d", f"d{i}")
    want = {(f"e{i}", *(("a-later", "d") if i == 0 else ends(i))) for i in range(n)}
    found = [tuple(r) for r in got.select("id", "source_document_id", "target_document_id").collect()]
    assert len(found) == n and set(found) == want
    assert time.perf_counter() - began < 60
