from pyspark.sql import functions as F

from lexmill.streaming import feed


def test_projectors_are_independent_and_replayable(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    row = lambda *r: spark.createDataFrame([r], "document_id string, version int, deleted boolean")
    row("a", 1, False).write.mode("append").parquet(log)
    p, q = (feed.Projector(spark, f"file://{tmp_path}/{n}", feed.latest_fold(["document_id"], ["version"])) for n in ("p", "q"))
    p.run(feed.change_feed(spark, log))
    row("a", 2, True).write.mode("append").parquet(log)
    row("b", 1, False).write.mode("append").parquet(log)
    for x in (p, q, q):
        x.run(feed.change_feed(spark, log, 1))
    want = {("a", 2, True), ("b", 1, False)}
    assert {tuple(r) for r in p.state().collect()} == want == {tuple(r) for r in q.state().collect()}
    last = q._batches()[-1]
    q.apply(row("b", 1, False), last)
    assert {tuple(r) for r in q.state().collect()} == want


def test_chunk_diff(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, content_hash string, text string")
    old, new = make([("x:1", "h1", "a"), ("x:2", "h2", "b"), ("x:3", "h3", "c")]), make([("x:1", "h1", "a"), ("x:2", "h9", "B"), ("x:4", "h4", "d")])
    diff = feed.chunk_diff(old, new)
    assert {(r["id"], r["action"]) for r in diff.collect()} == {("x:2", "upsert"), ("x:4", "upsert"), ("x:3", "delete")}
    state = feed.apply_diff(old, diff, new)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, new.collect()))
    assert sorted(map(tuple, feed.apply_diff(state, diff, new).collect())) == sorted(map(tuple, new.collect()))


def test_reconcile(spark):
    docs = spark.createDataFrame([("a", "v1"), ("b", "v1")], "id string, content_version string")
    state = spark.createDataFrame([("a", "s", "v1", "synced"), ("a", "g", "v0", "synced"), ("b", "s", "v1", "failed"), ("b", "g", None, "not_applicable")], "document_id string, target string, synced_version string, status string")
    got = {(r["document_id"], r["target"], r["reason"]) for r in feed.reconcile(docs, state, ["s", "g", "v"]).collect()}
    assert got == {("a", "g", "stale"), ("b", "s", "failed"), ("a", "v", "missing"), ("b", "v", "missing")}
    assert feed.reconcile(docs.filter(F.lit(False)), state, ["s"]).count() == 0
