import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import packing, quality, toxicity, vectors, warc
from lexmill.llm.labelled import held_out, labelled_sample, rated


def test_archives(spark):
    html = ["<p>é</p>", "", None, "<p>é</p>", "x" * 70000, "<p>é</p>", "", "solo"]
    rows = [(i, f"http://h/{i} ä\r\nEvil: 1" if i != 3 else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "<p>é</p>", "c"), (0, "u", "<p>é</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_archives(df)
    got = warc.read_archives(files).collect()
    assert sum(r["n_records"] for r in files.collect()) == len(rows) == len(got)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        h = next((h for i, _, h, _ in rows if i == r["page_id"]), "") or ""
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        raw = h.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["record_type"] == ("response" if first[h] == r["page_id"] else "revisit") and r["refers_to"] == (None if first[h] == r["page_id"] else first[h])
        assert r["payload"] == (raw if r["record_type"] == "response" else None)
    names = [f for path in (r["path"].removeprefix("file://") for r in files.collect()) for f, _ in warc.records(iter([open(path, "rb").read()]))]
    ids = {f["warc-record-id"]: f["warc-type"] for f in names}
    assert len(ids) == len(rows) and all(ids[f["warc-refers-to"]] == "response" for f in names if f["warc-type"] == "revisit")
    tasks = warc.read_archives(files.select("path")).rdd.getNumPartitions(), warc.read_archives(files).rdd.getNumPartitions()
    assert tasks[0] == files.count() >= tasks[1]
    small = warc.read_archives(warc.write_archives(df, min_bytes=100)).filter("record_type = 'revisit'").count()
    assert small == 0 and warc.write_archives(df.filter(F.lit(False))).count() == 0


def test_reader_finds_damage():
    good = warc.record(1, "u", b"abc" * 50000, None, False) + warc.record(2, "u", b"", 1, True)
    blocks = [good[i : i + 7] for i in range(0, len(good), 7)]
    assert [warc.verified(*r)["page_id"] for r in warc.records(iter(blocks))] == [1, 2]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([good[:-5]])))
    plain = zlib.decompress(warc.record(1, "u", b"abc", None, False), 31)
    with pytest.raises(ValueError, match="digest"):
        [warc.verified(*r) for r in warc.records(iter([zlib.compress(plain.replace(b"abc", b"abd"), wbits=31)]))]


def brute_links(rows):
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, lab) in enumerate(rows):
        for j, w, other in rows[a + 1 :]:
            if lab is None or lab != other or v is None or w is None or len(v) != len(w) or None in v or None in w:
                continue
            x, y = np.array(v, "f4").astype("f8"), np.array(w, "f4").astype("f8")
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    return links


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for c in range(30):
        base = rng.standard_normal(16)
        for _ in range(150 if c == 0 else 6):
            rows.append((n, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.08], c % 3))
            n += 1
    rows += [(n + i, v, lab) for i, (v, lab) in enumerate([(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([], 1), (rows[0][1], None), (rows[0][1], 0), (rows[0][1], 0), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([float("inf")] * 16, 2)])]
    df = spark.createDataFrame([(i, v, lab, 7) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, links int").repartition(3)
    links = brute_links(rows)
    got = {r["id"]: r for r in vectors.near_vectors(df, leaf=64).collect()}
    found, there = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert len(got) == len(rows) and 0.95 * there <= found <= there and all(got[i]["n_links"] <= len(s) for i, s in links.items())
    for r in got.values():
        assert r["kept"] == (r["id"] == r["component_id"]) and r["component_id"] <= r["id"]
    assert vectors.near_vectors(df.filter(F.lit(False))).count() == 0
    nulls = spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vectors.near_vectors(nulls).collect()] == [(None, 0, None, False)]


def test_oversize_leaves_are_split_on(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(300):
        base = rng.standard_normal(32)
        rows += [(len(rows) + k, [float(x) for x in base + rng.standard_normal(32) * 0.06], c % 2) for k in range(3)]
    close = rng.standard_normal(32)
    rows += [(len(rows) + k, [float(x) for x in close + rng.standard_normal(32) * 0.03], 0) for k in range(60)]  # no direction parts these
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    links = brute_links([(i, v, lab) for i, v, lab in rows])
    got = {r["id"]: r for r in vectors.near_vectors(df, trees=3, leaf=8, sample=40).collect()}
    found, there = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert len(got) == len(rows) and 0.95 * there <= found and all(got[i]["n_links"] <= len(s) for i, s in links.items())
    units = [[float(y) for y in np.array(v) / np.linalg.norm(v)] for _, v, _ in rows]
    placed = spark.createDataFrame([(lab, u, i, 1, [5 << 32 | 1, 9 << 32 | 1]) for (i, _, lab), u in zip(rows, units)], "label int, vector array<double>, node long, copies long, leaves array<long>")
    split = vectors.split_on(placed, 64)
    sizes = [r["n"] for r in split.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count("*").alias("n")).collect()]
    assert split.count() == len(rows) and max(sizes) <= 64 + 60  # the close ones and what lies around them
    assert vectors.split_on(placed, 5000) is placed
    stays = vectors.split_on(placed.filter("node >= 900"), 16)  # too close to be parted
    assert {len(r["leaves"]) for r in stays.collect()} == {2}


def test_vectors_keep_doubles_and_rows_of_one_id_apart(spark):
    near = [1.0, (1 / 0.98**2 - 1) ** 0.5 * (1 + 1e-9)]  # a cosine just below 0.98, at or above it in single precision
    rows = [(1, [1.0, 0.0], 5), (2, near, 5), (3, [0.0, 1.0], 6), (3, [1.0, 0.0], 7), (4, [1.0, 0.001], 7), (9, [0.0, 1.001], 6)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (9, 1, 3, False)]


def test_planted_links_are_met_at_default_parameters(spark):
    rng = np.random.default_rng(4)
    rows, links = [], 0
    for i in range(1500):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        side = rng.standard_normal(64)
        side -= base * (side @ base)
        side /= np.linalg.norm(side)
        c = rng.uniform(0.9805, 0.99)
        rows += [(2 * i, base.tolist(), 0), (2 * i + 1, (c * base + (1 - c * c) ** 0.5 * side).tolist(), 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    links = got.filter("n_links > 0").count()
    assert 0.9 * len(rows) <= links <= len(rows)


VOCAB = ["".join(random.Random(i).choices("abcdefgh", k=random.Random(i).randrange(2, 8))) for i in range(400)]


def labelled_docs(n, seed):
    """Ordinary prose; some with words of abuse, some of which every line is junk."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lines = [" ".join(rng.choices(VOCAB, k=rng.randrange(4, 14))) + "." for _ in range(rng.randrange(2, 9))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            lines = [" | ".join(x.split()) if i % 2 else " ".join(w + "###" for w in x.split()) for x in lines]
        if toxic:
            words = " ".join(lines).split(" ")
            for _ in range(max(3, len(words) // 10)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbledork", "snotwobble", "wretchling"]))
            lines = " ".join(words).split(".")
        rows.append((i, "\n".join(lines), int(not bad), int(toxic)))
    return rows


def test_classifiers_on_held_out_documents():
    fit, new = labelled_docs(700, 1), labelled_docs(300, 2)
    for mod, at in ((quality, 2), (toxicity, 3)):
        model = mod.train([r[1] for r in fit], [r[at] for r in fit])
        y = np.array([r[at] for r in new])
        assert ((model.logits([r[1] for r in new]) >= 0) == y).mean() > 0.95
        odd = model.logits([None, "", " \n ", "x" * 100000, "\n".join("a b" for _ in range(5000))])
        assert np.isfinite(odd).all() and odd[0] == odd[1] and len(model.logits([])) == 0
        assert mod.train([], []) is None and mod.train(["a", "b", "c"], [1, 1, 1]) is None


def test_trained_dictionaries_hold_what_sets_a_class_apart():
    rows = labelled_docs(500, 3)
    own, other = ([toxicity.tokens(r[1]) for r in rows if r[3] == y] for y in (1, 0))
    stems = {b" " + w[:n] for words in own for w in words for n in range(4, 12)} | {b" " + w + b" " for words in own for w in words}
    naive = set()
    for s in stems:
        has = [sum(any((b" " + w + b" ").startswith(s) for w in words) for words in docs) for docs in (own, other)]
        if has[0] >= 60 and has[1] == 0 and (len(s) in toxicity.LENGTHS or s.endswith(b" ")):
            naive.add(s)
    assert {b" grumbledork ", b" snotwobble ", b" wretchling "} <= naive <= toxicity._contrast(own, other)

    toxic, ordinary = toxicity._dictionary(own, other), toxicity._dictionary(other, own)
    assert b"\x37\xa4\x30\xec" in toxic  # the mark of a trained dictionary
    assert all(s in toxic for s in toxicity._contrast(own, other) if s.endswith(b" "))
    plain, bad = toxicity.Model(toxic, ordinary).compressors()
    for w in (b"grumbledork", b"snotwobble", b"wretchling"):
        assert len(bad(toxicity.KEY + w + b" ")) < len(plain(toxicity.KEY + w + b" "))

    assert b" awful " in toxicity._dictionary([[b"awful", b"plain"]] * 9, [[b"plain"]] * 400) and toxicity._dictionary([], []) == b""

    words = [b"%04dz" % (i * 7 % 10000) for i in range(3000)]  # more than the trainer may fill
    many = [[words[(i * 40 + j * 77) % 3000] for j in range(40)] for i in range(3000)]
    held = toxicity._dictionary(many, [[b"plain"]] * 3000)
    assert len(held) > toxicity.TRAINED and all(b" " + w in held for w in words)


def test_marginals_match_enumeration():
    import itertools

    rng = random.Random(1)
    potential, tie = [rng.uniform(-2, 2) for _ in range(7)], [[2.0, 0.3], [0.5, 1.5]]
    total, good = 0.0, [0.0] * 7
    for states in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(p for p, s in zip(potential, states) if s)) * np.prod([tie[a][b] for a, b in zip(states, states[1:])])
        total += w
        for k, s in enumerate(states):
            good[k] += w * s
    assert np.allclose(quality.marginals(potential, tie), [g / total for g in good])


def test_samples_and_rates(spark):
    docs = spark.createDataFrame([(i, f"t{i}" if i else None, 0.5) for i in range(30)] + [(None, "n", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (25, None), (26, 7), (3, 1)], "doc_id long, y int")
    texts, ys, stands = labelled_sample(docs, labels, "y", ~held_out("doc_id", 5, 0), 4)
    held = {i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert ys.count(0) == ys.count(1) == 4 and not {t for t in texts} & {f"t{i}" for i in held} and stands[0] == sum(i % 2 == 0 and i not in held for i in range(20)) / 4
    some, marks, _ = labelled_sample(docs, labels, "y", ~held_out("doc_id", 5, 0), 4, most_bytes=sum(len(t.encode()) for t in texts) - 1)
    assert 0 < len(some) < len(texts) and len(marks) == len(some) and set(some) <= set(texts)
    assert labelled_sample(docs, labels.filter(F.lit(False)), "y", F.lit(True)) == ([], [], (1.0, 1.0))
    rows = rated(docs, lambda t: np.array([0.0 if x else 30.0 for x in t])).collect()
    assert len(rows) == 31 and rows[0]["score"] > 0.99 and rows[1]["score"] == 0.5 and [r["doc_id"] for r in rows] == [*range(30), None]
    assert rated(docs.filter(F.lit(False)), lambda t: np.zeros(len(t))).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, top = random.Random(9), tmp_path_factory.mktemp("corpus")
    rows = labelled_docs(400, 5)
    items = [(i, " ".join(rng.choices(VOCAB, k=30))) for i in range(5)]
    docs = [(i, t) for i, t, _, _ in rows]
    clean = [(i, t) for i, t, good, toxic in rows if good and not toxic and len(t.split()) > 30]
    copies = [(1000 + k, t) for k, (_, t) in enumerate(clean[:10])]
    leaks = [(2000 + k, f"{t}\n{items[k % 5][1]}") for k, (_, t) in enumerate(clean[10:20])]
    extra = [(3000, None), (3001, ""), (None, clean[20][1]), (3002, "repeat me once and then no more than that."), (3002, "repeat me once and then no more than that.")]
    frame = spark.createDataFrame([(*d, "en", "s", len(d[1] or "")) for d in [*docs, *copies, *leaks, *extra]], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"file://{top}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{top}/benchmark.parquet")
    return f"file://{top}", rows, clean, copies, leaks


def test_pipeline(spark, corpus):
    top, rows, clean, copies, leaks = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == columns
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    toxic, bad = {r[0] for r in rows if r[3]}, {r[0] for r in rows if not r[2]}
    assert len(kept[0] & toxic) < 0.1 * len(toxic) and len(kept[1] & bad) < 0.1 * len(bad)
    assert len(kept[1] & {i for i, _ in clean}) > 0.95 * len(clean)
    assert not kept[2] & {i for i, _ in copies} and not kept[3] & {i for i, _ in leaks}
    assert docs.filter("doc_id = 3002").count() <= 1
    packed = packing.pack_documents(docs)
    run = corpus_pipeline.run(spark, top)
    assert sorted(map(tuple, run.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str)
    empty = spark.read.parquet(f"{top}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, top).count() == 0
