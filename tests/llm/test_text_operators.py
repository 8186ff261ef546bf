import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import chat, decontaminate, licenses, packing, recount, tokens
from lexmill.llm.portions import portions

MIT = "Released under the MIT License."


def test_license_base_places_match_brute_force(spark):
    rng = random.Random(1)
    pieces = ["under the mit license", "Apache License, Version 2", "cc-by-nc", "CC BY\nNC", "mit", "license", "the", "é", "7"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(12)))) for i in range(80)] + [(100, None), (101, ""), (102, "under the mit license"), (None, MIT)]
    rows += rows[:3]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    want = []
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(p, lab) for lab, phrase in licenses.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None), ",".join(sorted({lab for _, lab in at}))))
    got = [tuple(r)[:6] for r in licenses.scan_licenses(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_license_edited_notice(spark):
    words = licenses.NOTICES[1][1].split()
    cut = " ".join(words[:12] + ["indeed"] + words[12:])
    df = spark.createDataFrame([(1, cut), (2, " ".join(words[::-1])), (3, " ".join(words[:9]))], "doc_id long, text string")
    got = {r["id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    assert got[1][0] == "mit" and got[1][1] > 0.9 and got[2] == ("", 0.0) and got[3] == ("", 0.0)


def test_each_notice_gets_its_own_label_alone(spark):
    rows = [(n, f"foo bar {words} and more") for n, (_, words) in enumerate(licenses.NOTICES)]
    rows += [(500, "This work is licensed under the GNU General Public License version 4"), (501, "either version 7 of the license as published by the free software foundation")]
    got = {r["id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: label for n, (label, _) in enumerate(licenses.NOTICES)} | {500: "", 501: ""}


def test_whole_license_texts_from_files(spark, tmp_path):
    rng = random.Random(3)
    texts = {name: " ".join(rng.choices([f"w{i}" for i in range(300)], k=900)) for name in ("own-1", "own-2")}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(f"It's \"quoted\"; {text}")
    notices = licenses.read_notices(spark, f"file://{tmp_path}")
    assert [n for n, _ in notices] == ["own-1", "own-2"]
    rows = [(1, f"before. {texts['own-1'].upper()} after"), (2, " ".join(texts["own-2"].split()[:300])), (3, texts["own-2"].replace("w7 ", "w8 "))]
    got = {r["id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), notices=notices).collect()}
    assert got == {1: "own-1", 2: "", 3: "own-2"}


def brute_chat(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<|", "|>", "\n", "assistant", "a", "\\", "<", "é", "😀", "<\\\\|x", ""]
    convs = {c: [(rng.choice(["user", "assistant", "sys\ntem", "a\\n", "<|im_end|>"]), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(rng.randrange(1, 6))] for c in range(120)}
    rows = [(c, i, r, t, 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(500, None, None, None, 1), (None, 0, "assistant", "x", 1)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))).collect()}
    assert got == {c: brute_chat(t) for c, t in convs.items()} | {500: brute_chat([("", "")]), None: brute_chat([("assistant", "x")])}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def full(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_ids_match_the_library():
    enc = tokens.encoder()
    for t in ["", " ", "a  b\n\nc", "it's 'll", "<|endoftext|> x", "日本語 ²½ 3.4", "x" * 5000]:
        assert full(enc.ids(t)) == enc.full.encode(t, add_special_tokens=False).ids


def depth(node):
    return 1 if node.left is None else 1 + max(depth(node.left), depth(node.right))


def test_edited_counts_match_full_counts(spark):
    enc, rng = tokens.encoder(), random.Random(5)
    letters = list("ab's   \n\t12.,!?é'rell ")
    for _ in range(150):
        doc = recount.Counted("".join(rng.choices(letters, k=rng.choice([0, 3, 40, 500]))), enc)
        for _ in range(6):
            a = rng.randint(0, len(doc.text))
            doc.edit(a, a + rng.choice([0, 1, 5]), "".join(rng.choices(letters, k=rng.choice([0, 1, 4]))))
            fresh = recount.Counted(doc.text, enc)
            assert (doc.tree.tokens, doc.tree.n, doc.tree.chars) == (fresh.tree.tokens, fresh.tree.n, len(doc.text)) and doc.tokens == len(enc.ids(doc.text)) // 4
        doc = recount.Counted("".join(rng.choices(["a ", "<|endoftext|>", "  ", "x", "<|endof", "text|>"], k=rng.choice([3, 30]))), enc)
        for _ in range(4):
            a = rng.randint(0, len(doc.text))
            doc.edit(a, a + rng.choice([0, 1, 3]), rng.choice(["", "text|>", "<|endof", "<|endoftext|>", " ", "y"]))
            assert doc.tokens == len(enc.ids(doc.text)) // 4
    grown = recount.Counted("start of it", enc)
    for i in range(100_000):
        grown.edit(2, 2, " a")
    assert grown.tokens == recount.Counted(grown.text, enc).tokens and depth(grown.tree) < 40
    long = recount.Counted("word " * 20000, enc)
    long.edit(50000, 50003, "xyz")
    assert long.encoded < 12
    df = spark.createDataFrame([(1, "a b", [(1, 1, " c"), None]), (2, None, None), (None, "x", [])], "doc_id long, text string, edits array<struct<start:long,end:long,put:string>>")
    assert {r["id"]: (r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) for r in recount.edit_counts(df).collect()} == {1: (2, 2, 3), 2: (0, 0, 0), None: (1, 0, 1)}


def check_packing(rows, ids_of, capacity):
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    import zlib

    for doc, parts in docs.items():
        ids = ids_of[doc]
        assert sum(p[2] for p in parts) == len(ids) // 4
        for k, (piece, start, n, crc) in enumerate(sorted(parts)):
            assert piece == k and crc == zlib.crc32(ids[4 * start : 4 * (start + n)]) and (n == capacity or k == 0)
    return len(seqs)


def test_packing(spark):
    rng, enc = random.Random(6), tokens.encoder()
    rows = [(i, " ".join(rng.choices(["alpha", "be", "gamma", "x"], k=int(rng.paretovariate(0.7) * 5) % 900))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(df, capacity=128).collect()
    ids = {i: enc.ids(t or "") + (2).to_bytes(4, "little") for i, t in rows}
    used = check_packing(got, ids, 128)
    least = -(-sum(len(x) // 4 for x in ids.values()) // 128)
    assert least <= used <= least * 1.03 + 2
    with_ids = packing.pieces(df, capacity=128).filter("doc_id = 900").first()
    assert full(with_ids["ids"]) == [2]
    assert packing.pack_documents(df.filter(F.lit(False))).count() == 0


def test_rows_that_share_an_id_are_packed_apart(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "alpha be gamma" if i % 3 else "x", i) for i in range(900)], "doc_id long, text string, row int").repartition(5)
    got = packing.pack_documents(docs, capacity=16).collect()
    n = {t: len(tokens.encoder().ids(t)) // 4 + 1 for t in ("alpha be gamma", "x")}
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert len(got) == 900 and sum(r["length"] for r in got) == 300 * n["x"] + 600 * n["alpha be gamma"]
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:])) and places[0][1] == 0
    cut = packing.pieces(docs, capacity=16).withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(8)))
    assert cut.groupBy("bucket").count().agg(F.max("count")).first()[0] < 900 / 4


def test_plan_covers_every_rank():
    rng = random.Random(7)
    for _ in range(20):
        hist = {n: rng.choice([1, 3, 50, 5000]) for n in rng.sample(range(1, 1025), rng.choice([1, 5, 300]))}
        spans = {}
        for n, lo, hi, _, _ in packing.plan(hist, groups=rng.choice([1, 8, 512])):
            spans.setdefault(n, []).append((lo, hi))
        for n, k in hist.items():
            at = 0
            for lo, hi in sorted(spans[n]):
                assert lo == at
                at = hi
            assert at == k


def test_decontamination_recall_and_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(800)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(6, 50)))) for i in range(60)]
    rows, planted = [], set()
    for d in range(240):
        words = rng.choices(vocab, k=rng.randrange(5, 200))
        if d % 2:
            i, t = items[d % 60]
            part = t.split()
            for _ in range(rng.randint(0, int(0.2 * len(part)))):
                at = rng.randrange(len(part))
                part[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            cut = rng.randrange(len(words))
            words[cut:cut] = part
        rows.append((d, " ".join(words).upper() if d % 3 else " ".join(words)))
    index = decontaminate.Index(items)
    for d, text in rows:
        words = np.array([index.vocabulary.get(w, 0) for w in decontaminate.words_of(text)])
        for item, s in index.items:
            if decontaminate.edit_place(s, words)[0] <= int(0.2 * len(s)):
                planted.add((d, item))
    rows += [(900, None), (901, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted) >= 100
    old = decontaminate.ITEM_CHARS
    decontaminate.ITEM_CHARS = 2000
    try:
        assert {(r["id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == got
    finally:
        decontaminate.ITEM_CHARS = old
    assert decontaminate.contaminated(df, bench.filter(F.lit(False))).count() == 0
    held = {d for d, _ in got}
    left = [r["doc_id"] for r in decontaminate.clean(df, bench).collect()]
    assert sorted(left) == [d for d, _ in rows if d not in held] and decontaminate.clean(df, bench).columns == df.columns
    same = spark.createDataFrame([(None, items[0][1]), (7, items[0][1]), (7, "other words"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, decontaminate.clean(same, bench).collect()))) == ["(7, 'other words')", "(None, None)"]


def test_items_of_all_sizes_are_met_at_the_limit():
    """Every planted item has the most edits that are allowed; brute force says which of them are within the distance."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(3000)]
    for low, high, n in ((1, 5, 30), (5, 8, 60), (8, 40, 60), (100, 400, 6)):
        items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(low, high)))) for i in range(n)]
        index, texts, near = decontaminate.Index(items), [], set()
        for d in range(150):
            part, words = items[d % n][1].split(), rng.choices(vocab, k=rng.randrange(5, 200))
            for _ in range(int(0.2 * len(part))):
                at = rng.randrange(len(part))
                part[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            cut = rng.randrange(len(words))
            texts.append(" ".join([*words[:cut], *part, *words[cut:]]))
            s = np.array([index.vocabulary.get(w, 0) for w in decontaminate.words_of(texts[-1])])
            item = index.items[d % n][1]
            if decontaminate.edit_place(item, s)[0] <= int(0.2 * len(item)):
                near.add((d, d % n))
        found = {m[:2] for m in index.matches(texts)}
        assert len(found & near) >= 0.95 * len(near) > 100


def test_portions_keep_rows_and_bound_bytes():
    texts = ["", None, "ab", "c" * 30, "é" * 4, "", "d" * 9, "e", None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["i", "t"]), pa.RecordBatch.from_pydict({"i": [9], "t": ["f"]})]
    got = list(portions(iter(batches), 1, limit=10))
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    sizes = [[len((r["t"] or "").encode()) for r in b.to_pylist()] for b in got]
    assert all(sum(s) <= 10 or len(s) == 1 for s in sizes) and max(map(sum, sizes)) == 30
    nothing = pa.RecordBatch.from_arrays([pa.nulls(2)], names=["t"])
    assert list(portions(iter([nothing]), 0)) == [nothing] and list(portions(iter([batches[1].slice(0, 0)]), 1)) == []


def test_licenses_of_one_family_are_told_apart(spark):
    """Labels written by hand, without the operator's rules."""
    from lexmill.llm import licenses

    short = "x this work is licensed under the gnu {}general public license version {} y"
    long = "you can redistribute it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or later"
    cases = [(short.format(a, v), label) for a, v, label in (("", "3", "gpl-3"), ("", "2", "gpl-2"), ("affero ", "3", "agpl-3"), ("lesser ", "3", "lgpl-3"), ("lesser ", "2.1", "lgpl-2.1"), ("library ", "2", "lgpl-2"))]
    cases += [(long.format(a, v), label) for a, v, label in (("", "3", "gpl-3"), ("", "2", "gpl-2"), ("Affero ", "3", "agpl-3"), ("Lesser ", "3", "lgpl-3"), ("Lesser ", "2.1", "lgpl-2.1"), ("Library ", "2", "lgpl-2"))]
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    cases += [(creative.format(w), label) for w, label in (("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NoDerivatives", "cc-by-nd"), ("-NonCommercial", "cc-by-nc"), ("-NonCommercial-ShareAlike", "cc-by-nc-sa"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd"))]
    grant = "permission to use, copy, modify and/or distribute this software for any purpose with or without fee is hereby {}"
    cases += [(grant.format("granted"), "isc"), (grant.format("denied"), ""), ("permission to use copy modify and distribute this software for any purpose without fee is hereby denied", "")]
    cases += [("Redistribution and use in source and binary forms, with or without modification, are forbidden", ""), (f"{cases[2][0]} . . {'word ' * 30} {cases[0][0]}", "agpl-3,gpl-3")]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {cases[r["id"]][0]: r["labels"] for r in rows} == dict(cases)


def test_licenses_with_all_places_taken(spark, monkeypatch):
    """Looking for templates' words first changes the work, not the result."""
    from lexmill.llm import licenses

    texts = ["", None, "under the mit", "x under the MIT license y", "released under the mit license, license version 2", "cc by nc cc by nc", "apache license version 2.0 " * 3, " ".join(licenses.NOTICES[1][1].split()[3:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = sorted(map(tuple, licenses.scan_licenses(df).collect()))
    monkeypatch.setattr(licenses, "LISTED_WORDS", 0)
    assert first == sorted(map(tuple, licenses.scan_licenses(df).collect())) and first[3][5] == "mit" and first[5][2] == 2
