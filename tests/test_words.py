import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import words


def cuts(syllables, longest):
    if not syllables:
        yield []
    for k in range(1, min(longest, len(syllables)) + 1):
        for rest in cuts(syllables[k:], longest):
            yield [tuple(syllables[:k]), *rest]


def test_best_path():
    """Against every cut of short texts."""
    rng = random.Random(1)
    for _ in range(200):
        scores = {" ".join(rng.choice("abc") for _ in range(rng.choice((2, 3)))): rng.random() * 5 for _ in range(8)}
        text = [rng.choice("abc") for _ in range(rng.randrange(9))]
        value = lambda cut: sum(scores[" ".join(w)] if len(w) > 1 else 0 for w in cut)
        whole = [c for c in cuts(text, 3) if all(len(w) == 1 or " ".join(w) in scores for w in c)]
        got = [tuple(w.split(words.JOIN)) for w in words.best_path(text, scores)]
        assert [s for w in got for s in w] == text and math.isclose(value(got), max(map(value, whole)))


def test_learned_words(spark):
    rng = random.Random(2)
    pairs = ["nghị định", "thông tư", "ủy ban nhân dân", "pháp lệnh"]
    loose = [f"s{i}" for i in range(30)]
    texts = [(i, ". ".join(rng.choice(pairs) if rng.random() < 0.5 else rng.choice(loose) for _ in range(30))) for i in range(300)] + [(300, None), (301, ""), (302, "Nghị")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, words string").repartition(3)
    found = {r["word"]: (r["n"], r["score"]) for r in words.collocations(docs, longest=3, min_count=10, least=2.0).collect()}
    grams, total = Counter(), 0
    for _, t in texts:
        w = (t or "").lower().replace(".", "").split()
        total += len(w)
        grams.update(" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    want = {}
    for g, n in grams.items():
        parts = g.split()
        score = math.log(n) + (len(parts) - 1) * math.log(total) - sum(math.log(grams[p]) for p in parts)
        if len(parts) > 1 and n >= 10 and score >= 2.0:
            want[g] = n, score
    assert found.keys() == want.keys() and all(found[g][0] == want[g][0] and math.isclose(found[g][1], want[g][1]) for g in want)
    assert {"nghị định", "thông tư", "ủy ban nhân"} <= found.keys()
    lexicon = words.collocations(docs, longest=3, min_count=10, least=2.0).filter(F.col("word").isin("nghị định", "thông tư", "pháp lệnh"))
    rows = {r["id"]: r["words"] for r in words.segmented(docs, lexicon).collect()}
    assert all(rows[i].replace(words.JOIN, " ").split() == (t or "").lower().replace(".", "").split() for i, t in texts)
    assert rows[300] == rows[301] == "" and f"thông{words.JOIN}tư" in " ".join(rows.values()).split()
    hits = [r["id"] for r in words.word_search(docs, lexicon, "Nghị định").collect()]
    assert sorted(hits) == [i for i, t in texts if "nghị định" in (t or "").replace(".", "")] and 302 not in hits
    assert sorted(r["id"] for r in words.word_search(docs, lexicon, "nghi dinh").collect()) == sorted(hits)


def test_runs_are_counted_once(spark):
    """What is left to plan reads counts alone; the texts' runs were made three times over. Short and null texts, runs that a hash puts together by their letters."""
    docs = spark.createDataFrame([("a b a b a b",), ("a",), ("",), (None,), ("b a",)], "text string")
    found = words.collocations(docs, min_count=2, least=-9.0)
    assert {(r["word"], r["n"]) for r in found.collect()} == {("a b", 3), ("b a", 3), ("a b a", 2), ("b a b", 2)}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString().replace("Generate explode(split(", "")


def test_hashes_are_counted_in_packed_chunks(spark, monkeypatch):
    """A row for each hash and task was shuffled; counts over several chunks and tasks add up."""
    monkeypatch.setattr(words, "CHUNK", 1000)
    rng = random.Random(4)
    values = [0, (1 << 32) - 1, 7, 1 << 22, *(rng.randrange(1 << 32) for _ in range(3000))]
    rows = [(v,) for i, v in enumerate(values) for _ in range(300 if i < 4 else 1 + i % 25)]
    rng.shuffle(rows)
    hashes = spark.createDataFrame(rows, "h long").repartition(3)
    counts = Counter(v for (v,) in rows)
    for least in (1, 20, 300, 301):
        table, want = words.frequent(hashes, least), [v for v, n in counts.items() if n >= least]
        assert words.marked(table, np.array(want, dtype=np.int64)).all() and np.unpackbits(table).sum() == len({v >> 5 for v in want})
    assert not words.frequent(hashes.limit(0), 1).any()


def test_runs_are_not_joined(spark, monkeypatch):
    """The join with frequent hashes shuffled all runs where the hashes were too many for a broadcast."""
    plans = []
    monkeypatch.setattr(words, "written", lambda df, name, **o: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), df)[1])
    monkeypatch.setattr(words, "discard", lambda *t: None)
    words.collocations(spark.createDataFrame([("a b c " * 50,)], "text string"))
    assert "Join" not in dict(plans)["runs"] and "HashAggregate" in dict(plans)["runs"]


def test_packed_steps():
    v, n = np.array([0, 1, 5, (1 << 22) - 1], dtype=np.uint32), np.array([1, 70_000, 2, 1], dtype=np.uint32)
    got = words._unpacked(words._packed(v, n))
    assert got[0].tolist() == v.tolist() and got[1].tolist() == n.tolist()
