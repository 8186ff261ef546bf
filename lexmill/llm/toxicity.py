"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. What a class is trained on are those of its
documents' words, or their beginnings, that its documents have far oftener than the other's: on whole texts the trainer
fills both dictionaries with what the classes share. Strings that the trainer leaves out stand before its result, so none
is lost. A text is cut into windows of a few words, and every window is compressed with either dictionary; the difference
of the two lengths says how many bytes the toxic dictionary saves. The dictionaries are loaded as content: literals aren't
entropy-coded, and every window starts with a key that both dictionaries end with, so a window's length has no cost of its
own for a first match. The differences' sums, maxima and counts are calibrated on labelled documents that the dictionaries
didn't see, so that the score is a probability and its threshold 0.5.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import logistic
from lexmill.llm.labelled import held_out, labelled_sample, rated

WINDOW, LENGTHS, LEAST_DOCS, LEAST_RATIO = 4, (5, 6, 7, 8, 10, 12), 5, 4.0
#: bytes that the trainer may fill, its segments and the runs that it counts
TRAINED, SEGMENT, RUN = 16384, 64, 8
#: the key before each window; both dictionaries end with it
KEY = b" q0w9e8r7t6y5u4i3o2p1 "
NOISE = 2
#: labelled ids of each class for the fit, at most
SAMPLE = 2500


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _strings(word: bytes) -> list[bytes]:
    """The beginnings of a word and the whole, with the blanks around it, from short to long."""
    w = b" " + word + b" "
    return [w[:n] for n in LENGTHS if len(w) > n] + [w]


def _apart(docs: list[list[bytes]]) -> list[list[bytes]]:
    """The documents without copies and near copies, which would count a text's own words again and again: of those that share one of three least run hashes, the first."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words in docs:
        runs = [crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))]
        marks = {(m, min((r * m) & 0xFFFFFFFF for r in runs)) for m in (1, 0x9E3779B1, 0x85EBCA77)}
        if not marks & seen:
            out.append(words)
        seen |= marks
    return out


def _contrast(own: list[list[bytes]], other: list[list[bytes]]) -> set[bytes]:
    """The strings whose share of documents is higher LEAST_RATIO times and by some standard errors (more of them where more documents try more strings)."""
    counts = []
    for docs in (own, other):
        counts.append(Counter())
        for words in docs:
            counts[-1].update({s for w in set(words) for s in _strings(w)})
    (a, b), n, m = counts, len(own), len(other)
    least, out = 3.25 + 0.5 * math.log10(max(1, n)), set()
    for s, k in a.items():
        if k >= LEAST_DOCS:
            p, q = (k + 0.5) / (n + 1), (b[s] + 0.5) / (m + 1)
            if p >= LEAST_RATIO * q and (p - q) / math.sqrt(p * (1 - p) / n + q * (1 - q) / m) >= least:
                out.add(s)
    return out


def _dictionary(own: list[list[bytes]], other: list[list[bytes]]) -> bytes:
    """A trained dictionary of what sets own apart from other; its samples are, for each word there that has such a string, the longest.

    Strings that the trainer leaves out go before its result, whatever their number. It refuses a few samples; then they are all there is."""
    import zstandard as zs

    apart, longest, samples = _contrast(own, other), {}, []
    for words in own:
        for w in words:
            if w not in longest:
                longest[w] = next((s for s in reversed(_strings(w)) if s in apart), None)
            if longest[w]:
                samples.append(longest[w])
    try:
        trained = zs.train_dictionary(TRAINED, samples, k=SEGMENT, d=RUN).as_bytes()
    except zs.ZstdError:
        trained = b""
    rest: list[bytes] = []
    for s in sorted(set(samples), key=lambda s: (-len(s), s)):
        if s not in trained and not any(s in r for r in rest):
            rest.append(s)
    return b"|".join([*sorted(rest), trained])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple | None = None

    def compressors(self) -> tuple:
        import zstandard as zs

        def of(content: bytes):
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            log = max(16, (len(content) + (1 << 12)).bit_length())  # all of the dictionary is within reach
            params = zs.ZstdCompressionParameters(window_log=log, hash_log=log - 1, chain_log=15, search_log=6, min_match=6, target_length=1, strategy=zs.STRATEGY_FAST, **plain)
            return zs.ZstdCompressor(compression_params=params, dict_data=zs.ZstdCompressionDict(content + KEY, dict_type=zs.DICT_TYPE_RAWCONTENT)).compress

        return of(self.ordinary), of(self.toxic)

    def features(self, text: str | None, pair: tuple) -> list[float]:
        ordinary, toxic = pair
        words = tokens(text)
        saved = []
        for i in range(0, max(1, len(words)), WINDOW):
            window = KEY + b" ".join(words[i : i + WINDOW]) + b" "
            saved.append(len(ordinary(window)) - len(toxic(window)))
        d = np.array(saved, dtype=np.float64)
        over, n = np.maximum(d - NOISE, 0), max(1, len(words))
        return [d.max(), np.sort(d)[-2:].sum(), d.sum() / n, over.sum() / n, math.sqrt(over.sum()), math.sqrt(over.sum() / n), (over > 0).mean(), math.log1p(n)]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        pair = self.compressors()
        return logistic.logits(np.array([self.features(t, pair) for t in texts], dtype=np.float64), self.weights)


def train(texts: list[str | None], toxic: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """Dictionaries from two thirds of the documents, calibration on the rest; None without documents of both classes.

    stands_for: how many labelled rows of each class a sampled one stands for, so that 0.5 is where either class is as likely."""
    y = np.array(toxic)
    part = np.arange(len(y)) % 3 == 2
    words = [tokens(t) for t in texts]
    pick = lambda label: [w for w, t, out in zip(words, y, part) if t == label and not out]
    bad, good = _apart(pick(1)), _apart(pick(0))
    if not bad or not good or len(set(y[part])) < 2:
        return None
    model = Model(_dictionary(bad, good), _dictionary(good, bad))
    pair = model.compressors()
    x = np.array([model.features(t, pair) for t, out in zip(texts, part) if out])
    model.weights = logistic.fit(x, y[part], np.where(y[part] == 1, stands_for[1], stands_for[0]))
    return model


def rate(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in one more column; nothing is shuffled. Null and empty texts are scored as a window without words; without a model all scores are 0."""
    return rated(docs, lambda texts: model.logits(texts) if model else np.full(len(texts), -np.inf), text_col, name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 5, 0)
    model = train(*labelled_sample(docs, labels, "toxic", ~held, SAMPLE))
    scored = rate(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
