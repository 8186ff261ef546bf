"""Document quality from a linear-chain conditional random field over lines.

A text's lines are labelled good or bad together. A line's potential comes from its own measures and its neighbours';
two more weights per pair of states tie adjacent lines. Weights maximise the likelihood of a bounded sample in which
every line has its document's label. Forward-backward gives each line's marginal of being good; a document's quality is
their mean, weighted by line lengths, and is calibrated on documents of the sample that the fit didn't see.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import logistic
from lexmill.llm.labelled import held_out, labelled_sample, rated

#: lines of a training chain; longer documents make several chains
CHAIN, STEPS, RATE, RIDGE = 64, 120, 0.2, 1e-3
MEASURES = 11
#: labelled ids of each class for the fit, at most
SAMPLE = 1500
_WORD = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS, _UPPER, _STOPS, _SPACE = b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-", b" \t\r\n\x0b\x0c"


def lines_of(text: str | None) -> list[bytes]:
    """The lines that hold more than white space; one empty line if there is none."""
    return [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()] or [b""]


def measure(line: bytes) -> list[float]:
    """Numbers about a line, whatever its language: shares of characters and words, all bounded."""
    words, n = line.split(), max(1, len(line))
    k = max(1, len(words))
    odd = len(line.translate(None, _WORD + _SPACE + _STOPS))
    stops = n - len(line.translate(None, _STOPS))
    again = sum(map(eq, words, words[1:]))
    bare = sum(1 for w in words if len(w) == 1 and w in b"|*#=_~-+/\\<>")
    return [
        odd / n, min(1.0, odd / k), again / k, 1 - len(set(words)) / k, bare / k, stops / n,
        (n - len(line.translate(None, _DIGITS))) / n, (n - len(line.translate(None, _UPPER))) / n,
        min(1.0, n / k / 20), math.log1p(n) / 10, 1.0 if line.rstrip()[-1:] in (b".", b"!", b"?", b":") else 0.0,
    ]


def observe(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of own, previous and next measures and a constant, lines of each document)."""
    own = np.array([measure(x) for lines in docs for x in lines], dtype=np.float64).reshape(-1, MEASURES)
    sizes = np.array([len(x) for x in docs])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    starts = np.cumsum(sizes) - sizes
    before[starts] = after[starts + sizes - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), sizes


def marginals(potential: list[float], tie: list[list[float]]) -> list[float]:
    """P(good) of each line of a chain. potential: log-odds of good against bad; tie: factors from state to state."""
    good = [math.exp(max(-30.0, min(30.0, p))) for p in potential]
    (bb, bg), (gb, gg) = tie
    forward, a, b = [], 0.5, 0.5  # bad, good
    for k, g in enumerate(good):
        if k:
            a, b = a * bb + b * gb, a * bg + b * gg
        b *= g
        s = a + b
        a, b = a / s, b / s
        forward.append((a, b))
    out, x, y = [0.0] * len(good), 1.0, 1.0
    for k in range(len(good) - 1, -1, -1):
        a, b = forward[k]
        out[k] = b * y / (a * x + b * y)
        y *= good[k]
        x, y = bb * x + bg * y, gb * x + gg * y
        s = x + y
        x, y = x / s, y / s
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: list[list[float]]
    calibration: tuple | None = None

    def document(self, docs: list[list[bytes]]) -> np.ndarray:
        """Rows of a document's length-weighted mean marginal, as log-odds, and its least marginal."""
        x, sizes = observe(docs)
        potential = ((x - self.mean) / self.scale @ self.weights).tolist()
        out, at = [], 0
        for lines, n in zip(docs, sizes.tolist()):
            m = marginals(potential[at : at + n], self.tie)
            at += n
            long = [len(x) + 1 for x in lines]
            good = sum(p * w for p, w in zip(m, long)) / sum(long)
            good = min(max(good, 1e-6), 1 - 1e-6)
            out.append([math.log(good / (1 - good)), min(m)])
        return np.array(out).reshape(len(docs), -1)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        return logistic.logits(self.document([lines_of(t) for t in texts]), self.calibration) if texts else np.empty(0)


def _fit(docs: list[list[bytes]], y: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient ascent on the conditional likelihood, all chains at once."""
    x, sizes = observe(docs)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1] = 0
    scale[scale < 1e-6] = 1.0
    x = (x - mean) / scale
    cuts = [(i, min(CHAIN, n - j), at + j) for i, (n, at) in enumerate(zip(sizes, np.cumsum(sizes) - sizes)) for j in range(0, n, CHAIN)]
    owner, length, start = (np.array(c) for c in zip(*cuts))
    rows, there = start[:, None] + np.arange(CHAIN)[None, :], np.arange(CHAIN)[None, :] < length[:, None]
    rows = np.where(there, rows, 0)
    label, each = y[owner].astype(float), weight[owner]
    total = (each[:, None] * there).sum()
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(t), np.zeros_like(t)]]
    for step in range(1, STEPS + 1):
        g = np.where(there, np.clip((x @ w)[rows], -30, 30), 0)
        e, factor = np.stack([np.ones_like(g), np.exp(g)], axis=2), np.exp(t)
        f, b = np.empty_like(e), np.empty_like(e)
        cur = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        f[:, 0] = cur
        for k in range(1, CHAIN):
            nxt = (cur @ factor) * e[:, k]
            nxt /= nxt.sum(axis=1, keepdims=True)
            cur = np.where(there[:, k, None], nxt, cur)
            f[:, k] = cur
        back = np.ones_like(cur)
        for k in range(CHAIN - 1, -1, -1):
            b[:, k] = back
            if k:
                nxt = (e[:, k] * back) @ factor.T
                nxt /= nxt.sum(axis=1, keepdims=True)
                back = np.where(there[:, k, None], nxt, back)
        m = f * b
        m /= m.sum(axis=2, keepdims=True)
        miss = np.where(there, (label[:, None] - m[:, :, 1]) * each[:, None], 0)
        dw = np.zeros_like(w) + np.bincount(rows.ravel(), weights=miss.ravel(), minlength=len(x)) @ x / total - RIDGE * w
        pair = f[:, :-1, :, None] * factor[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        inner = (there[:, 1:] * each[:, None])[:, :, None, None]
        seen = np.zeros((2, 2))
        for s in (0, 1):
            seen[s, s] = ((length - 1) * each)[label == s].sum()
        dt = (seen - (pair * inner).sum(axis=(0, 1))) / total - RIDGE * t
        for p, d, (m1, m2) in ((w, dw, moments[0]), (t, dt, moments[1])):
            m1 += 0.1 * (d - m1)
            m2 += 0.01 * (d * d - m2)
            p += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w, np.exp(t).tolist())


def train(texts: list[str | None], good: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """The field from two thirds of the documents, calibration on the rest; None without documents of both classes.

    stands_for: how many labelled rows of each class a sampled one stands for."""
    y = np.array(good)
    part = np.arange(len(y)) % 3 == 2
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        return None
    docs = [lines_of(t) for t in texts]
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) * len(y)
    model = _fit([d for d, out in zip(docs, part) if not out], y[~part], weight[~part])
    x = model.document([d for d, out in zip(docs, part) if out])
    model.calibration = logistic.fit(x, y[part], np.where(y[part] == 1, stands_for[1], stands_for[0]))
    return model


def rate(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in one more column; nothing is shuffled. Null and empty texts are one empty line; without a model all scores are 1."""
    return rated(docs, lambda texts: model.logits(texts) if model else np.full(len(texts), np.inf), text_col, name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 3, 1)
    model = train(*labelled_sample(docs, labels, "quality", ~held, SAMPLE))
    scored = rate(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
