"""Quality rules, and a hashed n-gram logistic regression behind them.

The rules count; the model judges what they pass. Its inputs are shares of hashed word one- and two-grams and of byte three-grams inside the whole
text, square-rooted and scaled to length one in either family. It is trained with full-batch steps on at most ``sample`` labelled documents,
of which every fifth is set aside to calibrate the probability (Platt). Documents are scored in Arrow batches against a fixed threshold.

Defined results. Null texts have no words, and fail. Very long texts are read whole, one at a time. Without labels of both classes the model passes all; of a label that stands twice the larger counts; a
probability that equals the threshold keeps. Repeated rows give a row each; an empty table none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, labelled_sample, map_rows, mix64, raw_texts
from foliant.llm.near_dedup import Words
from foliant.llm.text_stats import rule_counts, word_hashes


@dataclass(frozen=True)
class Rules:
    """keep: least calibrated probability of quality. sample: most labelled documents that are learned from."""

    min_words: int = 20
    max_repeat_percent: int = 30
    keep: float = 0.5
    sample: int = 3_000
    bits: int = 15
    steps: int = 150
    rate: float = 8.0
    ridge: float = 1e-4


def ngrams(text: bytes, words: list[bytes], h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words in the lower half, bytes in the upper) and their weights."""
    size, shift = 1 << bits, np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits) if len(b) > 2 else b[:0]
    families = (np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), three.astype(np.int64) + size)
    at, value = [], []
    for family in families:
        if len(family):
            low = int(family[0]) >= size
            counts = np.bincount(family - size * low, minlength=size)
            seen = np.flatnonzero(counts)
            v = np.sqrt(counts[seen] / len(family))
            at.append(seen + size * low)
            value.append(v)
    return (np.concatenate(at), np.concatenate(value).astype(np.float32)) if at else (np.empty(0, np.int64), np.empty(0, np.float32))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, at: np.ndarray, value: np.ndarray) -> float:
        z = float(self.weights[at] @ value) + self.bias
        return float(1 / (1 + np.exp(-(self.slope * z + self.shift))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cfg: Rules) -> Logistic | None:
    if len(set(y.tolist())) < 2:
        return None
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    use = np.flatnonzero(~aside)
    at, value = (np.concatenate([rows[i][k] for i in use]) for k in (0, 1))
    row = np.repeat(np.arange(len(use)), [len(rows[i][0]) for i in use])
    t, share = y[use], y[use].mean()
    weight = np.where(t == 1, 0.5 / share, 0.5 / (1 - share)) / len(use)
    w, bias, n = np.zeros(2 << cfg.bits), 0.0, 2 << cfg.bits
    speed, speed_b = np.zeros(n), 0.0
    for _ in range(cfg.steps):
        g = weight * (sigmoid(np.bincount(row, w[at] * value, len(use)) + bias) - t)
        speed = 0.9 * speed - cfg.rate * (np.bincount(at, g[row] * value, n) + cfg.ridge * w)
        speed_b = 0.9 * speed_b - cfg.rate * g.sum()
        w += speed
        bias += speed_b
    who = np.flatnonzero(aside) if aside.any() else use
    z = np.array([w[rows[i][0]] @ rows[i][1] for i in who]) + bias
    a, b = platt(z, y[who])
    return Logistic(w.astype(np.float32), float(bias), a, b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's softened targets; a slope that isn't positive is given up."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b, loss = 1.0, 0.0, np.inf
    for _ in range(50):
        p = sigmoid(a * z + b)
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * z).sum(), d.sum()])
        hess = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", cfg: Rules = Rules()) -> Logistic | None:
    rows = labelled_sample(docs, labels, label, cfg.sample)

    def start():
        known = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [ngrams(t, words := t.split(), word_hashes(words, known), cfg.bits) for t in raw_texts(batch)]
            return pa.record_batch({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "at": pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), "value": pa.array([v.tobytes() for _, v in found], pa.binary())})

        return step

    seen = sorted(map_rows(rows, start, "doc_id long, y int, at binary, value binary").collect(), key=lambda r: (r.doc_id, bytes(r.at), bytes(r.value)))  # at most cfg.sample rows
    order = np.random.default_rng(1).permutation(len(seen))
    seen = [seen[i] for i in order]
    return train([(np.frombuffer(r.at, "<i4"), np.frombuffer(r.value, np.float32)) for r in seen], np.array([r.y for r in seen]), cfg)


def judge(docs: DataFrame, model: Logistic | None, cfg: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known, model = Words(), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, p = [], []
            for text in raw_texts(batch):
                words = text.split()
                h = word_hashes(words, known)
                counts.append((len(words), *rule_counts(text, words, h)))
                p.append(model.probability(*ngrams(text, words, h, cfg.bits)) if model else 1.0)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*counts, strict=True), strict=True)} | {"probability": pa.array(p, pa.float64())})

        return step

    out = map_rows(doc_rows(docs), start, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < cfg.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * cfg.max_repeat_percent)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= cfg.keep))
