"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are trained on the driver with numpy, on the statistics of at most ``sample`` labelled documents (half of them at
most of either class); the statistics are computed on the executors. All trees are complete, of one depth, and held as flat arrays: node i has the
children 2 i + 1 and 2 i + 2; a leaf's place follows from its path, so that a batch goes down all trees level by level.

Defined results. Null and empty texts have zero statistics and a score like any. Without labels of both classes the score is the share of
label 1, or 0.5. Null doc_ids aren't held out. Very long texts are read whole, one at a time. Of splits with equal gains the first statistic's lowest limit is taken; of a label that stands twice
the larger. Repeated rows give a row each; an empty table none. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import doc_rows, is_held_out, labelled_sample, map_rows, raw_texts
from foliant.llm.near_dedup import Words
from foliant.llm.text_stats import FEATURES, features


@dataclass(frozen=True)
class Boosting:
    """sample: most labelled documents that are learned from."""

    sample: int = 8_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least: int = 5
    ridge: float = 1.0


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        n, depth = len(x), int(np.log2(self.leaf.shape[1]))
        total, rows = np.full(n, self.start), np.arange(n)
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, cfg: Boosting) -> Forest:
    inner, leaves = 2**cfg.depth - 1, 2**cfg.depth
    share = float(y.mean()) if len(y) else 0.5
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    if not len(y) or not 0 < share < 1:
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    out = Forest(*[np.zeros((cfg.trees, k), t) for k, t in ((inner, np.int64), (inner, float), (leaves, float))], 0.0)
    total = np.zeros(len(y))
    width = cfg.bins + 1
    for t in range(cfg.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(cfg.depth):
            first, count = 2**level - 1, 2**level
            best_gain, best = np.full(count, 1e-6), [(0, np.inf)] * count
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                at = (node - first) * width + binned[:, f]
                gs, hs, ns = (np.bincount(at, w, count * width).reshape(count, width).cumsum(1) for w in (g, h, None))
                gain = gs**2 / (hs + cfg.ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + cfg.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + cfg.ridge)
                gain[(ns < cfg.least) | (ns[:, -1:] - ns < cfg.least)] = -1
                gain[:, len(cuts[f]) :] = -1
                b = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(count), b] > best_gain):
                    best_gain[k], best[k] = gain[k, b[k]], (f, cuts[f][b[k]])
            for k, (f, limit) in enumerate(best):
                out.feature[t, first + k], out.limit[t, first + k] = f, limit
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.limit[t, node])
        at = node - inner
        value = cfg.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + cfg.ridge)
        out.leaf[t] = value
        total += value[at]
    return out


def statistics(rows: DataFrame, more: str = "") -> DataFrame:
    """doc_id, x, and one more long column on request."""

    def start():
        known = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t, known) for t in raw_texts(batch)]
            columns = {"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float32()))}
            return pa.record_batch(columns | ({more: batch.column(more)} if more else {}))

        return step

    return map_rows(rows, start, "doc_id long, x array<float>" + (f", {more} long" if more else ""))


def fit(docs: DataFrame, labels: DataFrame, label: str, cfg: Boosting = Boosting()) -> Forest:
    rows = labelled_sample(docs, labels, label, cfg.sample).withColumn("y", F.col("y").cast("long"))
    seen = sorted(statistics(rows, "y").collect(), key=lambda r: (r.doc_id, r.x))  # at most cfg.sample rows of 26 numbers
    x = np.array([r.x for r in seen], np.float32).reshape(len(seen), FEATURES)
    return train(x, np.array([r.y for r in seen], float), cfg)


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score."""

    def start():
        known = Words()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.stack([features(t, known) for t in raw_texts(batch)])
            return pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(forest.score(x), pa.float64())})

        return step

    return map_rows(doc_rows(docs), start, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: float = 0.5, cfg: Boosting = Boosting()) -> DataFrame:
    out = score_quality(docs, fit(docs, labels, label, cfg))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
