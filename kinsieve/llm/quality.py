"""Quality rules: gradient-boosted trees over statistics of a text.

Trees grow level by level on binned features with second-order gains. A feature may be
constrained: where the score may only fall as it rises, a split whose right side would be
higher is not taken, and the halves pass their middle on as a bound for all below. The
fitted trees are flattened into arrays of nodes, through which all rows go at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textstats import COUNTS, text_statistics


@dataclass(frozen=True)
class QualityParams:
    trees: int = 80
    depth: int = 4
    bins: int = 48
    rate: float = 0.15
    ridge: float = 2.0
    least_rows: int = 10  #: in a leaf
    #: The trees are fitted on this many labelled rows of statistics at most, those with the least hash of the id.
    most_rows: int = 20000
    threshold: float = 0.5


FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct", "line_words", "upper", "digits", "marks", "stops"]
#: -1: the odds of good quality never rise with the feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "marks": -1}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ``FEATURES`` for each text, from its ``COUNTS``."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_distinct"] / words,
            c["n_words"] / np.maximum(c["n_lines"], 1), c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_stops"] / words,
        ],
        axis=1,
    ).astype(np.float64)


@dataclass
class Trees:
    """Nodes of all trees in arrays: ``feature`` is -1 at leaves, which ``left`` and ``right`` repeat; ``root`` is each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The odds of good quality; rows go through a tree's levels together."""
        total = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for r in self.root:
            node = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[node]
                right = x[row, np.maximum(f, 0)] > self.cut[node]
                node = np.where(right, self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, p: QualityParams = QualityParams(), monotone: dict[int, int] | None = None) -> Trees:
    """Boosting with the logistic loss. Without rows, or with one label, there are no trees and every text has the labels' share."""
    monotone = {FEATURES.index(k): v for k, v in MONOTONE.items()} if monotone is None else monotone
    y = np.asarray(y, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)], axis=1)  # bin b: above edge b-1, up to edge b
    score = np.full(n, bias)
    for _ in range(p.trees if 0 < y.sum() < len(y) else 0):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0, 0])
        todo = [(len(nodes) - 1, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + p.ridge), low, high))
            nodes[at] = [-1, 0.0, at, at, p.rate * value]
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < p.depth and len(rows) >= 2 * p.least_rows:
                for f in range(m):
                    size = len(edges[f]) + 1
                    if size < 2:
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                    gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                    vl, vr = np.clip(-gl / (hl + p.ridge), low, high), np.clip(-gr / (hr + p.ridge), low, high)
                    gain = -(gl * vl + 0.5 * (hl + p.ridge) * vl**2) - (gr * vr + 0.5 * (hr + p.ridge) * vr**2) + (gs * value + 0.5 * (hs + p.ridge) * value**2)
                    ok = (nl >= p.least_rows) & (nr >= p.least_rows)
                    if s := monotone.get(f):
                        ok &= s * (vr - vl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            _, f, k, vl, vr = best
            if f < 0:
                score[rows] += p.rate * value
                continue
            left = binned[rows, f] <= k
            nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
            nodes[at] = [f, float(edges[f][k]), len(nodes) - 2, len(nodes) - 1, 0.0]
            bounds = [(low, high), (low, high)]
            if s := monotone.get(f):
                mid = (vl + vr) / 2
                bounds = [(low, mid), (mid, high)] if s > 0 else [(mid, high), (low, mid)]
            todo += [(len(nodes) - 2, rows[left], level + 1, *bounds[0]), (len(nodes) - 1, rows[~left], level + 1, *bounds[1])]
    t = np.array(nodes or [[-1, 0, 0, 0, 0]], np.float64)
    return Trees(t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4], np.array(roots, np.int64), p.depth, bias)


def fit_on(stats: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Trees:
    """Trees of the labelled rows of ``stats``, one row an id (of several the least), ``most_rows`` at most. Null ids and labels other than 0 and 1 are
    left out; an id with several labels counts as good if any says so."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most_rows)
    rows = stats.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COUNTS, "quality")).alias("x"))
    rows = rows.orderBy("doc_id").select("x.*").toPandas()  # most_rows rows of numbers
    return fit(features({c: rows[c].to_numpy() for c in COUNTS}), rows["quality"].to_numpy(), p)


def score_quality(stats: DataFrame, trees: Trees) -> DataFrame:
    """``stats`` with ``quality`` (the odds of good quality)."""
    kept = stats.sparkSession.sparkContext.broadcast(trees)
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = kept.value.scores(features({c: b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}))
            yield pa.record_batch([*b.columns, pa.array(got)], [*names, "quality"])

    return stats.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + ", quality double")


def quality_rules(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Statistics, ``base_failed``, ``quality`` and ``kept``, one row for each row of ``docs``.

    The base rule fails a text of fewer than 10 words, or with over a fifth of its words in repeated windows; the others are kept if
    their odds of good quality reach the threshold. Null and empty texts fail the base rule. Without labels all that pass it are kept.
    """
    stats = materialize(text_statistics(docs), "text-stats")
    trees = fit_on(stats, labels, p)
    out = score_quality(stats, trees)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = F.col("quality") >= p.threshold if len(trees.root) else F.lit(True)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
