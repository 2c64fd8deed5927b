"""Toxicity by subword-bag embeddings and a linear softmax, trained together in numpy.

A word is the bag of its own row and of the rows of its character n-grams, hashed into a
table of fixed size; its vector is their mean. A text's vector is the mean of its words',
and a linear softmax over it gives the odds of the two labels. A misspelled word that was
never seen shares most n-gram rows with the word that it comes from. A row's part in the mean
is shrunk by how little its texts' labels differ from chance (by the positive part of
1 - (z0 / z)^2, z in standard errors): rows without any difference could only tell apart the
texts that the model learns from. The same shrinkage holds for any number of texts.

The mean and the softmax's score are linear in the rows, so for scoring the trained rows
are folded into one number for each (the score's difference between the labels); a word's
number is kept while a task runs, and a text costs one lookup for each word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc_fold, materialize


@dataclass(frozen=True)
class ToxicityParams:
    dim: int = 8
    buckets: int = 1 << 17  #: rows of the n-gram table, whatever the number of texts
    n_min: int = 3
    n_max: int = 6
    chance_z: float = 3.0  #: standard errors that chance alone may give; z0 of the shrinkage
    scale: float = 100.0  #: of a text's mean, so that rates suit words that are some hundredths of a text
    epochs: int = 40
    least_steps: int = 400  #: few texts are gone through more often, until there were this many batches
    batch: int = 64
    rate: float = 0.01
    ridge: float = 1e-5
    #: The model is fitted on the labelled texts with the least hash of the id, this many at most; tasks make their bags, the driver holds those of the rows that learn.
    most_texts: int = 6000
    seed: int = 7
    threshold: float = 0.7


def word_rows(word: bytes, p: ToxicityParams) -> list[int]:
    """Table rows of a lower-cased word: its n-grams with the ends marked, and the word."""
    w = b"<" + word + b">"
    h, n, m = zlib.crc32, len(w), p.buckets
    out = [h(w[i : i + k]) % m for k in range(p.n_min, p.n_max + 1) for i in range(n - k + 1)]
    out.append(h(w, 0x5BD1E995) % m)
    return out


class _WordRows(dict):
    def __init__(self, p: ToxicityParams):
        super().__init__()
        self.p = p

    def __missing__(self, word: bytes) -> np.ndarray:
        got = self[word] = np.array(word_rows(word, self.p), np.int64)
        return got


@dataclass
class ToxicityModel:
    row: np.ndarray  #: each table row's part of the difference of the two labels' scores
    bias: float
    params: ToxicityParams

    def scores(self, texts: list[bytes], known: dict | None = None) -> np.ndarray:
        """The odds of label 1 for each text."""
        known = _WordScores(self) if known is None else known
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            words = t.lower().split()
            out[k] = sum(map(known.__getitem__, words)) / len(words) if words else 0.0
            if len(known) > 400_000:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


class _WordScores(dict):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.row, self.p = model.row.tolist(), model.params

    def __missing__(self, word: bytes) -> float:
        row, at = self.row, word_rows(word, self.p)
        got = self[word] = sum([row[k] for k in at]) / len(at)
        return got


def _bags(texts: Iterable[bytes], p: ToxicityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(table rows, weights) of each text's bag; the weights of a text add up to 1."""
    known = _WordRows(p)
    for t in texts:
        words = [known[w] for w in t.lower().split()]
        if words:
            each = np.repeat([1 / len(w) / len(words) for w in words], [len(w) for w in words])
            ids, back = np.unique(np.concatenate(words), return_inverse=True)
            yield ids, np.bincount(back, each)
        else:
            yield np.zeros(0, np.int64), np.zeros(0)
        if len(known) > 100_000:
            known.clear()


def prior(ones: int, n: int) -> float:
    """The share of label 1, drawn a little to a half."""
    return (ones + 0.5) / (n + 1)


def shrinkage(n: np.ndarray, n1: np.ndarray, share: float, p: ToxicityParams) -> np.ndarray:
    """0 to 1 for each table row, of which ``n`` texts and ``n1`` texts with label 1 have a part."""
    chance = n * share
    z = np.abs(n1 - chance) / np.sqrt(np.maximum(chance * (1 - share), 1))
    return np.maximum(0, 1 - (p.chance_z / np.maximum(z, 1e-9)) ** 2)


def fit(texts: list[bytes], labels: np.ndarray, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """A model of texts in memory: see ``fit_on``. One label only: every text gets its share of the labels."""
    y = np.asarray(labels, np.int64)
    n, n1 = np.zeros(p.buckets), np.zeros(p.buckets)
    for (ids, _), one in zip(_bags(texts, p), y.tolist(), strict=True):
        n[ids] += 1
        n1[ids] += one
    shrink = shrinkage(n, n1, prior(int(y.sum()), len(y)), p)
    return fit_bags([(ids[go], w[go]) for ids, w in _bags(texts, p) for go in [shrink[ids] > 0]], y, shrink, p)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, shrink: np.ndarray, p: ToxicityParams) -> ToxicityModel:
    """Rows and softmax trained together by Adam over small batches, in an order that the seed fixes, from the texts' bags of rows that learn."""
    share = prior(int(y.sum()), len(y))
    bias = float(np.log(share / (1 - share)))
    learns = shrink > 0
    if len(set(y.tolist())) < 2 or not learns.any():
        return ToxicityModel(np.zeros(p.buckets), bias, p)
    rng = np.random.default_rng(p.seed)
    number = np.cumsum(learns) - 1
    size = np.array([len(ids) for ids, _ in bags])
    at = np.r_[0, np.cumsum(size)]
    ids = np.concatenate([ids for ids, _ in bags])
    rows, weights = number[ids], p.scale * shrink[ids] * np.concatenate([w for _, w in bags])
    emb = rng.uniform(-1, 1, (int(learns.sum()), p.dim)) / p.dim
    soft, b = rng.normal(0, 1 / p.dim, (p.dim, 2)), np.array([0.0, bias])
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, b)]
    step = 0
    epochs = max(p.epochs, -(-p.least_steps // -(-len(y) // p.batch)))
    for epoch in range(epochs):
        rate = p.rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), p.batch):
            pick = order[lo : lo + p.batch]
            n = size[pick]
            take = np.repeat(at[pick] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            bag = np.zeros((len(pick), len(emb)))
            bag[np.repeat(np.arange(len(pick)), n), rows[take]] = weights[take]
            vec = bag @ emb
            z = vec @ soft + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(pick)), y[pick]] -= 1
            z /= len(pick)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            grads = (bag.T @ (z @ soft.T) + p.ridge * emb, vec.T @ z + p.ridge * soft, z.sum(axis=0))
            for x, (m, v), g in zip((emb, soft, b), state, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * fix * m / (np.sqrt(v) + 1e-9)
    row = np.zeros(p.buckets)
    row[learns] = p.scale * shrink[learns] * (emb @ (soft[:, 1] - soft[:, 0]))
    return ToxicityModel(row, float(b[1] - b[0]), p)


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), fold: int = 1, folds: int = 3) -> DataFrame:
    """``(doc_id, text, toxic)`` of the labelled rows to learn from: not in the held-out fold, label 0 or 1, one row an id, ``most_texts`` at most.

    An id with several labels counts as toxic if any says so; of several rows of an id the text with the least hash is taken, a null text as
    empty. Null ids and null labels are left out.
    """
    picked = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != fold))
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most_texts)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # most_texts rows of two numbers
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))


def _counts(p: ToxicityParams):
    """For all texts of a task: of how many each table row is a part, and of how many with label 1; texts and texts with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n1, texts, ones = np.zeros(p.buckets, np.int32), np.zeros(p.buckets, np.int32), 0, 0
        for b in batches:
            label = b.column(2).to_pylist()
            for k, (ids, _) in enumerate(_bags((x.as_py().encode() for x in b.column(1).fill_null("")), p)):
                n[ids] += 1
                n1[ids] += label[k]
            texts, ones = texts + len(label), ones + sum(label)
        if texts:
            yield pa.record_batch([pa.array([n.tobytes()]), pa.array([n1.tobytes()]), pa.array([texts]), pa.array([ones])], ["n", "n1", "texts", "ones"])

    return run


def _bags_of(kept, p: ToxicityParams):
    """The texts' bags of the rows that learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (ids, w) in enumerate(_bags((x.as_py().encode() for x in b.column(1).fill_null("")), p)):
                go = kept.value[ids]
                yield pa.record_batch([b.column(0).slice(k, 1), b.column(2).slice(k, 1).cast(pa.int64()), pa.array([ids[go].astype(np.int32).tobytes()]), pa.array([w[go].astype(np.float64).tobytes()])], ["doc_id", "toxic", "ids", "weights"])

    return run


#: Tasks that make the bags.
FIT_TASKS = 16


def fit_on(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """A model of ``training_rows``. Their texts stay in tasks: the driver gets counts for each table row, then each text's weights of the rows that learn."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = materialize(training_rows(docs, labels, p).repartition(FIT_TASKS, "doc_id").sortWithinPartitions("doc_id"), "toxicity-sample")
    got = sample.mapInArrow(_counts(p), "n binary, n1 binary, texts bigint, ones bigint").collect()  # a row for each task
    n, n1 = (sum((np.frombuffer(r[k], np.int32).astype(np.int64) for r in got), np.zeros(p.buckets, np.int64)) for k in (0, 1))
    shrink = shrinkage(n, n1, prior(sum(r.ones for r in got), sum(r.texts for r in got)), p)
    kept = spark.sparkContext.broadcast(shrink > 0)
    bags = sample.mapInArrow(_bags_of(kept, p), f"doc_id {kind}, toxic bigint, ids binary, weights binary").orderBy("doc_id").collect()  # most_texts rows
    return fit_bags([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.weights, np.float64)) for r in bags], np.array([r.toxic for r in bags], np.int64), shrink, p)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``, one row for each row of ``docs``: the odds that the whole text is toxic.

    Null and empty texts have the score of no words. The text is the only input of a score.
    """
    kept = docs.sparkSession.sparkContext.broadcast((model.row.astype(np.float64), model.bias, model.params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*kept.value)
        known = _WordScores(model)
        for b in batches:
            for i, j, values, at in byte_slices(b.column(1)):
                raw = values.tobytes()
                got = model.scores([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], known)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(got)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text's score is below the threshold, with all their columns."""
    kept = docs.sparkSession.sparkContext.broadcast((model.row.astype(np.float64), model.bias, model.params))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*kept.value)
        known = _WordScores(model)
        for b in batches:
            for i, j, values, at in byte_slices(b.column(text_at)):
                raw = values.tobytes()
                got = model.scores([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], known)
                yield b.slice(i, j - i).filter(pa.array(got < model.params.threshold))

    return docs.mapInArrow(run, docs.schema)
