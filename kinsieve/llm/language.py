"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rolled) by their place; a text's vector bundles (adds) those of
its trigrams, and a language's prototype bundles the texts' vectors that it learned from. A
text has the language of the prototype with the greatest cosine.

Bundling is a sum over trigram counts, so a task keeps one bound vector for each trigram it
has met, up to a bound, and multiplies its texts' counts with that table, some texts and some
trigrams at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, crc_fold, materialize


@dataclass(frozen=True)
class LanguageParams:
    dim: int = 1024
    letters: int = 200  #: letters with a vector of their own, the most frequent ones learned; others share by code point
    shared: int = 24
    #: Prototypes bundle this many texts at most, those with the least hash of the id.
    most_texts: int = 6000
    seed: int = 11


#: Texts and trigrams of a block of counts, and trigrams whose vectors a task keeps.
BLOCK_TEXTS, BLOCK_TRIGRAMS, MOST_BOUND = 1024, 4096, 1 << 15


@dataclass
class Profiles:
    letters: list[str]
    langs: list[str]
    proto: np.ndarray  #: a unit row for each language
    params: LanguageParams


class Encoder:
    """Trigram counts of texts and their bundled vectors."""

    def __init__(self, letters: list[str], p: LanguageParams):
        self.p, self.k = p, 1 + len(letters) + p.shared
        self.own = {c: 1 + n for n, c in enumerate(letters)}
        self.vector = np.random.default_rng(p.seed).choice(np.array([-1, 1], np.int8), (self.k, p.dim))
        self.vector[0] = np.random.default_rng(p.seed + 1).choice(np.array([-1, 1], np.int8), p.dim)  # the end of a word
        self.kind = np.full(0x110000, -1, np.int16)
        self.row = np.full(self.k**3, -1, np.int32)
        self.bound, self.n_bound = np.zeros((1024, p.dim), np.float32), 0
        self.place = np.zeros(self.k**3, np.int32)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        got = self.kind[points]
        if (new := got < 0).any():
            for x in np.unique(points[new]).tolist():
                c = chr(x)
                self.kind[x] = self.own.get(c, 1 + len(self.own) + x % self.p.shared) if c.isalpha() else 0
            got = self.kind[points]
        return got

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of distinct trigrams."""
        new = codes[self.row[codes] < 0]
        if self.n_bound + len(new) > MOST_BOUND:
            self.row[:], self.n_bound, new = -1, 0, codes
        if len(new):
            a, b, c = new // self.k**2, new // self.k % self.k, new % self.k
            v = np.roll(self.vector[a], 2, axis=1) * np.roll(self.vector[b], 1, axis=1) * self.vector[c]
            while len(self.bound) < self.n_bound + len(new):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            self.bound[self.n_bound : self.n_bound + len(new)] = v
            self.row[new] = self.n_bound + np.arange(len(new))
            self.n_bound += len(new)
        return self.bound[self.row[codes]]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(a vector for each text, does it have a letter?)"""
        joined = "\n".join(t.lower() for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._kinds(points)
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        go = (kinds > 0) | np.r_[True, kinds[:-1] > 0]  # of other characters in a row the first stands for all
        at = np.flatnonzero(go)
        s = np.r_[0, kinds[at], 0].astype(np.int64)
        mid = s[1:-1] > 0
        codes = ((s[:-2] * self.k + s[1:-1]) * self.k + s[2:])[mid]
        doc = np.searchsorted(ends, at[mid], "right")
        out = np.zeros((len(texts), self.p.dim), np.float32)
        has = np.zeros(len(texts), bool)
        has[doc] = True
        for lo in range(0, len(texts), BLOCK_TEXTS):
            x, y = np.searchsorted(doc, [lo, lo + BLOCK_TEXTS])
            if x == y:
                continue
            seen = np.unique(codes[x:y]) if y - x < self.k**3 // 64 else np.flatnonzero(np.bincount(codes[x:y]))
            self.place[seen] = np.arange(len(seen))
            place, row, m = self.place[codes[x:y]], doc[x:y] - lo, min(BLOCK_TEXTS, len(texts) - lo)
            for first in range(0, len(seen), BLOCK_TRIGRAMS):
                part = seen[first : first + BLOCK_TRIGRAMS]
                go = (place >= first) & (place < first + len(part)) if len(seen) > BLOCK_TRIGRAMS else slice(None)
                n = np.bincount(row[go] * len(part) + place[go] - first, minlength=m * len(part)).reshape(m, -1).astype(np.float32)
                out[lo : lo + m] += n @ self._vectors(part)
        return out, has


def most_common_letters(count: Counter[str], n: int) -> list[str]:
    return [c for c, _ in sorted(((c, m) for c, m in count.items() if c.isalpha()), key=lambda x: (-x[1], x[0]))[:n]]


def _sums(texts: Iterable[tuple[str, str]], letters: list[str], p: LanguageParams) -> dict[str, np.ndarray]:
    """The sum of the unit vectors of each language's texts."""
    enc, total, rows = Encoder(letters, p), {}, iter(texts)
    while part := list(islice(rows, 256)):
        got, _ = enc.bundle([t for t, _ in part])
        norm = np.linalg.norm(got, axis=1, keepdims=True)
        got = got / np.where(norm > 0, norm, 1)
        for v, (_, lang) in zip(got, part, strict=True):
            total.setdefault(lang, np.zeros(p.dim))
            total[lang] += v
    return total


def _profiles(letters: list[str], total: dict[str, np.ndarray], p: LanguageParams) -> Profiles:
    names = sorted(total)
    proto = np.array([total[x] / max(np.linalg.norm(total[x]), 1e-12) for x in names]).reshape(len(names), p.dim)
    return Profiles(letters, names, proto, p)


def learn(texts: list[str], langs: list[str], p: LanguageParams = LanguageParams()) -> Profiles:
    """Prototypes of texts in memory; without texts there are none, and every text is ``und``."""
    count: Counter[str] = Counter()
    for t in texts:
        count.update(t.lower())
    letters = most_common_letters(count, p.letters)
    return _profiles(letters, _sums(zip(texts, langs, strict=True), letters, p), p)


#: Tasks that bundle what is learned from.
LEARN_TASKS = 16


def learn_from(docs: DataFrame, p: LanguageParams = LanguageParams(), fold: int = 2, folds: int = 4) -> Profiles:
    """Prototypes from rows with a language that are not in the held-out fold, one row an id (of several that with the least hash of its text), ``most_texts``
    at most. Rows whose id, text or language is null are left out. Tasks count letters and bundle vectors; the driver adds them up."""
    mine = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != fold))
    picked = mine.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.most_texts)
    rows = mine.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id")  # most_texts ids
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("x")).select("doc_id", "x.text", "x.lang")
    sample = materialize(rows.repartition(LEARN_TASKS, "doc_id").sortWithinPartitions("doc_id"), "language-sample")

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for t in b.column(1):
                count.update(t.as_py().lower())
        yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["letter", "n"])

    count = Counter({r.letter: r.n for r in sample.mapInArrow(letters_of, "letter string, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect()})  # a row for each character
    letters = most_common_letters(count, p.letters)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), lang.as_py()) for b in batches for t, lang in zip(b.column(1), b.column(2), strict=True))
        for lang, v in _sums(rows, letters, p).items():
            yield pa.record_batch([pa.array([lang]), pa.array([v.tobytes()])], ["lang", "sum"])

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(sums_of, "lang string, sum binary").orderBy("lang", "sum").collect():  # a row for each task and language
        total[r.lang] = total.get(r.lang, np.zeros(p.dim)) + np.frombuffer(r.sum, np.float64)
    return _profiles(letters, total, p)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row for each row of ``docs``; the score is the cosine, 0 if negative.

    A text that is null or has no letter is ``und`` with score 0. Of equal cosines the first language by name counts. The text is the only input.
    """
    kept = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prof = kept.value
        enc = Encoder(prof.letters, prof.params)
        names = np.array([*prof.langs, "und"], object)
        for b in batches:
            for i, j, values, at in byte_slices(b.column(1), 1 << 20):
                raw = values.tobytes()
                vec, has = enc.bundle([raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                norm = np.linalg.norm(vec, axis=1)
                if len(prof.langs):
                    cos = vec @ prof.proto.T.astype(np.float32) / np.where(norm > 0, norm, 1)[:, None]
                    best = np.where(has, cos.argmax(axis=1), len(prof.langs))
                    score = np.where(has, np.clip(cos.max(axis=1), 0, 1), 0).astype(np.float64)
                else:
                    best, score = np.zeros(len(vec), np.int64), np.zeros(len(vec))
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
