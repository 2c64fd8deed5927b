"""Statistics of whole texts that quality rules read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_bytes"]


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL = _set(b" \t\n\x0b\x0c\r"), _set(b"#*$%&|<>")
_UPPER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(48, 58)))
_MARK, _STOP = _set(b"!?"), _set(b".,;:")
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of ``window`` words that occur twice or more in it, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    go = np.flatnonzero(doc[:n] == doc[window - 1 :])
    h = doc[go].astype(np.uint64)
    for k in range(window):
        h = (h ^ ids[go + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    at, h = go[order], h[order]
    near = np.flatnonzero(h[1:] == h[:-1])
    if not len(near):
        return np.zeros(n_docs, np.int64)
    same = doc[at[near]] == doc[at[near + 1]]
    for k in range(window):
        same &= ids[at[near] + k] == ids[at[near + 1] + k]
    near = near[same]
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.r_[at[near], at[near + 1]])
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return np.bincount(doc, np.cumsum(edge[:-1]) > 0, n_docs).astype(np.int64)


def count(values: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of texts that stand one after another."""
    raw, n = values.tobytes(), len(at) - 1
    known: dict[bytes, int] = {}
    ids, n_words, dup, distinct, lines = [], np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    number = known.setdefault
    for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        text = raw[x:y]
        words = text.split()
        ids += [number(w, len(known)) for w in words]
        n_words[k], distinct[k] = len(words), len(set(words))
        full = [line for line in text.split(b"\n") if line and not line.isspace()]
        lines[k], dup[k] = len(full), len(full) - len(set(full))
    words = np.array(ids, np.int64)

    def per_text(on: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(on)][at])

    out = {"n_words": n_words, "n_dup_lines": dup, "n_distinct": distinct, "n_lines": lines, "n_bytes": np.diff(at)}
    out["word_chars"] = per_text(_POINT[values] & ~_SPACE[values])
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_stops", _STOP)):
        out[name] = per_text(table[values])
    out["n_repeat_words"] = repeat_words(words, np.repeat(np.arange(n), n_words), n)
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, *COUNTS)``, all long, one row for each row of ``docs``; a null text counts as empty.

    Words are runs without ASCII white space, lines are split at line feeds, symbols are ``#*$%&|<>``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, at in byte_slices(b.column(1)):
                got = count(values, at)
                yield pa.record_batch([b.column(0).slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in COUNTS)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
