"""Removal of byte strings that an earlier document also has, by sorting suffixes.

Not every suffix is sorted. A string of ``length`` bytes contains a locally least 16-byte
token (by hash), its anchor, wherever the string stands; equal strings have equal anchors.
So suffixes are dealt and sorted by anchor:

1. Documents go to compressed packs, written once to the shared folder. Packs also sample
   tokens, whose quantiles are the splitters.
2. Each pack sends the hashes of its anchors' tokens, sorted and delta-coded; a token of one
   document only cannot begin a repeat. The answer is a bit for each hash.
3. For the others a pack sends the bytes around the anchor that hold all strings which
   belong to it (equal ones once, with their places), to the bucket of the token's range.
   A bucket sorts the starts of all strings in these bytes by multikey quicksort, eight
   bytes a character, and finds runs of equal strings and the least document of each.
4. The covered places go back to the packs.

Where a range would still be large, as there is a bound on the number of splitters, it is cut once
more, by a hash of the token. Splitters fall between different tokens only, so equal strings always meet in one bucket
and the comparison across a boundary is between different tokens; no run goes on beyond it.
What a bucket gets of a frequent string is one copy from each pack, not one from each
document. A token that many packs have may stand in very many different contexts, which one
range need not hold: its strings are parted by how far before it they start, first and
second half, and a half is dealt by a hash of the bytes that all strings of it hold (a third of them and more).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, n_shuffle

TOKEN = 16
#: Bytes of text in a pack, of which a task holds one at a time.
PACK_BYTES = 4 << 20
#: Bytes of text for which there is one bucket; splitters are held on the driver, so the number of ranges has a bound.
BUCKET_BYTES, MOST_RANGES = 6 << 20, 1 << 16
#: A token that this many packs have is a frequent one.
FREQUENT_PACKS = 256
#: Its contexts are cut into two pieces, and into one more for so many packs of the corpus.
PIECE_PACKS = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_CHUNK = 1 << 19


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed blob; bytes of one weight stand together."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    parts = [head]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    lens = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for kind, m in zip(kinds, lens.tolist(), strict=True):
        size = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, m * size, at).reshape(size, m).T
        out.append(np.ascontiguousarray(part).reshape(-1).view(kind))
        at += m * size
    return out


def token_hashes(values: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the TOKEN bytes from each place on, by doubling."""
    h, size = values.astype(np.uint64) + np.uint64(1), 1
    while size < TOKEN:
        m = len(h) - size
        h = h[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size : size + m]
        size *= 2
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def anchors(values: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, token hash, first string, last string) of the runs of strings with one anchor, over texts one after another.

    ``at`` has the texts' offsets; strings across two texts are left out.
    """
    wide = length - TOKEN + 1  # tokens in a string
    out: list[tuple[np.ndarray, ...]] = []
    room = np.zeros(len(values) + 1, bool)
    n = np.maximum(np.diff(at) - length + 1, 0)
    start = at[:-1][n > 0]
    n = n[n > 0]
    edge = np.zeros(len(values) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    room = np.cumsum(edge, dtype=np.int8) > 0
    low = np.uint64((1 << 20) - 1)
    for lo in range(0, max(0, len(values) - length + 1), _CHUNK):
        part = values[lo : lo + _CHUNK + length - 1]
        h = token_hashes(part)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # a tie goes to the first
        size = 1
        while 2 * size <= wide:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        m = len(h) - wide + 1
        key = np.minimum(key[:m], key[wide - size : wide - size + m])
        p = np.flatnonzero(room[lo : lo + m])
        if not len(p):
            continue
        best = (key[p] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (p[1:] != p[:-1] + 1)])
        last = np.r_[first[1:] - 1, len(p) - 1]
        out.append((best[first] + lo, h[best[first]], p[first] + lo, p[last] + lo))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def multikey_quicksort(words: np.ndarray, pos: np.ndarray, depth: int, tail: np.uint64, small: int = 1 << 14) -> np.ndarray:
    """Sort places by the ``depth`` eight-byte characters from each on; ``tail`` masks the last. Returns the sorted places.

    Three-way partition around a pivot character; the equal part goes on with the next one. Small parts are sorted a character at a time.
    """
    pos = pos.copy()

    def chars(p: np.ndarray, k: int) -> np.ndarray:
        c = words[p + 8 * k].astype(np.uint64)
        return c & tail if k == depth - 1 else c

    todo = [(0, len(pos), 0)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo < 2 or k == depth:
            continue
        part = pos[lo:hi]
        if hi - lo <= small:
            pos[lo:hi] = _sort_small(part, k, depth, chars)
            continue
        c = chars(part, k)
        pivot = np.partition(c[:: max(1, len(c) // 63)], 31 if len(c) >= 63 else 0)[31 if len(c) >= 63 else 0]
        less, same = c < pivot, c == pivot
        more = ~(less | same)
        a, b = int(less.sum()), int(same.sum())
        pos[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        todo += [(lo, lo + a, k), (lo + a, lo + a + b, k + 1), (lo + a + b, hi, k)]
    return pos


def _sort_small(part: np.ndarray, k: int, depth: int, chars) -> np.ndarray:
    """All ties of one character go on together: they are sorted by (tied run, next character)."""
    c = chars(part, k)
    order = np.argsort(c, kind="stable")
    part, c = part[order], c[order]
    run = np.cumsum(np.r_[False, c[1:] != c[:-1]])
    for j in range(k + 1, depth):
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        c, r = chars(part[tied], j), run[tied]
        order = np.lexsort((c, r))
        part[tied] = part[tied][order]
        c = c[order]
        new = np.zeros(len(part), bool)
        new[1:] = run[1:] != run[:-1]
        split = np.r_[False, c[1:] != c[:-1]]
        new[tied[split]] = True
        run = np.cumsum(new)
    return part


def equal_runs(words: np.ndarray, pos: np.ndarray, depth: int, tail: np.uint64) -> np.ndarray:
    """Numbers of the runs of equal strings among sorted places."""
    new = np.zeros(len(pos), bool)
    for k in range(depth):
        c = words[pos + 8 * k].astype(np.uint64)
        if k == depth - 1:
            c &= tail
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _pack(id_at: int, text_at: int, names: list[str]):
    """Rows to packs; a pack's number is made of the task and its order there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal n
            raw = np.concatenate([v for _, v, _ in held])
            lens = np.concatenate([np.diff(a) for _, _, a in held])
            rest = pa.Table.from_batches([b for b, _, _ in held]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rest)
            held.clear()
            spots = np.linspace(0, len(raw) - TOKEN, 32).astype(np.int64) if len(raw) >= TOKEN else np.zeros(0, np.int64)
            n += 1
            row = [(task << 32) | n, len(raw), zstandard.ZstdCompressor(level=6).compress(raw.tobytes()), squeeze(lens.astype(np.int32)), sink.getvalue().to_pybytes(), [raw[s : s + TOKEN].tobytes() for s in spots.tolist()]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["pack", "n_bytes", "texts", "lens", "rest", "sample"])

        size = 0
        for b in batches:
            other = pa.record_batch([b.column(k) for k in range(b.num_columns) if k != text_at], [x for k, x in enumerate(names) if k != text_at])
            for i, j, values, at in byte_slices(b.column(text_at), PACK_BYTES):
                if held and size + len(values) > PACK_BYTES:
                    yield flush()
                    size = 0
                held.append((other.slice(i, j - i), values, at))
                size += len(values)
        if held:
            yield flush()

    return run


def _open(texts: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    return values, np.r_[0, np.cumsum(unsqueeze(lens, np.int32)[0].astype(np.int64))]


def _rest(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h * _MIX >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sent(texts: bytes, lens: bytes, ids: np.ndarray, length: int, buckets: int):
    """Anchors of a pack whose text has an id, and its tokens by bucket: (anchor columns, row of each anchor, distinct hashes, bucket of each, in two documents?, place of each anchor's hash)."""
    values, at = _open(texts, lens)
    cols = anchors(values, at, length)
    doc = np.searchsorted(at, cols[0], "right") - 1
    good = ids[doc] != _NO_ID
    cols, doc = tuple(c[good] for c in cols), doc[good]
    h, back = np.unique(cols[1], return_inverse=True)
    low, high = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
    np.minimum.at(low, back, ids[doc])
    np.maximum.at(high, back, ids[doc])
    bucket = _bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return values, at, cols, doc, h[order], bucket[order], (low != high)[order], place[back]


_NO_ID = np.iinfo(np.int64).min


def _ids(rest: bytes, id_col: str) -> np.ndarray:
    return _rest(rest).column(id_col).cast(pa.int64()).fill_null(int(_NO_ID)).to_numpy()


def _tokens(id_col: str, length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, texts, lens, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                *_, h, bucket, many, _ = _sent(texts, lens, _ids(rest, id_col), length, buckets)
                heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
                rows = [(int(bucket[x]), squeeze(np.diff(h[x:y], prepend=np.uint64(0)), np.packbits(many[x:y]))) for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(h)], strict=False)]
                if rows:
                    yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([pack] * len(rows)), pa.array([x for _, x in rows], pa.binary())], ["bucket", "pack", "blob"])

    return run


def _shared_tokens(pdf: pd.DataFrame, frequent: int) -> pd.DataFrame:
    """For each pack's hashes of this bucket, in their order, whether two documents have the token, and then whether it is frequent."""
    got = [unsqueeze(x, np.uint64, np.uint8) for x in pdf["blob"]]
    hs = [np.cumsum(d, dtype=np.uint64) for d, _ in got]
    many = [np.unpackbits(m, count=len(h)).astype(bool) for (_, m), h in zip(got, hs, strict=True)]
    h, m = np.concatenate(hs), np.concatenate(many)
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    two = np.zeros(len(n), bool)
    np.logical_or.at(two, back, m)
    m, often = (two | (n > 1))[back], (n >= frequent)[back]
    cut = np.cumsum([len(x) for x in hs])[:-1]
    bits = lambda x: [np.packbits(part).tobytes() for part in np.split(x, cut)]
    return pd.DataFrame({"pack": pdf["pack"], "bucket": pdf["bucket"], "bits": bits(m), "often": bits(often)})


def _contexts(id_col: str, length: int, ranges: int, parts: int, splitters: list[bytes], pieces: int):
    """The bytes around each anchor that may begin a repeat, by the range of its token and, in it, by a hash of the token; those of a frequent token
    in ``pieces``, each by a hash of the bytes that all its strings hold."""
    buckets, wide = ranges * parts, length - TOKEN + 1
    edge = np.array([np.frombuffer(s, ">u8") for s in splitters], np.uint64).reshape(-1, 2)
    halves = edge[:, 0].astype(object) * (1 << 64) + edge[:, 1].astype(object) if len(edge) else []
    edges = sorted(halves)

    def bucket_of(token: bytes) -> int:
        at = bisect_right(edges, int.from_bytes(token, "big")) * parts
        return at + zlib.crc32(token) % parts if parts > 1 else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, texts, lens, rest, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = _ids(rest, id_col)
                values, at, (anchor, _, first, last), doc, h, bucket, _, place = _sent(texts, lens, ids, length, buckets)
                on, often = np.zeros(len(h), bool), np.zeros(len(h), bool)
                asked = [x["bucket"] for x in bits]
                for x, i, j in zip(bits, np.searchsorted(bucket, asked).tolist(), np.searchsorted(bucket, asked, "right").tolist(), strict=True):
                    on[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i).astype(bool)
                    often[i:j] = np.unpackbits(np.frombuffer(x["often"], np.uint8), count=j - i).astype(bool)
                raw = values.tobytes()
                go = on[place]
                anchor, doc, first, last, single = anchor[go], doc[go], first[go], last[go], often[place][go]
                lo, hi = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
                if single.any():  # the strings of a frequent token in pieces, by how far before the token they start
                    n = np.where(single, pieces, 1)
                    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    anchor, doc, first, last, single = (np.repeat(x, n) for x in (anchor, doc, first, last, single))
                    lo, hi = -(-piece * wide // pieces), -(-(piece + 1) * wide // pieces) - 1
                    first, last = np.where(single, np.maximum(first, anchor - hi), first), np.where(single, np.minimum(last, anchor - lo), last)
                    some = first <= last
                    anchor, doc, first, last, single, lo, hi = (x[some] for x in (anchor, doc, first, last, single, lo, hi))
                go = np.arange(len(first))
                known: dict[bytes, int] = {}
                number = np.fromiter((known.setdefault(raw[x:y], len(known)) for x, y in zip(first[go].tolist(), (last[go] + length).tolist(), strict=True)), np.int64, len(go))
                if not known:
                    continue
                sample = np.empty(len(known), np.int64)
                sample[number[::-1]] = go[::-1]
                at_token, in_pieces = anchor[sample].tolist(), single[sample].tolist()
                # all strings of a piece hold these bytes
                held = zip((anchor - lo)[sample].tolist(), (anchor - hi)[sample].tolist(), strict=True)
                to = np.fromiter(
                    (zlib.crc32(raw[x : y + length]) % buckets if cut else bucket_of(raw[a : a + TOKEN]) for (x, y), a, cut in zip(held, at_token, in_pieces, strict=True)), np.int64, len(known)
                )
                by_range = np.argsort(to, kind="stable")
                new = np.empty(len(known), np.int64)
                new[by_range] = np.arange(len(known))
                strings = list(known)
                strings, to, number = [strings[k] for k in by_range.tolist()], to[by_range], new[number]
                order = np.argsort(number, kind="stable")
                number, row, start = number[order], doc[go][order], first[go][order]
                heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                out = []
                for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(to)], strict=True):
                    i, j = np.searchsorted(number, [x, y])
                    text = np.frombuffer(b"".join(strings[x:y]), np.uint8)
                    sizes = np.fromiter(map(len, strings[x:y]), np.int32, y - x)
                    n = np.bincount(number[i:j] - x, minlength=y - x).astype(np.int32)
                    # a place is the text's id and where the string stands in the pack
                    out.append((int(to[x]), squeeze(text, sizes, n, ids[row[i:j]], start[i:j].astype(np.int32))))
                yield pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([pack] * len(out)), pa.array([x for _, x in out], pa.binary())], ["bucket", "pack", "blob"])

    return run


def _repeats(length: int):
    depth = -(-length // 8)
    over = 8 * depth - length
    tail = np.uint64(((1 << 64) - 1) ^ ((1 << (8 * over)) - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unsqueeze(x, np.uint8, np.int32, np.int32, np.int64, np.int32) for x in pdf["blob"]]
        text = np.concatenate([g[0] for g in got] + [np.zeros(8 * depth, np.uint8)])
        size = np.concatenate([g[1] for g in got]).astype(np.int64)
        n = np.concatenate([g[2] for g in got]).astype(np.int64)
        ids, start = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]).astype(np.int64)
        # the same bytes from several packs count once
        known: dict[bytes, int] = {}
        raw, at = text.tobytes(), np.r_[0, np.cumsum(size)]
        same = np.fromiter((known.setdefault(raw[x:y], len(known)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(size))
        owner = np.repeat(same, n)  # of each place
        low = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(low, owner, ids)
        some = np.empty(len(known), np.int64)
        some[same[::-1]] = np.arange(len(size))[::-1]
        count = size[some] - length + 1
        head = np.r_[0, np.cumsum(count)]
        which = np.repeat(np.arange(len(known)), count)
        where = np.repeat(at[some] - head[:-1], count) + np.arange(head[-1])
        words = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))
        place = np.full(len(text), -1, np.int64)
        place[where] = np.arange(len(where))
        pos = multikey_quicksort(words, where, depth, tail)
        back = place[pos]
        run_no = equal_runs(words, pos, depth, tail)
        heads = np.flatnonzero(np.r_[True, run_no[1:] != run_no[:-1]])
        best = np.minimum.reduceat(low[which[back]], heads)[run_no]
        least = np.empty(len(where), np.int64)
        least[back] = best  # the least document with the string, for each string of each distinct context
        most_c, least_c = np.maximum.reduceat(least, head[:-1]), np.minimum.reduceat(least, head[:-1])
        whole = most_c[owner] < ids
        part = np.flatnonzero(~whole & (least_c[owner] < ids))
        pack_of = np.repeat(np.repeat(np.arange(len(got)), [len(g[1]) for g in got]), n)
        a = [start[whole]]
        b = [start[whole] + size[some][owner[whole]]]
        k = [pack_of[whole]]
        for lo in range(0, len(part), 1 << 17):
            rows = part[lo : lo + (1 << 17)]
            m = count[owner[rows]]
            row = np.repeat(np.arange(len(rows)), m)
            step = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            hit = least[head[owner[rows]][row] + step] < ids[rows][row]
            row, step = row[hit], step[hit]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])
            end = np.r_[new[1:] - 1, len(row) - 1]
            a.append(start[rows[row[new]]] + step[new])
            b.append(start[rows[row[new]]] + step[end] + length)
            k.append(pack_of[rows[row[new]]])
        a, b, k = np.concatenate(a), np.concatenate(b), np.concatenate(k)
        order = np.lexsort((a, k))
        a, b, k = a[order], b[order], k[order]
        cut = np.searchsorted(k, np.arange(len(got) + 1))
        rows = [(int(p), squeeze(np.diff(a[x:y], prepend=0).astype(np.int32), (b[x:y] - a[x:y]).astype(np.int32))) for p, x, y in zip(pdf["pack"], cut[:-1].tolist(), cut[1:].tolist(), strict=True) if x < y]
        return pd.DataFrame({"pack": [p for p, _ in rows], "spans": [s for _, s in rows]}).astype({"pack": "int64"})

    return run


def _cut(characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts, lens, rest, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values, at = _open(texts, lens)
                edge = np.zeros(len(values) + 1, np.int32)
                for blob in spans or []:
                    step, size = unsqueeze(blob, np.int32, np.int32)
                    a = np.cumsum(step, dtype=np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if characters and gone.any():
                    char = np.cumsum((values & 0xC0) != 0x80)
                    gone = (np.bincount(char, ~gone) == 0)[char]
                begin = gone & ~np.r_[False, gone[:-1]]
                begin[at[:-1][at[:-1] < len(values)]] |= gone[at[:-1][at[:-1] < len(values)]]
                end = gone & ~np.r_[gone[1:], False]
                end[(at[1:] - 1)[at[1:] > 0]] |= gone[(at[1:] - 1)[at[1:] > 0]]
                x, y = np.flatnonzero(begin), np.flatnonzero(end) + 1
                doc = np.searchsorted(at[1:], x, "right")
                kept_at = np.r_[0, np.cumsum(~gone)][at]
                offsets = np.searchsorted(doc, np.arange(len(at))).astype(np.int32)
                spans_col = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x - at[doc]), pa.array(y - at[doc])], ["start", "stop"]))
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(kept_at.astype(np.int64).tobytes()), pa.py_buffer(values[~gone].tobytes())]).cast(pa.binary())
                table = _rest(rest)
                cols = [c.combine_chunks() for c in table.columns]
                cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
                yield pa.record_batch([*cols, pa.array(np.diff(at)), spans_col, kept], [*table.column_names, "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """Cut every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Returns the columns of ``docs`` but the text (those named n_bytes, spans or kept are replaced), with
    ``n_bytes`` (of the whole text), ``spans`` (maximal removed runs as byte offsets) and ``kept`` (the other bytes).
    One row for each row. Strings are judged on the input. Null and short texts lose nothing; a null text counts as empty. Rows
    with a null id, and rows with equal ids among themselves, remove nothing from one another. ``characters`` draws spans in to whole
    UTF-8 characters, so that what is kept is text.
    """
    if length < 2 * TOKEN:
        raise ValueError(f"length must be {2 * TOKEN} or more")
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "spans", "kept")
    names = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    packs = materialize(
        docs.mapInArrow(_pack(names.index(id_col), names.index(text_col), names), "pack bigint, n_bytes bigint, texts binary, lens binary, rest binary, sample array<binary>"), "suffix-packs"
    )
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = max(n_shuffle(spark), total // BUCKET_BYTES + 1)
    ranges = min(MOST_RANGES, wanted)
    parts = -(-wanted // ranges)
    rate = min(1.0, 64 * ranges / max(1, 32 * total / PACK_BYTES))
    picked = packs.select(F.explode("sample").alias("s")).where(F.pmod(F.xxhash64("s"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    sample = sorted(bytes(r[0]) for r in picked.collect())  # about 64 tokens a range at most, by the rate above
    splitters = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    inner = packs.select("pack", "texts", "lens", "rest")
    tokens = inner.mapInArrow(_tokens(id_col, length, ranges * parts), "bucket int, pack bigint, blob binary")
    frequent = FREQUENT_PACKS
    bits = tokens.groupBy("bucket").applyInPandas(lambda pdf: _shared_tokens(pdf, frequent), "pack bigint, bucket int, bits binary, often binary")
    bits = bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits", "often")).alias("bits"))
    pieces = min(length - TOKEN + 1, max(2, total // PACK_BYTES // PIECE_PACKS))
    contexts = inner.join(bits, "pack").select("pack", "texts", "lens", "rest", "bits").mapInArrow(_contexts(id_col, length, ranges, parts, splitters, pieces), "bucket int, pack bigint, blob binary")
    spans = contexts.groupBy("bucket").applyInPandas(_repeats(length), "pack bigint, spans binary")
    spans = materialize(spans, "suffix-spans").groupBy("pack").agg(F.collect_list("spans").alias("spans"))
    rest = [f"`{c}` {kinds[c]}" for c in names if c != text_col]
    schema = ", ".join([*rest, "n_bytes bigint", "spans array<struct<start bigint, stop bigint>>", "kept binary"])
    return inner.join(spans, "pack", "left").select("texts", "lens", "rest", "spans").mapInArrow(_cut(characters), schema)
