"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a run of records. A record is

    length of the data (unsigned 64 bits), masked checksum of these 8 bytes (32 bits),
    the data, masked checksum of the data (32 bits)

all little-endian. A checksum is CRC-32, rotated right by 15 bits and raised by 0xA282EAD8,
so that a checksum over bytes that hold checksums stays useful. The data are the width of an
id in bytes (2 or 4), whether there is a document id (1 or 0), the document id (signed 64
bits) and the ids. Beside each shard ``name.rec`` stands ``name.idx``: unsigned 64-bit
offsets of all records and of the shard's end.

Shards go to the folder given through the file system that its URI names; a shard gets its
name only when whole, so tasks that run twice or are lost leave no half shard.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, n_shuffle

_HEAD = struct.Struct("<BBq")
_WORKER: dict[str, WordEncoder] = {}
#: Words and units that a worker which only counts ids keeps at most.
COUNT_WORDS, COUNT_UNITS = 150_000, 400_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def read_frames(stream) -> Iterator[bytes]:
    """The data of all records of a stream; ValueError where a checksum or a length is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("a record's length is damaged")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise ValueError("a record's data are damaged")
        yield body[:n]


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(data: bytes) -> tuple[int | None, np.ndarray]:
    width, has, doc_id = _HEAD.unpack_from(data)
    return (doc_id if has else None), np.frombuffer(data, f"<u{width}", -1, _HEAD.size)


MARKS = ".,"
#: Fixed value: the split pattern of word BPE. No alternative matches white space or looks around, so a word's pieces do not depend on the words beside it.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that may be told apart from a mark after them: A-Z, a-z and the Latin letters up to here, if the tokenizer treats them so (``_plain_letters``).
LAST_LATIN = 0x24F


def word_by_word(config: dict) -> bool:
    """Whether a tokenizer's ids of a text are, one after another, those of its words between ASCII white space.

    Every step must be local to a word: NFC (nothing joins with white space), lower-casing (a character at a time), white space to one space,
    a split that keeps only matches of ``WORD_PIECES``, bytes without a prefix, merges without chance, and added tokens that neither have
    white space in them nor take it in.
    """
    norm, pre, model = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}, config["model"]
    steps = norm.get("normalizers", [norm] if norm else [])
    space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    parts = pre.get("pretokenizers", [pre])
    return (
        all(x == space or x.get("type") in ("NFC", "Lowercase") for x in steps)
        and len(parts) == 2
        and {k: parts[0].get(k) for k in ("type", "pattern", "behavior", "invert")} == {"type": "Split", "pattern": {"Regex": WORD_PIECES}, "behavior": "Removed", "invert": True}
        and {k: parts[1].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and model["type"] == "BPE"
        and not model["dropout"]
        and model["end_of_word_suffix"] == "</w>"
        and not config["truncation"]
        and not config["padding"]
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in config["added_tokens"])
    )


class WordEncoder:
    """Ids of whole texts. Where ``word_by_word`` holds, a word is encoded once in a process, up to a bound; else every whole text is encoded."""

    def __init__(self, path: str, most_words: int = 450_000, most_units: int = 1_100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.most_units = Tokenizer.from_file(path), most_words, most_units
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab = max(vocab.values()) + 1
        self.ends = np.zeros(self.vocab, bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = [self._each([m])[0] for m in MARKS]
        self.by_word = word_by_word(json.loads(self.tokenizer.to_str())) and all(len(m) == 1 for m in self.marks)
        self.plain = self._plain_letters() if self.by_word else frozenset()
        self._clear()

    def _plain_letters(self) -> frozenset[str]:
        """Latin letters that make one piece with letters before and after them and another with a mark after them, alone and in company."""
        pieces = lambda t: [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(t))]
        letters = [c for c in map(chr, range(LAST_LATIN + 1)) if c.isalpha()]
        good = [c for c in letters if all(len(got := pieces(f"a{c}{c}a{c}{m}")) == 2 and got[1] == m for m in MARKS)]
        if any(len(pieces("".join(x) + m)) != 2 for x in (good, good[::-1]) for m in MARKS):
            return frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return frozenset(good)

    def _clear(self) -> None:
        self.older: dict[bytes, int] = {}  #: the words known before the last bound was reached; those met again move on
        self.known: dict[bytes, int] = {}  #: a word as it stands: number of its unit, times 3, and which mark follows
        self.units: dict[str, int] = {}  #: what is encoded: letters without a mark, or any other word
        self.ids, self.at = np.zeros(1 << 16, np.uint16 if self.vocab <= 1 << 16 else np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Ids of words of plain letters only. They are encoded as one text and cut after the ids that end a word; if those are not as many as the words, one by one."""
        out = []
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            ids = self._each([" ".join(part)])[0]
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist() if ids else []
            out += [ids[x:y] for x, y in zip([0, *cut], cut, strict=False)] if len(cut) == len(part) and cut[-1] == len(ids) else self._each(part)
        return out

    def _add(self, words: list[str], got: list[list[int]]) -> None:
        self.units.update(zip(words, range(len(self.units), len(self.units) + len(words)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(list(map(len, got)), dtype=np.int64)])
        while len(self.ids) < self.at[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        flat = [i for g in got for i in g]
        self.ids[self.at[-1] - len(flat) : self.at[-1]] = flat

    def _learn(self, words: list[bytes]) -> None:
        """Learn words; one of plain letters, with a full stop or comma at its end or without, has the ids of the letters and that of the mark. Others are encoded as they stand."""
        bodies, marks, plain = [], [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            mark = MARKS.find(t[-1]) + 1 if len(t) > 1 else 0
            body = t[:-1] if mark else t
            if go := (body.isascii() and body.isalpha()) or self.plain.issuperset(body):
                body = body.lower() if body.isascii() else body
            else:
                mark, body = 0, t
            bodies.append(body)
            marks.append(mark)
            plain.append(go)
        new = {b: p for b, p in zip(bodies, plain, strict=True) if b not in self.units}
        letters, others = [b for b, p in new.items() if p], [b for b, p in new.items() if not p]
        self._add(letters, self._letters(letters))
        self._add(others, self._each(others))
        self.known.update(zip(words, [3 * self.units[b] + m for b, m in zip(bodies, marks, strict=True)], strict=True))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with ``end`` after it; their offsets)."""
        if not self.by_word:
            got = [[*ids, end] for ids in self._each([t.decode("utf-8", "replace") for t in texts])]
            return np.array([i for ids in got for i in ids], np.uint32), np.r_[0, np.cumsum(list(map(len, got)), dtype=np.int64)]
        if len(self.units) > self.most_units:
            self._clear()
        if len(self.known) > self.most_words:
            self.older, self.known = self.known, {}
        words, n = [], []
        for t in texts:
            w = t.split()
            words += w
            n.append(len(w))
        code = np.array(list(map(self.known.get, words)), np.float64)  # not known: nan
        miss = np.flatnonzero(np.isnan(code))
        code[miss] = 0
        code = code.astype(np.int32)
        if len(miss):
            missing = [words[k] for k in miss.tolist()]
            new = list(dict.fromkeys(missing))
            found = list(map(self.older.get, new))
            self.known.update([(w, c) for w, c in zip(new, found, strict=True) if c is not None])
            self._learn([w for w, c in zip(new, found, strict=True) if c is None])
            code[miss] = list(map(self.known.__getitem__, missing))
        unit = code // 3
        mark = code - 3 * unit
        first, size = self.at[unit], self.at[unit + 1] - self.at[unit]
        total = np.r_[0, np.cumsum(size + (mark > 0))]
        ends = total[np.cumsum(n)] + np.arange(len(texts))  # each earlier text has an end id
        begin = total[:-1] + np.repeat(np.arange(len(texts)), n)
        out = np.full(int(total[-1]) + len(texts), end, np.uint32)
        for k, ids in enumerate(self.marks, 1):
            at = np.flatnonzero(mark == k)
            out[begin[at] + size[at]] = ids[0]
        step, left = 0, np.flatnonzero(size)
        begin, first, size = begin[left], first[left], size[left]
        while len(first):  # the ids of all words at once, one place after another
            out[begin + step] = self.ids[first + step]
            step += 1
            go = np.flatnonzero(size > step)
            if len(go) < len(size):
                begin, first, size = begin[go], first[go], size[go]
        return out, np.r_[0, ends + 1]


def _encoder(path: str) -> WordEncoder:
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name, own = f"{root}/part-{part:06d}", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        enc, offsets, tokens, out = None, [0], 0, None
        for b in batches:
            for i, j, values, at in byte_slices(b.column(1), 1 << 20):
                if out is None:
                    enc = _encoder(tokenizer)
                    width = 2 if max(enc.vocab - 1, end) < 1 << 16 else 4
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own + ".rec")
                raw = values.tobytes()
                ids, cut = enc.encode([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], end)
                tokens += len(ids)
                for doc_id, x, y in zip(b.column(0).slice(i, j - i).to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    data = frame(pack_ids(doc_id, ids[x:y], width))
                    out.write(data)
                    offsets.append(offsets[-1] + len(data))
        if out is not None:
            out.close()
            with store.open_output_stream(own + ".idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            for kind in (".idx", ".rec"):
                store.move(own + kind, name + kind)
            yield pa.record_batch([pa.array([part]), pa.array([f"part-{part:06d}"]), pa.array([len(offsets) - 1]), pa.array([tokens])], ["shard", "name", "n_records", "n_tokens"])

    return run


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for i, j, values, at in byte_slices(b.column(last), 1 << 20):
                if (key := f"count {tokenizer}") not in _WORKER:
                    _WORKER[key] = WordEncoder(tokenizer, COUNT_WORDS, COUNT_UNITS)
                raw = values.tobytes()
                _, cut = _WORKER[key].encode([raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], 0)
                yield pa.record_batch([*(b.column(k).slice(i, j - i) for k in range(last)), pa.array(np.diff(cut))], [*b.schema.names[:-1], "n_ids"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_ids`` in place of the text: its ids and an end id. Null and empty texts have the end id only."""
    rest = [c for c in docs.columns if c != text_col]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, text_col).mapInArrow(_count(tokenizer), f"{kinds}, n_ids bigint")


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write the ids of every whole text, each with the end id, to shards in ascending id order; returns ``(shard, name, n_records, n_tokens, start)``.

    ``start`` is the number of ids in all earlier shards. Null ids come first; equal ids stand by text. Null and empty texts have the end id only.
    An empty table writes no shard. ``folder`` is a URI that driver and executors share.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards or n_shuffle(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    done = dealt.mapInArrow(_write(folder, tokenizer, end), "shard bigint, name string, n_records bigint, n_tokens bigint").collect()  # a row for each shard
    out, start = [], 0
    for r in sorted(done, key=lambda r: r.shard):
        out.append((r.shard, r.name, r.n_records, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(out, "shard bigint, name string, n_records bigint, n_tokens bigint, start bigint")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with store.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as f:
                    for data in read_frames(f):
                        doc_id, ids = unpack_ids(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 1 << 14:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return run


def read_token_records(shards: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all records, read from the shards and checked against their checksums."""
    n = max(1, min(shards.count(), 4 * n_shuffle(shards.sparkSession)))
    return shards.select("name", "start").repartition(n).mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_at(folder: str, name: str, records: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of chosen records of a shard, in the order asked for, by its index."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with store.open_input_file(f"{root}/{name}.rec") as f:
        for k in records:
            f.seek(int(offsets[k]))
            yield unpack_ids(next(read_frames(f)))
