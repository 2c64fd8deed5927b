"""SimHash fingerprints and the groups that they link, found with BK-trees.

Fingerprints within the radius of one another agree on whole blocks of bits (pigeonhole),
so rows are dealt by the values of those blocks and each block value is one shard. A
shard's distinct fingerprints form a BK-tree; the tree and its queries are sent to one
task, in batches, and the search follows only edges within the radius. A shard of very many
fingerprints is cut into tiles, each pair of which is a task's. A task gives back one link
per fingerprint (to a fingerprint that its shard connects it with), not all pairs; a
distributed contraction joins the links of all shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bktree
from .common import byte_slices, in_tiles, materialize, n_shuffle
from .components import connected_components

SEED = 42
#: Rows of a shard's tile, and of a shard whose components are grown one by one.
TILE_ROWS, GROW_ROWS = 1 << 14, 256
KEY = ["t", "k", "ti", "tj"]
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(text: bytes, width: int) -> list[bytes]:
    """XXH64 digests (big-endian) of all shingles of a text, repeats included: A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return [h(joined, SEED)]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return [h(joined[a:b], SEED) for a, b in zip(at[: len(words) - width + 1].tolist(), (at[width:] - 1).tolist(), strict=True)]


def fold(digests: list[list[bytes]]) -> np.ndarray:
    """A fingerprint for each list of digests: a bit is 1 if set in over half of them; no digests: 0."""
    return fold_bytes(np.frombuffer(b"".join(x for d in digests for x in d), np.uint8), [len(d) for d in digests])


def fold_bytes(flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    """``fold`` of digests whose bytes stand one after another, of each list as many as ``sizes`` says."""
    n = np.array(sizes, np.int64)
    flat = flat.reshape(-1, 8)
    owner = np.repeat(np.arange(len(n)), n)
    bits = np.zeros((len(n), 64), np.int64)
    for k in range(8):
        seen = np.bincount(owner * 256 + flat[:, k], minlength=len(n) * 256).reshape(-1, 256)
        bits[:, 8 * k : 8 * k + 8] = seen @ _ONES
    on = (2 * bits > n[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint's 64 bits as a signed long, one row for each row of ``docs``.

    Null and empty texts and texts without a word have fingerprint 0; a text of fewer words than a shingle has one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, at in byte_slices(b.column(1)):
                raw = values.tobytes()
                fp = fold([shingle_digests(raw[x:y], width) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of ``blocks - radius`` whole blocks: fingerprints within the radius agree under at least one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(one[k] for k in ks) for ks in combinations(range(blocks), blocks - radius)]


def plan_blocks(n: int, radius: int, shard: int = 4096) -> int:
    """The fewest blocks for which ``n`` even fingerprints make shards of about ``shard`` at most."""
    blocks = radius + 1
    while blocks < min(64, radius + 4) and n >> (64 * (blocks - radius) // blocks) > shard:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search_shards(radius: int, also: Callable[[pa.Table], bktree.Also] | None = None):
    """Links ``(a, b)`` between the nodes of rows ``(t, k, ti, tj, node, fp, ...)`` that come sorted by their shard's tiles; ``also`` makes of rows a test of their pairs."""
    grow = GROW_ROWS

    def links(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(k).to_numpy() for k in KEY], axis=1)
        node, value = rows.column("node").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        shard = np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) - 1
        size = np.bincount(shard)[shard]
        low = np.arange(len(node))

        def holds(at: np.ndarray) -> bktree.Also:
            return also(rows.take(pa.array(at))) if also else lambda q, r: np.ones(len(q), bool)

        few = np.flatnonzero((size > 1) & (size <= grow))  # shards of one need no tree
        if len(few):
            low[few] = few[bktree.components_small(np.unique(shard[few], return_inverse=True)[1], value[few], radius, holds(few))]
        for s in np.unique(shard[size > grow]).tolist():
            at = np.flatnonzero(shard == s)
            low[at] = at[bktree.components_large(value[at], radius, holds(at))]
        go = low != np.arange(len(low))
        return pa.record_batch([pa.array(node[go]), pa.array(node[low[go]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, wait = 0, 1 << 16
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < wait:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([rows.column(k).to_numpy() for k in KEY], axis=1)
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(last):  # the last shard may go on in the next batch
                yield links(rows.slice(0, last[-1] + 1))
                rows = rows.slice(last[-1] + 1)
            held, n = rows.combine_chunks().to_batches(), rows.num_rows
            wait = max(1 << 16, 2 * n)
        if n:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3, n: int | None = None) -> DataFrame:
    """``(a, b)`` links between the distinct fingerprints of ``fps(fp)`` that connect all within ``radius`` bits of each other."""
    blocks = plan_blocks(fps.count() if n is None else n, radius)
    keys = F.array(*[F.struct(F.lit(k).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("k")) for k, m in enumerate(block_masks(radius, blocks))])
    dealt = in_tiles(fps.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp"), ["t", "k"], "fp", TILE_ROWS, "simhash")
    dealt = dealt.select(*KEY, F.col("fp").alias("node"), "fp").repartition(4 * n_shuffle(fps.sparkSession), *KEY).sortWithinPartitions(*KEY, "fp")
    return dealt.mapInArrow(_search_shards(radius), "a bigint, b bigint")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``; component_id is the least id that links reach.

    Equal fingerprints are linked. A null id is kept and never is a component's id unless all are null. An empty table gives no rows.
    """
    fp = materialize(fingerprints(docs, width, id_col, text_col), "simhash-fp")
    distinct = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius), "simhash")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")
