"""Best-fit packing of texts into windows of tokens, with conflicts.

Pieces go largest first into bins kept in the order of the room left. The search starts at
the least room that takes the piece and goes on to the next larger one until a bin is
compatible: its bitmap of duplicate clusters lacks the piece's, and its bitmaps of sources
(one for each text of a source that a bin may hold) leave a place. No compatible bin: a new
one. A text longer than a window fills whole windows of its own, and the rest is packed.

Pieces are dealt to shards of a bounded number of rows by a hash, so hot sources and large
clusters spread over all shards, and each shard is packed by itself. Where rows have an order
to keep, shards are runs of it instead, short ones, and a bin's name tells its first piece's
place, so that bins by name follow the order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.sources.records import compact

from .common import materialize

SHARD_ROWS = 16384
#: Rows of a shard where an order is kept: a bin's texts stand no further apart in it.
ORDERED_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source bit, cluster bit), which come largest first; a bit is a power of two, or 0 for no conflict."""
    room: list[int] = []  # room left and bin in one number, in order
    used: list[int] = []
    clusters: list[int] = []
    sources: list[list[int]] = []
    out = []
    for length, source, cluster in pieces:
        k = bisect_left(room, length << 32)
        while k < len(room):
            b = room[k] & 0xFFFFFFFF
            if not (clusters[b] & cluster or sources[b][-1] & source):
                del room[k]
                break
            k += 1
        else:
            b = len(used)
            used.append(0)
            clusters.append(0)
            sources.append([0] * per_source)
        out.append((b, used[b]))
        used[b] += length
        clusters[b] |= cluster
        for i, plane in enumerate(sources[b]):
            if not plane & source:
                sources[b][i] |= source
                break
        if used[b] < capacity:
            insort(room, (capacity - used[b]) << 32 | b)
    return out


def _bits(keys: pd.Series) -> list[int]:
    """A bit for each value that two pieces share; values of one piece, and null, have no conflict."""
    n = keys.value_counts()
    number = {k: 1 << i for i, k in enumerate(sorted(n.index[n > 1]))}
    return [number.get(k, 0) for k in keys.where(keys.notna(), None)]


def pack(docs: DataFrame, capacity: int, per_source: int = 2, id_col: str = "doc_id", source_col: str = "source", cluster: Column | None = None, length: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Pieces ``(doc_id, source, piece, start, n_tokens, bin_id, bin_offset)``; every token of every row is in one piece.

    A row's length is its words and an end token, or ``length``; its cluster is the md5 of the text, or ``cluster``. A bin holds no two
    pieces of a cluster and at most ``per_source`` of a source; rows with a null source or cluster conflict with nothing there. Null and
    empty texts are one end token. Equal pieces stand by id and cluster. An empty table gives no rows. With ``order`` (columns) bins hold
    rows of a run of ``ORDERED_ROWS`` in that order, and their names sorted follow it. Without it a row's shard comes of a hash of its id,
    source, cluster, length and number among equal rows, so bins are the same however the rows are dealt out and read.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be 1 or more")
    size = F.regexp_count("text", F.lit(WORD)) + 1 if length is None else length
    same = F.md5("text") if cluster is None else cluster
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), same.cast("string").alias("cluster"), F.coalesce(size, F.lit(1)).cast("bigint").alias("size"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)])
    by = [f"_by{k}" for k in range(len(order))]
    if order:
        rows = materialize(rows.orderBy(*by).drop(*by).withColumn("uid", F.monotonically_increasing_id()), "pack-rows")
        rows = materialize(compact(rows, "uid"), "pack-order")  # places without gaps
    else:
        light = ["doc_id", "source", "cluster", "size"]  # ids and numbers, not texts; equal rows are counted and told apart by number
        rows = rows.groupBy(*light).count().select(*light, F.explode(F.sequence(F.lit(1).cast("bigint"), "count")).alias("copy"))
        same = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in light]))
        rows = materialize(rows.withColumn("uid", F.concat_ws("-", same, F.col("copy").cast("string"))).drop("copy"), "pack-rows")
    full = F.expr(f"size div {int(capacity)}")
    whole = rows.where(full > 0).select("doc_id", "source", "uid", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
    # a whole window is a bin of its own, named by its row and place
    name = F.format_string("%012d-%09d" if order else "w-%s-%d", F.col("uid"), F.col("piece"))
    whole = whole.select("doc_id", "source", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"), name.alias("bin_id"), F.lit(0).cast("bigint").alias("bin_offset"))
    rest = rows.where(F.col("size") % capacity > 0).select("uid", "doc_id", "source", "cluster", full.alias("piece"), (F.col("size") % capacity).alias("n_tokens"))
    if order:
        rest = rest.withColumn("shard", F.expr(f"uid div {int(ORDERED_ROWS)}"))
    else:
        rest = rest.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-rows.count() // SHARD_ROWS)))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["uid"] if order else ["doc_id", "cluster", "source", "uid"]
        pdf = pdf.sort_values(["n_tokens", *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        got = best_fit(zip(pdf["n_tokens"].tolist(), _bits(pdf["source"]), _bits(pdf["cluster"]), strict=True), capacity, per_source)
        shard = int(pdf["shard"].iloc[0])
        out = pdf[["doc_id", "source", "piece"]].copy()
        out["start"], out["n_tokens"] = pdf["piece"] * capacity, pdf["n_tokens"]
        if order:
            first: dict[int, tuple[int, int]] = {}
            for (b, _), at in zip(got, zip(pdf["uid"].tolist(), pdf["piece"].tolist(), strict=True), strict=True):
                first[b] = min(first.get(b, at), at)
            out["bin_id"] = ["{:012d}-{:09d}".format(*first[b]) for b, _ in got]
        else:
            out["bin_id"] = [f"s-{shard}-{b}" for b, _ in got]
        out["bin_offset"] = [x for _, x in got]
        return out

    schema = f"doc_id {kind}, source string, piece bigint, start bigint, n_tokens bigint, bin_id string, bin_offset bigint"
    return whole.unionByName(rest.groupBy("shard").applyInPandas(run, schema))
