"""Groups of texts whose sets of word shingles are similar, by SimHash and BK-trees.

Texts with a Jaccard similarity of 0.8 differ in some ten of 64 SimHash bits, too many for
shards by blocks of bits. So a shard is a band of two least hashes of the shingle set:
similar sets share one of ten bands with probability over 0.9999. A shard's distinct
fingerprints form a BK-tree, in which a text looks up those within a wide radius. A
fingerprint is folded from the distinct shingles, as the similarity is one of sets. Of what is
found, texts go together if their numbers of shingles allow the similarity and a sketch of
64 least hashes (one byte each) does not speak against it; a shard of many near copies takes one
search, as its components are grown one by one.

What is linked so makes candidate groups, within which the exact similarity of the sets
decides. A group goes to one task. In a large one every set is first compared with that of its
least node; only the sets that are not similar to it are then held against all others, in tiles
of bounded size, each pair of tiles to a task. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bktree import Also
from .bktree import label as least_reachable
from .common import byte_slices, in_tiles, materialize, n_shuffle
from .components import connected_components
from .simhash import KEY, TILE_ROWS, _search_shards, fold_bytes, shingle_digests

BANDS, BAND_ROWS, RADIUS, TILE, SKETCH = 10, 2, 24, 512, 64
#: Standard errors by which a sketch must fall short of the similarity to speak against it: for a similar pair below 1e-5.
SURE = 4.75
_RNG = np.random.default_rng(42)
_MULTIPLY = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, width)), ">u8").astype(np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) hashes of two least hashes each; the sets must not be empty."""
    flat = np.concatenate(sets)
    head = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    least = np.empty((len(sets), BANDS * BAND_ROWS), np.uint64)
    for k, m in enumerate(_MULTIPLY):
        h = (flat ^ (flat >> np.uint64(31))) * m
        least[:, k] = np.minimum.reduceat(h ^ (h >> np.uint64(29)), head)
    out = least[:, ::BAND_ROWS].copy()
    for k in range(1, BAND_ROWS):
        out = (out ^ (least[:, k::BAND_ROWS] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + least[:, k::BAND_ROWS]
    return out.view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SKETCH) bytes: of the shingles whose hash begins alike a byte (1 to 255) of the least, 0 where there are none."""
    out = np.zeros((len(sets), SKETCH), np.uint8)
    if not (n := sum(map(len, sets))):
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = (flat >> np.uint64(58)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]) if n else []
    out[owner[head], part[head]] = 1 + (flat[head] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(255)
    return out


def plausible(similarity: float) -> Callable[[pa.Table], Also]:
    """For rows ``(n, sketch)``, whether pairs of them may have the similarity by their sizes and sketches."""

    def of(rows: pa.Table) -> Also:
        n = rows.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)

        def also(q: np.ndarray, r: np.ndarray) -> np.ndarray:
            ok = np.minimum(n[q], n[r]) >= similarity * np.maximum(n[q], n[r]) - 1e-6
            at = np.flatnonzero(ok)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                a, b = sketch[q[part]], sketch[r[part]]
                both, same = ((a | b) != 0).sum(axis=1), ((a == b) & (a != 0)).sum(axis=1)
                ok[part] = same >= similarity * both - SURE * np.sqrt(similarity * (1 - similarity) * both)
            return ok

        return also

    return of


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, at in byte_slices(b.column(2)):
                raw = values.tobytes()
                sets = [shingle_set(raw[x:y], width) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                fp = fold_bytes(np.concatenate(sets).astype(">u8").view(np.uint8), [len(s) for s in sets])
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[list[int]] = [[] for _ in sets]
                if full:
                    for k, row in zip(full, bands([sets[k] for k in full]).tolist(), strict=True):
                        keys[k] = row
                same = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
                cols = [pa.array(same, pa.binary()), pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in sketches(sets)], pa.binary())]
                yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *cols], ["doc_id", "text_hash", "same", "fp", "bands", "n", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, at in byte_slices(b.column(b.num_columns - 1)):
                raw = values.tobytes()
                got = [shingle_set(raw[x:y], width).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                rest = [b.column(k).slice(i, j - i) for k in range(b.num_columns - 1)]
                yield pa.record_batch([*rest, pa.array(got, pa.binary())], [*b.schema.names[:-1], "set"])

    return run


def similar(sets: list[np.ndarray], similarity: float, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a Jaccard similarity of ``similarity`` or more; with ``across`` only of sets that differ in it."""
    size = np.array([len(s) for s in sets], np.int64)
    _, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    go = n[back] > 1
    row, col = np.repeat(np.arange(len(sets)), size)[go], (np.cumsum(n > 1) - 1)[back[go]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(1, int(col[-1]) + 1) if len(col) else 0
    step = 4096
    cut = np.searchsorted(col, np.arange(0, width + step, step))
    for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        part = np.zeros((len(sets), min(step, width - k * step)), np.float32)
        part[row[x:y], col[x:y] - k * step] = 1
        both += part @ part.T
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    if across is not None:
        near &= across[:, None] != across[None, :]
    return np.nonzero(np.triu(near, 1))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, solve: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Give ``solve`` the rows of each key, of rows that come sorted by it; a row is held until its key ends."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, to_end: bool) -> tuple[list[pa.Table], pa.Table | None]:
        key = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
        head = [*np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist(), len(key)]
        parts = [table.slice(x, y - x) for x, y in zip(head, head[1:], strict=False)]
        return (parts, None) if to_end else (parts[:-1], parts[-1])

    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        if sum(x.nbytes for x in held) < most:
            continue
        done, rest = cut(pa.Table.from_batches(held), False)
        for part in done:
            if (out := solve(part)) is not None:
                yield out
        held = rest.combine_chunks().to_batches()
    if held:
        for part in cut(pa.Table.from_batches(held), True)[0]:
            if (out := solve(part)) is not None:
                yield out


def _verify(similarity: float):
    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        sets = [np.frombuffer(v, np.uint64) for v in rows.column("set").to_pylist()]
        tile = rows.column("tile").to_numpy()
        cross = rows.column("ti")[0].as_py() != rows.column("tj")[0].as_py()
        a, b = similar(sets, similarity, tile if cross else None)
        low = least_reachable(rows.num_rows, a, b)
        node = rows.column("node").to_numpy()
        go = np.flatnonzero(low != np.arange(len(low)))
        return pa.record_batch([pa.array(node[go]), pa.array(node[low[go]])], ["a", "b"]) if len(go) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, ["root", "ti", "tj"], 16 << 20, solve)

    return run


def _to_center(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(3), b.column(4), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            yield pa.record_batch([*(b.column(k) for k in range(3)), pa.array(near, pa.bool_())], ["root", "node", "center", "near"])

    return run


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of ``sets(root, ti, tj, tile, node, set)``."""
    key = ["root", "ti", "tj"]
    dealt = sets.select(*key, "tile", "node", "set").repartition(2 * n_shuffle(sets.sparkSession), *key).sortWithinPartitions(*key, "node")
    return dealt.mapInArrow(_verify(similarity), "a bigint, b bigint")


def _large_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links of large groups ``sets(root, node, set)``: with the group's least node, then of those not similar to it with all."""
    sets = materialize(sets, "neardup-large-sets")
    center = sets.groupBy("root").agg(F.min("node").alias("center"))
    center = materialize(center.join(sets.select(F.col("node").alias("center"), F.col("set").alias("center_set")), "center"), "neardup-centers")
    held = sets.join(center, "root").select("root", "node", "center", "set", "center_set")
    held = materialize(held.mapInArrow(_to_center(similarity), "root bigint, node bigint, center bigint, near boolean"), "neardup-held")
    size = lambda on: F.ceil(F.count_if(on) / TILE).cast("bigint")
    tiles = materialize(held.groupBy("root").agg(size(~F.col("near")).alias("far_tiles"), size("near").alias("near_tiles")).where("far_tiles > 0"), "neardup-tiles")
    far, all_tiles, hashed = F.col("far_tiles"), F.col("far_tiles") + F.col("near_tiles"), F.xxhash64("node")
    one = F.lit(1).cast("bigint")
    rest = held.join(tiles, "root").withColumn("tile", F.when(F.col("near"), far + F.pmod(hashed, F.greatest("near_tiles", one))).otherwise(F.pmod(hashed, far)))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("near"), far).otherwise(all_tiles) - 1)))
    rest = rest.select("root", "node", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")).join(sets.select("node", "set"), "node")
    return held.where("near and node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).unionByName(_verified(rest, similarity))


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id, text_hash, kept)``, one row for each row of ``docs`` with an id; component_id is the least id that links reach.

    Texts link if the sets of their shingles (A-Z lower-cased words; a text of fewer words is one shingle) have a Jaccard similarity of
    ``similarity`` or more; texts without a word (null and empty ones too) link with one another. Rows with a null id are left out. Texts
    are told apart by their sets, not by ids, which may repeat and be of any type that has an order. ``kept`` marks the rows of one text
    (``text_hash``) and id of each group, the least; repeated rows are all marked.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("doc_id is not null")
    feats = materialize(rows.mapInArrow(_features(width), f"doc_id {kind}, text_hash bigint, same binary, fp bigint, bands array<bigint>, n bigint, sketch binary"), "neardup-features")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    reps = feats.groupBy("same").agg(least, *[F.any_value(c).alias(c) for c in ("fp", "bands", "n", "sketch")])
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "neardup-reps")  # written, so that a text's number stays
    shards = reps.select("node", "fp", "n", "sketch", F.posexplode("bands").alias("t", "k")).withColumn("t", F.col("t").cast("bigint"))
    dealt = in_tiles(shards, ["t", "k"], "node", TILE_ROWS, "neardup").select(*KEY, "node", "fp", "n", "sketch")
    dealt = dealt.repartition(4 * n_shuffle(spark), *KEY).sortWithinPartitions(*KEY, "node")
    roots = connected_components(dealt.mapInArrow(_search_shards(RADIUS, plausible(similarity)), "a bigint, b bigint"), "neardup-candidates")
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    found = reps.select("node", "least").join(roots, "node").join(size, "root").select("root", "node", "size", "least.doc_id", "least.text_hash")
    small, large = (materialize(found.where(on).drop("size"), f"neardup-{n}") for n, on in (("small", F.col("size") <= TILE), ("large", F.col("size") > TILE)))

    def sets(chosen: DataFrame) -> DataFrame:
        """A text is read again by the id and hash of one row that has it, once if that row repeats."""
        one = chosen.join(rows, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
        return one.select("root", "node", "text").mapInArrow(_sets(width), "root bigint, node bigint, set binary")

    zero = F.lit(0).cast("bigint")
    links = _verified(sets(small.hint("merge")).withColumns({"ti": zero, "tj": zero, "tile": zero}), similarity)
    if large.take(1):
        links = links.unionByName(_large_links(sets(large), similarity))
    comps = connected_components(links, "neardup")
    named = materialize(reps.select("same", "node", "least").join(comps, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root")), "neardup-named")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(first, "root").select("same", "first")
    out = feats.select("doc_id", "text_hash", "same").join(named, "same")
    return out.select("doc_id", F.col("first.doc_id").alias("component_id"), "text_hash", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"))


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the row of the least id of each group only (of several texts with that id the one of the least hash); of repeated rows (id and
    text) one stays. Rows with a null id stay."""
    groups = materialize(near_duplicate_groups(docs, width, similarity), "neardup-groups")
    flags = groups.groupBy("doc_id", "text_hash").agg(F.min("kept").alias("_kept"), (F.count("*") > 1).alias("_again")).where("_again or not _kept")
    flags = flags.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_kept", "_again")
    # the texts are dealt by id and hash once, at every size alike: the list of ids grows with the texts and has no bound
    whole = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # columns of any name
    known = whole.where("_id is not null").join(flags.hint("merge"), ["_id", "_hash"], "left").where("coalesce(_kept, true)")
    once = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    known = known.withColumn("_n", once).where("_n = 1 or not coalesce(_again, false)")
    return known.select("row.*").unionByName(docs.where("doc_id is null"))
