"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors at random to eight dimensions and decodes them to the nearest
point of the lattice E8, whose Voronoi cell is the bucket. Near vectors often fall into
neighbouring cells, so a vector also visits the nearest other cells (by its distance to their
points). In a cell its residents are compared with one another and with the visitors, by
cosine in double precision. Whether two vectors meet depends on them alone, not on how many
others there are: all labels have the same cells. At the threshold vectors meet in some table
with probability over 0.99.

Exact copies are one vector with a weight. The vectors of a label are dealt into tiles, packed
with the numbers of their cells; a task gets a pair of tiles and looks the cells up in memory,
so a vector is not copied for each cell. Pairs of tiles are taken in rounds, in each of which
a vector is sent twice, so disk does not grow with the tiles. Two vectors are in one pair of
tiles only, and a pair that meets in several cells counts in the first of them, so that tasks
give back sums of links for each vector and links to one root each, never pairs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import label as least_reachable
from .common import drop_tables, materialize, n_shuffle, tables_made
from .components import connected_components

#: Vectors of 64 components in a tile (of others as many as have the same bytes), labels with fewer vectors than which share a bin, vectors of a bin.
TILE, SMALL, BIN = 1 << 17, 2048, 8192
#: Rows packed at a time, rows of a blob, products held at a time, pairs reduced at a time.
PACK_ROWS, BLOB_ROWS, BLOCK, PAIRS = 1 << 16, 4096, 1 << 21, 1 << 18


@dataclass(frozen=True)
class LatticeParams:
    tables: int = 4
    probes: int = 6
    scale: float = 0.7  #: of the projection; the lattice's cells have volume 1
    blocks: int = 1  #: lattice points in a key
    seed: int = 5


#: Settings for a cosine of 0.93, with the distinct vectors of a label up to which each compares fewest pairs. By simulation two vectors at it meet with
#: probability 0.996, two random ones of the first with 0.015, of the others below 0.0001. The first is used for all labels unless a caller names another.
LEVELS = [(1 << 15, LatticeParams()), (1 << 22, LatticeParams(22, 2, 0.6, 2)), (1 << 62, LatticeParams(25, 2, 0.45, 3))]


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two of +-1, or all +-1/2 with an even number of minus signs."""
    whole = [[(a if k == i else b if k == j else 0) for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, np.float64)


STEPS = _shortest()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    out = np.rint(y)
    off = y - out
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(out.sum(axis=1).astype(np.int64) & 1)
    out[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return out


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of D8 or of D8 moved by a half."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _hash(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], np.uint64)
    for k in range(points.shape[-1]):
        h = (h ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, p: LatticeParams) -> np.ndarray:
    """(rows, tables, 1 + probes) hashes: the own cell, then the visited ones, one step of one block away."""
    out = np.empty((len(x), p.tables, 1 + p.probes), np.int64)
    for t in range(p.tables):
        y = x @ np.random.default_rng([p.seed, t, x.shape[1]]).normal(0, p.scale, (x.shape[1], 8 * p.blocks))
        parts = [slice(8 * k, 8 * k + 8) for k in range(p.blocks)]
        own = np.concatenate([nearest_e8(y[:, at]) for at in parts], axis=1)
        off = np.concatenate([(own[:, at] - y[:, at]) @ STEPS.T for at in parts], axis=1)
        order = np.argpartition(off, p.probes - 1, axis=1)[:, : p.probes]
        all_points = np.repeat(own[:, None], 1 + p.probes, axis=1)
        for j in range(p.probes):
            for k, at in enumerate(parts):
                go = order[:, j] // len(STEPS) == k
                all_points[go, 1 + j, at] += STEPS[order[go, j] % len(STEPS)]
        out[:, t] = _hash(all_points)
    return out


def _buckets(x: np.ndarray, p: LatticeParams) -> np.ndarray:
    """(rows, tables, 1 + probes) cells of unit vectors, as numbers below 2^16; where cells share a number more pairs are compared, whatever their labels."""
    return ((cells(x, p).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


PACKED = "grp bigint, size bigint, tile bigint, tiles bigint, label binary, rep binary, weight binary, vec binary, cells binary"


def _pack(p: LatticeParams, kind: type):
    """Rows ``(grp, size, tile, tiles, label, rep, weight, vec)`` to blobs of one tile."""

    def packed(rows: pa.Table) -> Iterator[tuple]:
        key = np.stack([rows.column(k).to_numpy() for k in ("grp", "size", "tile", "tiles")], axis=1)
        label, rep, weight = (rows.column(k).to_numpy() for k in ("label", "rep", "weight"))
        vec = rows.column("vec").combine_chunks()
        flat, at = vec.flatten().to_numpy(zero_copy_only=False), vec.offsets.to_numpy() - vec.offsets[0].as_py()
        order = np.lexsort((rep, label, *key.T[::-1]))
        head = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]).any(axis=1), True])
        for x, y in zip(head[:-1].tolist(), head[1:].tolist(), strict=True):
            for lo in range(x, y, BLOB_ROWS):
                some = order[lo : min(lo + BLOB_ROWS, y)]
                raw = flat[at[some][:, None] + np.arange(key[some[0], 1])].astype(kind)
                cell = np.concatenate([_buckets(unit(raw[k : k + 1024]), p) for k in range(0, len(some), 1024)])
                yield (*key[some[0]].tolist(), *[c.tobytes() for c in (label[some], rep[some], weight[some], raw, cell)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PACKED.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 5
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            made = list(packed(pa.Table.from_batches(held)))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows + b.nbytes // 512
            if size >= PACK_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


class _Tile:
    """A tile's vectors; in each table their cells' lists: ``own`` of residents, ``all`` of residents and visitors, in the order of the cells."""

    def __init__(self, blobs: list[tuple], size: int, p: LatticeParams, kind: type):
        read = lambda k, t: np.concatenate([np.frombuffer(b[k], t) for b in blobs])
        self.label, self.rep, self.weight = (read(k, np.int64) for k in range(3))
        self.raw = read(3, kind).reshape(-1, size)
        self.cells = read(4, np.uint16).reshape(-1, p.tables, 1 + p.probes)
        self.near = np.concatenate([unit(self.raw[k : k + 4096]).astype(np.float32) for k in range(0, len(self.raw), 4096)])

    def lists(self, table: int, role: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows by cell, and where each cell's begin."""
        c = self.cells[:, table]
        if role == "own":
            row, cell = np.arange(len(c)), c[:, 0]
        else:
            first = 0 if role == "all" else 1
            new = np.stack([~(c[:, :k] == c[:, k : k + 1]).any(axis=1) for k in range(first, c.shape[1])], axis=1)
            row, k = np.nonzero(new)
            cell = c[row, k + first]
        return row[np.argsort(cell, kind="stable")], np.r_[0, np.cumsum(np.bincount(cell, minlength=1 << 16))]


class _Found:
    """Sums of links and a forest of the pairs found so far, of rows of one or two tiles."""

    def __init__(self, a: _Tile, b: _Tile):
        self.weights = a.weight if a is b else np.concatenate([a.weight, b.weight])
        self.reps = a.rep if a is b else np.concatenate([a.rep, b.rep])
        self.shift = 0 if a is b else len(a.rep)
        self.n, self.root = np.zeros(len(self.reps), np.int64), np.arange(len(self.reps))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j + self.shift))
        self.size += len(i)
        if self.size >= PAIRS:
            self.reduce()

    def reduce(self) -> None:
        if not self.held:
            return
        i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
        np.add.at(self.n, i, self.weights[j])
        np.add.at(self.n, j, self.weights[i])
        go = self.root[i] != self.root[j]
        if go.any():
            tied = np.flatnonzero(self.root != np.arange(len(self.root)))
            self.root = least_reachable(len(self.root), np.concatenate([i[go], tied]), np.concatenate([j[go], self.root[tied]]))
        self.held, self.size = [], 0

    def rows(self) -> pa.RecordBatch:
        self.reduce()
        go = self.n > 0
        return pa.record_batch([pa.array(self.reps[go]), pa.array(self.n[go]), pa.array(self.reps[self.root[go]])], ["rep", "n", "root"])


def _links(threshold: float, p: LatticeParams, kind: type):
    def visits(ca: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (ca[:, 1:] == own[:, None]).any(axis=1)

    def compare(a: _Tile, b: _Tile) -> pa.RecordBatch:
        found, one = _Found(a, b), a is b
        slack = 1e-5 + 2e-7 * a.raw.shape[1]  # of products in single precision

        def keep(i: np.ndarray, j: np.ndarray, product: np.ndarray, table: int, turned: bool) -> None:
            """Of pairs that met in a table those which are links and met nowhere before; ``turned``: a row of ``a`` visits one of ``b``."""
            go = a.label[i] == b.label[j]
            if one:
                same = a.cells[i, table, 0] == a.cells[j, table, 0]
                go &= np.where(same, i < j, (i < j) | ~visits(a.cells[i, table], a.cells[j, table, 0]))
            elif turned:
                go &= ~visits(b.cells[j, table], a.cells[i, table, 0])
            i, j, product = i[go], j[go], product[go]
            for t in range(table):
                x, y = a.cells[i, t], b.cells[j, t]
                go = (x[:, 0] != y[:, 0]) & ~visits(x, y[:, 0]) & ~visits(y, x[:, 0])
                i, j, product = i[go], j[go], product[go]
            doubt = np.flatnonzero(product < threshold + slack)
            if len(doubt):
                go = np.ones(len(i), bool)
                for lo in range(0, len(doubt), 4096):
                    k = doubt[lo : lo + 4096]
                    go[k] = (unit(a.raw[i[k]]) * unit(b.raw[j[k]])).sum(axis=1) >= threshold
                i, j = i[go], j[go]
            if len(i):
                found.add(i, j)

        def meet(table: int, left: tuple, right: tuple, turned: bool) -> None:
            (rows, at), (cols, to) = left, right
            for c in np.flatnonzero((np.diff(at) > 0) & (np.diff(to) > 0)).tolist():
                r, q = rows[at[c] : at[c + 1]], cols[to[c] : to[c + 1]]
                x, y = a.near[r], b.near[q].T
                step, wide = max(1, BLOCK // len(q)), BLOCK
                for lo in range(0, len(r), step):
                    for at_q in range(0, len(q), wide):
                        got = x[lo : lo + step] @ y[:, at_q : at_q + wide]
                        if got.max() >= threshold - slack:
                            i, j = np.nonzero(got >= threshold - slack)
                            keep(r[lo + i], q[at_q + j], got[i, j], table, turned)

        for t in range(p.tables):
            meet(t, a.lists(t, "own"), b.lists(t, "all"), False)
            if not one:
                meet(t, a.lists(t, "visits"), b.lists(t, "own"), True)
        return found.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The left tile's side is 0, the right's 1, in this order; in the first round there is the left only."""
        last: tuple | None = None
        held: list[tuple] = []
        tiles: list[_Tile] = []

        def close() -> None:
            if held:
                tiles.append(_Tile(held, last[1], p, kind))
                held.clear()

        def solve() -> Iterator[pa.RecordBatch]:
            close()
            if tiles and len(tiles) == (2 if last[3] else 1):
                yield compare(tiles[0], tiles[-1])
            tiles.clear()

        for b in batches:
            keys = zip(*[b.column(k).to_pylist() for k in ("grp", "size", "ti", "round", "side")], strict=True)
            blobs = [b.column(k) for k in ("label", "rep", "weight", "vec", "cells")]
            for k, key in enumerate(keys):
                if last is not None and key[:4] != last[:4]:
                    yield from solve()
                elif key != last:
                    close()
                last = key
                held.append(tuple(c[k].as_buffer() for c in blobs))
            del b, blobs
        if last is not None:
            yield from solve()

    return run


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session inside the block."""
    names = {"drop_shuffles": "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch"}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _named(vectors: DataFrame) -> DataFrame:
    """``(name, size, label, grp, tiles)`` for each label and length of vectors ``(name, size)``: labels with few vectors share a bin."""
    names = vectors.groupBy("name", "size").agg(F.count("*").alias("rows")).select("*", F.monotonically_increasing_id().alias("label"))
    names = materialize(names, "lattice-names")
    bins = names.where(F.col("rows") < SMALL).groupBy("size").agg(F.ceil(F.sum("rows") / BIN).alias("bins"))
    names = names.join(F.broadcast(bins), "size", "left")  # a row for each length of vectors
    names = names.withColumn("grp", F.when(F.col("rows") < SMALL, -1 - F.pmod(F.xxhash64("label"), "bins")).otherwise(F.col("label")))
    most = F.greatest(F.lit(1), F.floor(F.lit(64.0 * TILE) / F.greatest("size", F.lit(64))))
    groups = names.groupBy("grp", "size").agg(F.ceil(F.sum("rows") / F.first(most)).cast("bigint").alias("tiles"))
    return materialize(names.join(groups, ["grp", "size"]).select("name", "size", "label", "grp", "tiles"), "lattice-labels")  # a row for each label, of known size


def _round(packed: DataFrame, step: int) -> DataFrame:
    """Blobs of the pairs of tiles that are ``step`` apart, around the end, each pair once: ``ti`` is the left tile."""
    near, half = packed.where(F.col("tiles") >= max(1, 2 * step)), F.col("tiles") == 2 * step
    left = near.where(~half | (F.col("tile") < step)).withColumns({"ti": F.col("tile"), "side": F.lit(0)})
    if not step:
        return left.withColumn("round", F.lit(step))
    right = near.where(~half | (F.col("tile") >= step)).withColumns({"ti": F.pmod(F.col("tile") - step, "tiles"), "side": F.lit(1)})
    return left.unionByName(right).withColumn("round", F.lit(step))


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: not null, no null, NaN or infinite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, p: LatticeParams | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors of equal labels (of any type) link at a cosine of ``threshold`` or more; vectors of other lengths, without a direction or with a
    null label link with nothing. ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the least id that
    links reach, the own id included; ``kept`` is whether that is the own id. A null id is never a component's id unless all are null. ``p``
    are the settings of all labels.
    """
    spark, p = vectors.sparkSession, p or LatticeParams()
    kind = np.float64 if "double" in vectors.schema[vec_col].dataType.simpleString() else np.float32
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("name"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("name").isNotNull() & F.col("vec_id").isNotNull())
    digest = {"size": F.size("vec").cast("bigint"), "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}  # 128 bits stand for a vector in joins
    with _settings(spark, drop_shuffles="true"), tables_made() as made:  # a job's shuffle files go at its end, not with the driver's garbage
        distinct = rows.where("ok").groupBy("name", "vec").agg(F.min("vec_id").cast("bigint").alias("rep"), F.count("*").alias("weight"))
        reps = materialize(distinct.withColumns(digest), "lattice-vectors")
        names = _named(reps)
        known = materialize(reps.drop("vec"), "lattice-known")
        flat = reps.join(names, ["name", "size"]).withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles")).select("grp", "size", "tile", "tiles", "label", "rep", "weight", "vec")
        packed = materialize(flat.mapInArrow(_pack(p, kind), PACKED), "lattice-tiles")
        drop_tables(spark, [x for x in made if "/lattice-vectors-" in x])
        groups = names.groupBy("grp", "size").agg(F.first("tiles").alias("tiles"))
        most = groups.agg(F.max("tiles")).first()[0] or 1
        found, key = [], ["grp", "size", "ti"]
        for step in range(most // 2 + 1):
            n = groups.where(F.col("tiles") >= max(1, 2 * step)).agg(F.sum("tiles")).first()[0] or 1
            dealt = _round(packed, step).drop("tile", "tiles").repartition(max(n_shuffle(spark), min(n, 4096)), *key).sortWithinPartitions(*key, "side")
            with _settings(spark, batch_rows="8"):  # rows are blobs
                found.append(materialize(dealt.mapInArrow(_links(threshold, p, kind), "rep bigint, n bigint, root bigint"), f"lattice-links{step}"))
        drop_tables(spark, [x for x in made if "/lattice-tiles-" in x])
        found = reduce(DataFrame.unionByName, found)
        roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "lattice")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = known.join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least, "root").select("name", *digest, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    linked = rows.where("ok").withColumns(digest).select("vec_id", "name", *digest).join(named, ["name", *digest]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
