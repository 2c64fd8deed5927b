"""BK-trees over 64-bit fingerprints as flat numpy arrays.

A forest holds one tree for each shard. A node keeps its children keyed by their integer
Hamming distance to it; a search goes down only the edges whose distance lies within the
radius of the query's own distance to the node (the triangle inequality). Building and
searching go level by level for all trees at once, so the work is vectorised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    value: np.ndarray  #: fingerprint of each node
    first: np.ndarray  #: place of each node's first child in ``child``
    count: np.ndarray  #: how many children it has
    child: np.ndarray  #: nodes, by parent and then by edge
    edge: np.ndarray  #: distance of each of ``child`` to its parent
    root: np.ndarray  #: root of each shard


def build(shard: np.ndarray, value: np.ndarray) -> Forest:
    """Trees over ``value`` (distinct within a shard); ``shard`` is sorted and numbered from 0. Nodes keep the order given."""
    n = len(value)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    rows, group = np.arange(n), shard.astype(np.int64)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    root = rows[head]
    while len(rows):
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        top = np.repeat(rows[head], np.diff(np.r_[head, len(rows)]))
        rest = np.ones(len(rows), bool)
        rest[head] = False
        rows, top = rows[rest], top[rest]
        far = np.bitwise_count(value[rows] ^ value[top]).astype(np.int64)
        parent[rows], edge[rows] = top, far  # the one that heads the next group keeps this; the others go on down
        key = top * 65 + far
        order = np.argsort(key, kind="stable")
        rows, group = rows[order], key[order]
    order = np.lexsort((edge, parent))
    order = order[np.searchsorted(parent[order], 0) :]
    count = np.bincount(parent[order], minlength=n) if n else np.zeros(0, np.int64)
    return Forest(value, np.r_[0, np.cumsum(count)][:-1], count, order, edge[order], root)


def search(forest: Forest, shard: np.ndarray, query: np.ndarray, radius: int, most: int = 1 << 21):
    """Yield (query row, node) arrays of all pairs at ``radius`` or less, each query in its shard's tree."""
    step = 1 << 12
    for lo in range(0, len(query), step):
        todo = [(np.arange(lo, min(lo + step, len(query))), forest.root[shard[lo : lo + step]])]
        while todo:
            q, node = todo.pop()
            if len(q) > most:
                todo += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            far = np.bitwise_count(query[q] ^ forest.value[node]).astype(np.int64)
            if (hit := far <= radius).any():
                yield q[hit], node[hit]
            n = forest.count[node]
            if not n.any():
                continue
            at = np.repeat(forest.first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, far = np.repeat(q, n), np.repeat(far, n)
            near = np.abs(forest.edge[at] - far) <= radius
            if near.any():
                todo.append((q[near], forest.child[at[near]]))


class Members:
    """Rows by their value: trees hold distinct values, links join rows."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        key = np.stack([shard.astype(np.uint64), value], axis=1)
        at, self.inverse = np.unique(key, axis=0, return_inverse=True)
        self.inverse = self.inverse.ravel()
        self.shard, self.value = at[:, 0].astype(np.int64), np.ascontiguousarray(at[:, 1])
        self.row = np.argsort(self.inverse, kind="stable")
        self.count = np.bincount(self.inverse, minlength=len(at))
        self.first = np.cumsum(self.count) - self.count

    def of(self, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of ``q`` with every row that has its node's value."""
        n = self.count[node]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.row[np.repeat(self.first[node], n) + step]


Also = Callable[[np.ndarray, np.ndarray], np.ndarray]


def components_small(shard: np.ndarray, value: np.ndarray, radius: int, also: Also) -> np.ndarray:
    """The least row that each row is linked with, over all pairs of a shard within the radius for which ``also`` holds; for many small shards."""
    m = Members(shard, value)
    forest = build(m.shard, m.value)
    out = np.arange(len(value))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def merge() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        return label(len(out), np.concatenate([np.arange(len(out)), a]), np.concatenate([out, b]))

    for q, node in search(forest, shard, value, radius):
        q, row = m.of(q, node)
        go = q < row
        q, row = q[go], row[go]
        go = also(q, row)
        held.append((q[go], row[go]))
        n += len(held[-1][0])
        if n > 1 << 20:  # what was found comes down to one link a row
            out, held, n = merge(), [], 0
    return merge() if held else out


def components_large(value: np.ndarray, radius: int, also: Also, most: int = 256) -> np.ndarray:
    """The same for one large shard, a component at a time: rows that a component has reached need not be found again, so many copies near one another cost one search, not one each."""
    out, alive = np.arange(len(value)), np.ones(len(value), bool)
    rows = m = forest = None

    def near(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal rows, m, forest
        left = int(alive.sum())
        if not left:
            return q[:0], q[:0]
        if rows is None or left < len(rows) // 2:  # a tree of those still to be reached
            rows = np.flatnonzero(alive)
            m = Members(np.zeros(len(rows), np.int64), value[rows])
            forest = build(m.shard, m.value)
        a, b = [q[:0]], [q[:0]]
        for k, node in search(forest, np.zeros(len(q), np.int64), value[q], radius):
            x, y = m.of(q[k], node)
            y = rows[y]
            go = alive[y] & (x != y)
            x, y = x[go], y[go]
            go = also(x, y)
            a.append(x[go])
            b.append(y[go])
        return np.concatenate(a), np.concatenate(b)

    at, size = 0, 1
    while at < len(value):
        seeds = at + np.flatnonzero(alive[at:])[:size]
        if not len(seeds):
            break
        at, size = int(seeds[-1]) + 1, min(most, 2 * size)
        a, b = near(seeds)
        known = {int(s): b[a == s] for s in np.unique(a)}
        for s in seeds.tolist():
            if not alive[s]:
                continue
            alive[s] = False
            todo, asked = [known.get(s, seeds[:0])], []
            while todo or asked:
                if not todo:
                    q = np.concatenate(asked)
                    asked = [q[most:]] if len(q) > most else []
                    todo.append(near(q[:most])[1])
                got = np.unique(todo.pop())
                got = got[alive[got]]
                alive[got] = False
                out[got] = s
                again = [x for x in got.tolist() if x in known] if len(known) else []
                todo += [known[x] for x in again]
                if len(got):
                    asked.append(got[~np.isin(got, again)] if again else got)
    return out


def label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows by the links (a, b)."""
    out = np.arange(n)
    while len(a):
        low = np.minimum(out[a], out[b])
        np.minimum.at(out, out[a], low)
        np.minimum.at(out, out[b], low)
        out = out[out]
        go = out[a] != out[b]
        a, b = a[go], b[go]
    while True:
        nxt = out[out]
        if (nxt == out).all():
            return out
        out = nxt
