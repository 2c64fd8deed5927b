"""Pairs of distinct values counted by what their measures say, most of them by templates and not one by one.

Values whose texts differ in digits only form a group. Where bounds of the similarity of two groups' templates lie between the
same thresholds, all their pairs have one outcome and count at once; the pairs of the other groups are measured. So counts are exact, and only the time hangs on
how many values a template has: where templates are hardly fewer than values all pairs are measured.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from kinsieve.functions import strings as S

#: Pairs whose matrices a task holds at once.
MOST_PAIRS = 1 << 20
#: Pairs of values that are gathered at once.
STEP_PAIRS = 1 << 16

Texts = Sequence[str | None]


class _Side:
    """Values in the order of their groups. ``columns``: the value, then each measure's text of it, or None."""

    def __init__(self, columns: list[Texts], n: np.ndarray):
        templates = [[v if v is None else v.translate(S.TEMPLATE) for v in c] for c in columns]
        number: dict[tuple, int] = {}
        code = np.array([number.setdefault(t, len(number)) for t in zip(*templates, strict=True)], np.int64)
        self.order = np.argsort(code, kind="stable")
        self.group = code[self.order]
        self.columns = [[c[k] for k in self.order.tolist()] for c in columns]
        self.n = n[self.order]
        self.sizes = np.bincount(code, minlength=len(number))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n_group = np.zeros(len(number), np.int64)
        np.add.at(self.n_group, self.group, self.n)
        self.templates = [list(c) for c in zip(*number, strict=True)]
        self.null = [np.array([v is None for v in c], bool) for c in self.columns]

    @property
    def varied(self) -> bool:
        return 2 * len(self.sizes) > len(self.group)


class _Counts:
    """How many rows' pairs have each outcome, and one pair of values for it."""

    def __init__(self):
        self.total: dict[int, int] = {}
        self.pair: dict[int, tuple[int, int]] = {}

    def add(self, kind: np.ndarray, n: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """``kind`` and ``n`` of rows by columns, or of pairs of them."""
        flat = kind.ndim == 1
        kind, n = kind.ravel(), n.ravel()
        if float(n.max(initial=0)) * len(n) < 2**53:
            total = np.bincount(kind, n).astype(np.int64)  # sums of whole numbers below 2^53
        else:
            total = np.zeros(kind.max() + 1, np.int64)
            np.add.at(total, kind, n)
        for k in np.flatnonzero(total).tolist():
            if k not in self.total:
                at = int(np.argmax((kind == k) & (n > 0)))
                i, j = (at, at) if flat else divmod(at, len(cols))
                self.pair[k] = int(rows[i]), int(cols[j])
            self.total[k] = self.total.get(k, 0) + int(total[k])


def _levels(jw: np.ndarray, cut: list[float]) -> np.ndarray:
    return sum(((jw >= t).view(np.uint8) for t in cut), np.zeros(jw.shape, np.uint8))


def _numbers(left: list[Texts], right: list[Texts]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal texts of a column have equal numbers."""
    out: tuple[list, list] = ([], [])
    for x, y in zip(left, right, strict=True):
        known: dict = {}
        for side, texts in zip(out, (x, y), strict=True):
            side.append(np.array([known.setdefault(v, len(known)) for v in texts], np.int64))
    return out


def count_pairs(left: list[Texts], n_left: np.ndarray, right: list[Texts], n_right: np.ndarray, cuts: list[list[float]], same: bool) -> list[tuple[int, int, int]]:
    """``(left row, right row, pairs)`` for each outcome of distinct values, of each left with each right one: whether values are equal and, for each measure, the
    thresholds that its texts reach, whether they are equal and whether one is null. ``left[0]`` has the values, ``left[k]`` the texts of measure k, whose
    thresholds are ``cuts[k - 1]``; n: rows of each value. ``same``: both sides are one, and each pair counts once; a value of n rows has n (n - 1) / 2 with itself.
    """
    counts = _Counts()
    if not len(n_left) or not len(n_right):
        return []
    a = _Side(left, n_left)
    b = a if same else _Side(right, n_right)
    num_a, num_b = _numbers(a.columns, b.columns)
    places: dict[int, S.Places] = {}
    equal_at, null_at = [1, *[len(c) + 1 for c in cuts]], [2, *[len(c) + 2 for c in cuts]]

    def weights(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = np.outer(n[rows], m[cols])
        if same:
            out *= rows[:, None] < cols[None, :]
            i, j = np.nonzero(rows[:, None] == cols[None, :])
            out[i, j] = n[rows[i]] * (n[rows[i]] - 1) // 2
        return out

    def joined(levels: list[np.ndarray]) -> np.ndarray:
        kind = levels[0].astype(np.int64)
        for k, level in enumerate(levels[1:], 1):
            kind = kind * (null_at[k] + 1) + level
        return kind

    def measured(k: int, rows: np.ndarray, cols: np.ndarray | None) -> np.ndarray:
        """Levels of a measure, or for k = 0 whether values are equal, of each row with each column (None: all)."""
        at = slice(None) if cols is None else cols
        equal = num_a[k][rows][:, None] == num_b[k][at][None, :]
        if k == 0:
            return equal.view(np.uint8)
        if k not in places:
            places[k] = S.Places([v or "" for v in b.columns[k]])
        to = places[k] if cols is None else places[k].take(cols)
        level = _levels(S.jaro_winkler_cross([a.columns[k][i] or "" for i in rows.tolist()], to), cuts[k - 1])
        level[equal] = equal_at[k]
        level[a.null[k][rows], :] = null_at[k]
        level[:, b.null[k][at]] = null_at[k]
        return level

    def by_digits(some: np.ndarray, which: np.ndarray, levels: list[np.ndarray], open_: list[np.ndarray], spans: list) -> None:
        """Pairs of groups whose open measures hang on their digits only, a number of pairs of values at a time."""
        if same:
            which = which & (some[:, None] <= np.arange(len(b.sizes))[None, :])
        gi, gj = np.nonzero(which)
        many = a.sizes[some[gi]] * b.sizes[gj]
        cuts_at = np.flatnonzero(np.diff(np.cumsum(many) // STEP_PAIRS)) + 1
        for gi, gj, many in zip(*(np.split(v, cuts_at) for v in (gi, gj, many)), strict=True):
            if not len(gi):
                continue
            tables = {k: S.DigitPairs(spans[k], [a.templates[k][i] or "" for i in some.tolist()], [v or "" for v in b.templates[k]], gi, gj) for k in parts if k and open_[k][gi, gj].any()}
            for first in range(0, int(many.sum()), 4 * STEP_PAIRS):
                at = np.arange(first, min(first + 4 * STEP_PAIRS, int(many.sum())))
                ends = np.cumsum(many)
                u = np.searchsorted(ends, at, "right")
                r, c = np.divmod((at - (ends - many)[u]).astype(np.int32), b.sizes[gj].astype(np.int32)[u])
                rows, cols = a.starts[some[gi]][u] + r, b.starts[gj][u] + c
                kinds = []
                for k in parts:
                    level = levels[k][gi, gj][u]
                    now = open_[k][gi, gj][u]
                    if now.any():
                        now = np.flatnonzero(now)
                        if k:
                            if k not in places_of:
                                own = S.digits_of(b.columns[k])
                                bits = np.zeros((len(b.group), 11), np.uint8)
                                for p, digit in enumerate(own):
                                    bits[np.arange(len(digit)), digit] |= np.uint8(1 << p)
                                bits[:, 10] = 0
                                mine = S.digits_of(a.columns[k])
                                places_of[k] = mine[: int((mine < 10).any(axis=1).sum())], bits.ravel()
                            mine, bits = places_of[k]
                            base, un = cols[now] * 11, u[now]
                            x, y = tables[k].matches(un, mine[:, rows[now]], lambda digit, bits=bits, base=base: bits[base + digit])
                            table = _levels(tables[k].similarity, cuts[k - 1]).reshape(len(gi), -1)
                            level[now] = table[un, x * np.int64(S.MOST_DIGITS + 1) + y]
                        else:
                            level[now] = 0
                        level[now[num_a[k][rows[now]] == num_b[k][cols[now]]]] = equal_at[k]
                    kinds.append(level)
                n = a.n[rows] * b.n[cols]
                if same:
                    n = np.where(rows < cols, n, np.where(rows == cols, a.n[rows] * (a.n[rows] - 1) // 2, 0))
                counts.add(joined(kinds), n, rows, cols)

    parts = range(len(cuts) + 1)
    places_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    everything = np.arange(len(b.group))
    if a.varied or b.varied:
        step = max(1, MOST_PAIRS // len(everything))
        for lo in range(0, len(a.group), step):
            rows = np.arange(lo, min(lo + step, len(a.group)))
            counts.add(joined([measured(k, rows, None) for k in parts]), weights(rows, everything, a.n, b.n), rows, everything)
    else:
        step = max(1, MOST_PAIRS // len(b.sizes))
        for lo in range(0, len(a.sizes), step):
            some = np.arange(lo, min(lo + step, len(a.sizes)))
            levels, open_, spans, easy = [], [], [], np.ones((len(some), len(b.sizes)), bool)
            for k in parts:
                x, y = [a.templates[k][i] for i in some.tolist()], b.templates[k]
                (nx, ny), both = _numbers([x], [y]), None
                both = nx[0][:, None] == ny[0][None, :]
                digits = np.array([v is not None and "0" in v for v in x], bool)[:, None]
                if k:
                    spans.append(S.jaro_winkler_bounds([v or "" for v in x], [v or "" for v in y]))
                    low, high = _levels(spans[-1].least, cuts[k - 1]), _levels(spans[-1].most, cuts[k - 1])
                else:
                    spans.append(None)
                    low = high = np.zeros(both.shape, np.uint8)
                null = np.array([v is None for v in x], bool)[:, None] | np.array([v is None for v in y], bool)[None, :]
                levels.append(np.where(null, null_at[k], np.where(both, equal_at[k], low)).astype(np.uint8))
                open_.append(~null & np.where(both, digits, low != high))
                if k:
                    easy &= ~open_[-1] | spans[-1].by_digits
            unsure = np.logical_or.reduce(open_)
            n = weights(some, np.arange(len(b.sizes)), a.n_group, b.n_group)
            n[unsure] = 0
            counts.add(joined(levels), n, a.starts[some], b.starts)
            by_digits(some, unsure & easy, levels, open_, spans)
            unsure &= ~easy
            for g, i in enumerate(some.tolist()):
                to = np.flatnonzero(unsure[g])
                if same:
                    to = to[to >= i]
                if not len(to):
                    continue
                cols = np.flatnonzero(np.isin(b.group, to)) if len(to) < len(b.sizes) else everything
                wide = max(1, MOST_PAIRS // len(cols))
                for first in range(0, a.sizes[i], wide):
                    rows = a.starts[i] + np.arange(first, min(first + wide, a.sizes[i]))
                    each = []
                    for k in parts:
                        level = np.repeat(levels[k][g][b.group[cols]][None, :], len(rows), axis=0)
                        now = np.flatnonzero(open_[k][g][b.group[cols]])
                        if len(now):
                            level[:, now] = measured(k, rows, cols[now])
                        each.append(level)
                    counts.add(joined(each), weights(rows, cols, a.n, b.n), rows, cols)
    return [(int(a.order[i]), int(b.order[j]), counts.total[k]) for k, (i, j) in counts.pair.items()]
