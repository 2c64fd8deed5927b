"""Candidate pairs compared in blocks: rows that agree on a rule meet in one task, where values and not pairs are measured.

A task gets the queries and the reference rows of some keys. In a key each field's distinct
values are compared once, all left ones with all right ones; what a pair of rows gets is
looked up by the numbers of its values. So the cost of a pair is a few lookups, however
dear the measure, and a caller that wants less than all pairs (a query's best, counts of
patterns) takes it from the block, so that pairs are never rows.

The queries of a key with many pairs are cut into tiles, each a group of its own with all reference rows of the key; in a task a tile is taken
some queries at a time, so that the matrices hold ``MOST_PAIRS`` pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.functions import strings as S

from .blocking import without_implied
from .comparison import Comparison, birth_date, email_address, jaro_winkler_at

#: Pairs whose matrices a task holds at once.
MOST_PAIRS = 1 << 20
#: Pairs of a group that gives pairs, and of one that gives less.
GROUP_PAIRS, SUMMED_PAIRS = 1 << 22, 1 << 26

Block = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray], list[np.ndarray]]


def _texts(values: np.ndarray) -> list[str]:
    return values.tolist()


def _equal(left: Sequence, right: Sequence) -> np.ndarray:
    number = {v: k for k, v in enumerate(left)}
    out = np.zeros((len(left), len(right)), bool)
    for j, v in enumerate(right):
        if v in number:
            out[number[v], j] = True
    return out


def within_one_edit(left: list[str], right: list[str]) -> np.ndarray:
    """(left, right) whether one insertion, deletion, change or swap of neighbours at most makes the strings equal."""
    out = np.zeros((len(left), len(right)), bool)
    ll, lr = np.array([len(v) for v in left], np.int64), np.array([len(v) for v in right], np.int64)
    for n in set(ll.tolist()):
        rows = np.flatnonzero(ll == n)
        cols = np.flatnonzero(lr == n)
        if len(cols):
            a, b = (np.array([[ord(ch) for ch in side[k]] for k in at.tolist()], np.int64).reshape(len(at), n) for side, at in ((left, rows), (right, cols)))
            off = [a[:, k, None] != b[None, :, k] for k in range(n)]
            wrong = sum((x.astype(np.int64) for x in off), np.zeros((len(rows), len(cols)), np.int64))
            good = wrong <= 1
            for k in range(n - 1):
                good |= (wrong == 2) & off[k] & off[k + 1] & (a[:, k, None] == b[None, :, k + 1]) & (a[:, k + 1, None] == b[None, :, k])
            out[np.ix_(rows, cols)] = good
        for j in np.flatnonzero(np.abs(lr - n) == 1).tolist():
            for i in rows.tolist():
                long, short = (left[i], right[j]) if n > lr[j] else (right[j], left[i])
                k = next((k for k, (x, y) in enumerate(zip(long, short, strict=False)) if x != y), len(short))
                out[i, j] = long[k + 1 :] == short[k:]
    return out


def _day(text: str) -> float:
    import datetime
    import re

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return np.nan
    try:
        return float(datetime.date.fromisoformat(text).toordinal())
    except ValueError:
        return np.nan


def _user(text: str) -> str | None:
    return text.split("@", 1)[0] or None


def _jaro_levels(c: Comparison, left: list[str], right: list[str]) -> np.ndarray:
    cuts = [float(x.condition.rsplit(">=", 1)[1]) for x in c.levels if ">=" in x.condition]
    jw = S.jaro_winkler_cross(left, right)
    out = np.searchsorted(sorted(cuts), jw, "right").astype(np.int8)
    out[_equal(left, right)] = len(cuts) + 1
    return out


def _email_levels(c: Comparison, left: list[str], right: list[str]) -> np.ndarray:
    (cut,) = {float(x.condition.rsplit(">=", 1)[1]) for x in c.levels if ">=" in x.condition}
    ul, ur = [_user(v) for v in left], [_user(v) for v in right]
    some_l, some_r = list(dict.fromkeys(v for v in ul if v)), list(dict.fromkeys(v for v in ur if v))
    low = np.zeros((len(some_l) + 1, len(some_r) + 1), np.int8)  # the last ones: no user
    low[:-1, :-1] = S.jaro_winkler_cross(some_l, some_r) >= cut
    low[:-1, :-1][_equal(some_l, some_r)] = 3
    at_l, at_r = {v: k for k, v in enumerate(some_l)}, {v: k for k, v in enumerate(some_r)}
    out = low[np.array([at_l.get(v, -1) for v in ul])[:, None], np.array([at_r.get(v, -1) for v in ur])[None, :]]
    out = np.maximum(out, 2 * (S.jaro_winkler_cross(left, right) >= cut).astype(np.int8))
    out[_equal(left, right)] = 4
    return out


def _birth_levels(c: Comparison, left: list[str], right: list[str]) -> np.ndarray:
    cuts = [float(x.condition.rsplit("<=", 1)[1]) for x in c.levels if "<=" in x.condition]
    days = np.abs(np.array([_day(v) for v in left])[:, None] - np.array([_day(v) for v in right])[None, :])
    out = sum(((days <= cut).astype(np.int8) for cut in cuts), np.zeros(days.shape, np.int8))
    out[within_one_edit(left, right)] = len(cuts) + 1
    out[_equal(left, right)] = len(cuts) + 2
    out[np.isnan(days)] = -1
    return out


_KINDS = {("jaro_winkler",): _jaro_levels, ("jaro_winkler", "jaro_winkler"): _email_levels, ("within_one_edit",): _birth_levels}


def levels_of(c: Comparison) -> tuple[str, Callable]:
    """A default comparison's field, and its levels of all pairs of two lists of values (not null)."""
    (field,) = c.fields
    return field, lambda left, right: _KINDS[tuple(m.kind for m in c.measures)](c, left, right)


def in_blocks_too(c: Comparison) -> bool:
    """Whether ``levels_of`` gives the comparison's levels: it has the conditions of a default one, with any thresholds."""
    if len(c.fields) != 1 or tuple(m.kind for m in c.measures) not in _KINDS:
        return False
    cuts = [float(x.condition.rsplit(">=", 1)[1]) for x in c.levels if x.label.startswith("jaro_winkler >=")]
    plain = lambda x: ([(y.condition, y.is_null) for y in x.levels], x.measures)
    return cuts == sorted(cuts, reverse=True) and any(plain(c) == plain(d) for d in (jaro_winkler_at(c.fields[0], cuts), birth_date(c.fields[0]), email_address(c.fields[0])))


def _table(measure: Callable, left: np.ndarray, right: np.ndarray, null: float, kind: type) -> np.ndarray:
    """The measure of all pairs of values; the last row and column are those of null."""
    out = np.full((len(left) + 1, len(right) + 1), null, kind)
    step = max(1, MOST_PAIRS // max(1, len(right)))
    for lo in range(0, len(left) if len(right) else 0, step):
        out[lo : lo + step, :-1][: len(left) - lo] = measure(_texts(left[lo : lo + step]), _texts(right))
    return out


def in_blocks(left: DataFrame, right: DataFrame, rules: Sequence[Sequence[str]], measures: dict[str, tuple[str, Callable, float, type]], finish: Block, schema: str, names: list[str], ids: tuple[str, str], most: int) -> DataFrame:
    """What ``finish`` gives of each block of the pairs that agree on a rule, each pair once, at the first.

    ``measures``: a name's field, function of two lists of values, value where one is null, and type. ``finish`` gets the ids of the block's
    rows and columns, the matrix of each measure and which pairs count.
    """
    rules, out = without_implied(rules), []
    fields = sorted({f for f, *_ in measures.values()} | {f for r in rules for f in r})
    n = 4 * left.sparkSession.sparkContext.defaultParallelism
    kinds = pa.schema([pa.field(f, t) for f, t in zip(names, _types(left.sparkSession, schema), strict=True)])
    def solver(earlier: list[tuple[str, ...]]) -> Callable:
        def run(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return kinds.empty_table()
            coded = {f: tuple(pd.factorize(t[f].to_pandas()) for t in (x, y)) for f in fields}
            tables = {name: _table(g, coded[f][0][1], coded[f][1][1], null, kind) for name, (f, g, null, kind) in measures.items()}
            same = {f: _table(_equal, coded[f][0][1], coded[f][1][1], False, bool) for r in earlier for f in r}
            lid, rid, parts = x["_id"].to_numpy(), y["_id"].to_numpy(), []
            step = max(1, MOST_PAIRS // len(rid))
            for lo in range(0, len(lid), step):
                rows = slice(lo, lo + step)
                look = lambda t, f: t[coded[f][0][0][rows]][:, coded[f][1][0]]  # noqa: B023, E731
                on = np.ones((len(lid[rows]), len(rid)), bool)
                for r in earlier:
                    on &= ~reduce(np.logical_and, [look(same[f], f) for f in r])
                parts.append(finish(lid[rows], rid, {name: look(t, measures[name][0]) for name, t in tables.items()}, on))
            return pa.table([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts, strict=True), kinds, strict=True)], schema=kinds)

        return run

    for k, rule in enumerate(rules):
        sizes = left.groupBy(*rule).agg(F.count("*").alias("_nl")).join(right.groupBy(*rule).agg(F.count("*").alias("_nr")), list(rule))
        sizes = sizes.select(*rule, F.greatest(F.ceil(F.col("_nl") * F.col("_nr") / F.lit(float(most))), F.ceil(F.lit(0.0) + F.col("_nl") / F.lit(1 << 20))).cast("int").alias("_tiles"))
        a = left.select(F.col(ids[0]).alias("_id"), *[F.col(f).alias(f) for f in fields]).join(sizes, list(rule)).withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int")).drop("_tiles")
        b = right.select(F.col(ids[1]).alias("_id"), *[F.col(f).alias(f) for f in fields]).join(sizes, list(rule)).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")

        a, b = a.repartition(n, *rule, "_tile"), b.repartition(n, *rule, "_tile")
        out.append(a.groupBy(*rule, "_tile").cogroup(b.groupBy(*rule, "_tile")).applyInArrow(solver(rules[:k]), schema))
    return reduce(DataFrame.unionByName, out)


def _types(spark, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]


def _pairs(names: list[str]) -> Block:
    def finish(lid, rid, got, on):
        i, j = np.nonzero(on)
        return [lid[i], rid[j], *[got[n][i, j] for n in names]]

    return finish


def measured_pairs(queries: DataFrame, reference: DataFrame, rules: Sequence[Sequence[str]], measures: dict[str, tuple[str, Callable, float, type]], kind: str) -> DataFrame:
    """``(query_id, position, measures)`` of all candidate pairs; a measure that is not a number is null."""
    names = list(measures)
    schema = ", ".join(["query_id bigint", "position bigint", *[f"{n} {kind}" for n in names]])
    return in_blocks(queries, reference, rules, measures, _pairs(names), schema, ["query_id", "position", *names], ("query_id", "position"), GROUP_PAIRS)


def gammas(comparisons: Sequence[Comparison]) -> dict[str, tuple[str, Callable, float, type]]:
    return {f"gamma_{c.name}": (*levels_of(c), -1, np.int8) for c in comparisons}


def compared_pairs(queries: DataFrame, reference: DataFrame, rules: Sequence[Sequence[str]], comparisons: Sequence[Comparison]) -> DataFrame:
    """``(query_id, position, gamma_<name>)`` of all candidate pairs."""
    return measured_pairs(queries, reference, rules, gammas(comparisons), "int")


def _weights(model) -> tuple[float, list[tuple[str, np.ndarray]]]:
    """The prior's weight, and each comparison's weights by level, that of -1 last."""
    out = []
    for c in model.comparisons:
        w = model.weights(c)
        out.append((f"gamma_{c.name}", np.array([w.get(v, 0.0) for v in [*range(max(w) + 1), -1]])))
    return model.prior_weight, out


def _total(prior: float, weights: list[tuple[str, np.ndarray]], got: dict[str, np.ndarray]) -> np.ndarray:
    total = prior
    for name, w in weights:
        total = total + w[got[name]]
    return total


def scored_pairs(queries: DataFrame, reference: DataFrame, rules: Sequence[Sequence[str]], model, least: float | None = None) -> DataFrame:
    """``(query_id, position, match_weight)`` of all candidate pairs, or of those whose weight is ``least`` or more."""
    prior, weights = _weights(model)

    def finish(lid, rid, got, on):
        w = _total(prior, weights, got)
        i, j = np.nonzero(on if least is None else on & (w >= least))
        return [lid[i], rid[j], w[i, j]]

    return in_blocks(queries, reference, rules, gammas(model.comparisons), finish, "query_id bigint, position bigint, match_weight double", ["query_id", "position", "match_weight"], ("query_id", "position"), GROUP_PAIRS)


def best_weights(queries: DataFrame, reference: DataFrame, rules: Sequence[Sequence[str]], models: Sequence) -> DataFrame:
    """``(query_id, w0, w1, ...)``: the greatest weight of a query's candidates by each model; the models have the same comparisons."""
    each = [_weights(m) for m in models]
    names = [f"w{k}" for k in range(len(models))]

    def finish(lid, rid, got, on):
        best = [np.where(on, _total(*m, got), -np.inf).max(axis=1) for m in each]
        some = on.any(axis=1)
        return [lid[some], *[b[some] for b in best]]

    schema = ", ".join(["query_id bigint", *[f"{n} double" for n in names]])
    found = in_blocks(queries, reference, rules, gammas(models[0].comparisons), finish, schema, ["query_id", *names], ("query_id", "position"), SUMMED_PAIRS)
    return found.groupBy("query_id").agg(*[F.max(n).alias(n) for n in names])


def pattern_counts(reference: DataFrame, rule: Sequence[str], comparisons: Sequence[Comparison], most: int = SUMMED_PAIRS) -> DataFrame:
    """``(gamma_<name>..., n)``: how often each combination of levels occurs among the pairs of different rows that agree on ``rule``, the smaller position left.

    A task counts the combinations of a tile's rows with all later ones of the key, from tables of its distinct values, so pairs are never rows. Rows
    are dealt by their value of the field with most of them, so that tiles share few values; rows of one that a key has often are dealt by position.
    """
    fields = sorted({f for c in comparisons for f in c.fields} | {*rule})
    names, each = [f"gamma_{c.name}" for c in comparisons], [levels_of(c) for c in comparisons]
    radix = [len(c.levels) + 1 for c in comparisons]
    scale = np.cumprod([1, *radix])[:-1].tolist()
    word = np.int16 if np.prod(radix) < 1 << 15 else np.int64
    rows = reference.select(F.col("position").alias("_id"), *fields).dropna(subset=list(rule))
    counts = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in fields]).first()
    by = max(fields, key=lambda f: counts[f])
    sizes = rows.groupBy(*rule).agg(F.count("*").alias("_n")).select(*rule, F.ceil(F.col("_n") * F.col("_n") / F.lit(float(most))).cast("int").alias("_tiles"))
    often = rows.where(F.col(by).isNotNull()).groupBy(*{*rule, by}).agg(F.count("*").alias("_often")).where("_often > 64")
    left = rows.join(sizes, list(rule)).join(often, list({*rule, by}), "left")
    spread = F.when(F.col(by).isNull() | F.col("_often").isNotNull(), F.xxhash64("_id")).otherwise(F.xxhash64(by))
    left = left.withColumn("_tile", F.pmod(spread, F.col("_tiles")).cast("int")).drop("_tiles", "_often")
    right = rows.join(sizes, list(rule)).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y = x.sort_by("_id"), y.sort_by("_id")
        coded = {f: tuple(pd.factorize(t[f].to_pandas()) for t in (x, y)) for f in fields}
        tables = []
        for (f, g), by_level in zip(each, scale, strict=True):
            t = _table(g, coded[f][0][1], coded[f][1][1], -1, np.int8)
            tables.append((f, ((t.astype(word) + 1) * by_level).astype(word)))
        lid, rid = x["_id"].to_numpy(), y["_id"].to_numpy()
        total, lo = np.zeros(int(np.prod(radix)), np.int64), 0
        while lo < len(lid):
            first = int(np.searchsorted(rid, lid[lo], "right"))
            rows = slice(lo, lo + max(1, (MOST_PAIRS >> 2) // max(1, len(rid) - first)))
            lo = rows.stop
            if first == len(rid):
                continue
            code = np.zeros((len(lid[rows]), len(rid) - first), word)
            for f, t in tables:
                code += t[coded[f][0][0][rows]][:, coded[f][1][0][first:]]
            later = lid[rows][:, None] < rid[None, first:]
            total += np.bincount(code.ravel() if later.all() else code[later], minlength=len(total))
        go = np.flatnonzero(total)
        return pa.table({"code": pa.array(go, pa.int64()), "n": pa.array(total[go], pa.int64())})

    n = 16 * reference.sparkSession.sparkContext.defaultParallelism
    left, right = (d.toDF(*d.columns).repartition(n, *rule, "_tile") for d in (left, right))  # columns of their own
    found = left.groupBy(*rule, "_tile").cogroup(right.groupBy(*rule, "_tile")).applyInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    levels = [(F.floor(F.col("code") / F.lit(a)) % F.lit(b) - 1).cast("int").alias(name) for a, b, name in zip(scale, radix, names, strict=True)]
    return found.select(*levels, "n")
