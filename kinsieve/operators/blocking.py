"""Candidate pairs by equality rules. Each rule is one equi-join; a pair that several rules find counts for the first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the one-record resolver that scores only candidates which share them (fixed values).
RESOLVER_RULES = (("first_name", "last_name"), ("date_of_birth",), ("first_name", "date_of_birth"), ("last_name", "date_of_birth"))
#: Rules of training sessions (fixed values).
TRAINING_RULES = (("first_name",), ("date_of_birth",))


def _agree(columns: Sequence[str], left: str = "_l", right: str = "_r") -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{c}{left}") == F.col(f"{c}{right}"), F.lit(False)) for c in columns])


def without_implied(rules: Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """Rules that no other rule implies: equality of more columns finds nothing beyond equality of some of them."""
    sets = [frozenset(r) for r in rules]
    return [tuple(r) for k, r in enumerate(rules) if not any(s < sets[k] or (s == sets[k] and j < k) for j, s in enumerate(sets))]


def _suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def rule_pairs(df: DataFrame, rules: Sequence[Sequence[str]], id_col: str = "position") -> DataFrame:
    """Pairs of different rows of one table, the smaller id on the left, with all columns as ``_l`` and ``_r`` and the number of the first rule that agrees."""
    rules = without_implied(rules)
    left, right, out = _suffixed(df, "_l"), _suffixed(df, "_r"), []
    for k, rule in enumerate(rules):
        on = [F.col(f"{c}_l") == F.col(f"{c}_r") for c in rule]
        found = left.join(right, on).where(F.col(f"{id_col}_l") < F.col(f"{id_col}_r"))
        for earlier in rules[:k]:
            found = found.where(~_agree(earlier))
        out.append(found.withColumn("match_rule", F.lit(k)))
    return reduce(DataFrame.unionByName, out)


def query_candidates(queries: DataFrame, reference: DataFrame, rules: Sequence[Sequence[str]]) -> DataFrame:
    """Pairs of a query (``_l``) and a reference row (``_r``) that agree on a rule, with ``query_id`` and ``position``."""
    rules = without_implied(rules)
    left, right, out = _suffixed(queries, "_l"), _suffixed(reference, "_r"), []
    for k, rule in enumerate(rules):
        found = left.join(right, [F.col(f"{c}_l") == F.col(f"{c}_r") for c in rule])
        for earlier in rules[:k]:
            found = found.where(~_agree(earlier))
        out.append(found.withColumn("match_rule", F.lit(k)))
    return reduce(DataFrame.unionByName, out).withColumnsRenamed({"query_id_l": "query_id", "position_r": "position"})


def attach(candidates: DataFrame, queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidates ``(query_id, position, ...)`` with the fields of both sides."""
    q = queries.select("query_id", *[F.col(c).alias(f"{c}_l") for c in queries.columns if c not in ("query_id", "vector")])
    r = reference.select("position", *[F.col(c).alias(f"{c}_r") for c in reference.columns if c not in ("position", "vector")])
    return candidates.join(q, "query_id").join(r, "position")


def agreeing(pairs: DataFrame, rules: Sequence[Sequence[str]]) -> DataFrame:
    """Pairs for which at least one rule holds."""
    return pairs.where(reduce(lambda a, b: a | b, [_agree(r) for r in rules]))
