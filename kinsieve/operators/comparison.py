"""Comparisons: ordered levels of agreement for one field, as SQL conditions over a pair.

A pair has ``<field>_l`` and ``<field>_r`` columns. A comparison first computes its measures
(a similarity that several levels read is computed once) and then one integer: -1 for the
null level, 0 for the last one (ELSE), and higher for closer agreement. A condition that is
null is not satisfied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsieve.functions import strings as S

#: Thresholds of the default comparisons, and the days of a month, a year and ten years of 365.25 days.
NAME_LEVELS, ADDRESS_LEVELS, EMAIL_LEVEL = (0.9, 0.8, 0.7), (0.85, 0.75, 0.65), 0.88
MONTH_DAYS, YEAR_DAYS, DECADE_DAYS = 30.4375, 365.25, 3652.5
#: Fixed values of untrained levels: m of the closest level, match weights of ELSE and of the others.
TOP_M, ELSE_WEIGHT, LOW_WEIGHT, HIGH_WEIGHT = 0.95, -5.0, 3.0, 10.0


@dataclass(frozen=True)
class Level:
    label: str
    condition: str
    is_null: bool = False
    m: float | None = None
    u: float | None = None

    @property
    def is_else(self) -> bool:
        return self.condition.strip().upper() == "ELSE"


@dataclass(frozen=True)
class Measure:
    """A value of a pair: ``jaro_winkler`` or ``within_one_edit`` of two expressions. Equal strings are not measured, as a level above takes them."""

    name: str
    kind: str
    left: str
    right: str

    def column(self) -> Column:
        left, right = F.expr(self.left), F.expr(self.right)
        if self.kind == "jaro_winkler":
            return S.jaro_winkler_once(F.when(left != right, left), F.when(left != right, right))
        if self.kind == "within_one_edit":
            return S.damerau_within_one(left, right)
        raise ValueError(f"unknown measure: {self.kind}")


@dataclass(frozen=True)
class Comparison:
    name: str
    fields: tuple[str, ...]
    levels: tuple[Level, ...]
    measures: tuple[Measure, ...] = ()

    @property
    def values(self) -> list[int]:
        """The integer of each level."""
        top, out = sum(not x.is_null for x in self.levels) - 1, []
        for x in self.levels:
            out.append(-1 if x.is_null else top)
            top -= not x.is_null
        return out

    def gamma(self) -> Column:
        """The first satisfied level, by the measures' columns."""
        case, last = None, 0
        for level, value in zip(self.levels, self.values, strict=True):
            if level.is_else:
                last = value
                continue
            when = F.expr(f"coalesce({level.condition}, false)")
            case = F.when(when, value) if case is None else case.when(when, value)
        return (F.lit(last) if case is None else case.otherwise(last)).cast("int")


def default_m_u(n: int) -> list[tuple[float, float]]:
    """(m, u) of n levels, the closest first: the closest has TOP_M and the others share the rest; u follows from weights that run evenly, and is scaled to 1."""
    if n == 1:
        return [(1.0, 1.0)]
    m = [TOP_M] + [(1 - TOP_M) / (n - 1)] * (n - 1)
    weight = [*np.linspace(HIGH_WEIGHT, LOW_WEIGHT, n - 1).tolist(), ELSE_WEIGHT]
    u = [a / 2**w for a, w in zip(m, weight, strict=True)]
    return [(a, b / sum(u)) for a, b in zip(m, u, strict=True)]


def with_defaults(c: Comparison) -> Comparison:
    """Levels without m and u get the untrained ones; null levels have none."""
    table = iter(default_m_u(sum(not x.is_null for x in c.levels)))
    levels = []
    for x in c.levels:
        if x.is_null:
            levels.append(x)
            continue
        m, u = next(table)
        levels.append(replace(x, m=m if x.m is None else x.m, u=u if x.u is None else x.u))
    return replace(c, levels=tuple(levels))


def jaro_winkler_at(field: str, thresholds: Sequence[float]) -> Comparison:
    left, right = f"{field}_l", f"{field}_r"
    levels = [Level("null", f"{left} is null or {right} is null", True), Level("exact", f"{left} = {right}")]
    levels += [Level(f"jaro_winkler >= {t}", f"jw_{field} >= {t}") for t in thresholds]
    return with_defaults(Comparison(field, (field,), (*levels, Level("else", "ELSE")), (Measure(f"jw_{field}", "jaro_winkler", left, right),)))


def birth_date(field: str) -> Comparison:
    left, right = f"{field}_l", f"{field}_r"
    day = lambda c: f"try_to_date({c}, 'yyyy-MM-dd')"
    apart = f"abs(datediff({day(left)}, {day(right)}))"
    levels = (
        Level("null or no date", f"{day(left)} is null or {day(right)} is null", True),
        Level("exact", f"{left} = {right}"),
        Level("one edit", f"one_edit_{field}"),
        Level("within a month", f"{apart} <= {MONTH_DAYS}"),
        Level("within a year", f"{apart} <= {YEAR_DAYS}"),
        Level("within ten years", f"{apart} <= {DECADE_DAYS}"),
        Level("else", "ELSE"),
    )
    return with_defaults(Comparison(field, (field,), levels, (Measure(f"one_edit_{field}", "within_one_edit", left, right),)))


def email_address(field: str) -> Comparison:
    left, right = f"{field}_l", f"{field}_r"
    user = lambda c: f"nullif(regexp_extract({c}, '^[^@]+', 0), '')"
    levels = (
        Level("null", f"{left} is null or {right} is null", True),
        Level("exact", f"{left} = {right}"),
        Level("same user", f"{user(left)} = {user(right)}"),
        Level("jaro_winkler", f"jw_{field} >= {EMAIL_LEVEL}"),
        Level("jaro_winkler of users", f"jw_user_{field} >= {EMAIL_LEVEL}"),
        Level("else", "ELSE"),
    )
    measures = (Measure(f"jw_{field}", "jaro_winkler", left, right), Measure(f"jw_user_{field}", "jaro_winkler", user(left), user(right)))
    return with_defaults(Comparison(field, (field,), levels, measures))


def default_comparisons() -> list[Comparison]:
    return [jaro_winkler_at("first_name", NAME_LEVELS), jaro_winkler_at("last_name", NAME_LEVELS), birth_date("date_of_birth"), email_address("email"), jaro_winkler_at("address", ADDRESS_LEVELS)]


def voter_comparisons() -> list[Comparison]:
    """Without the email, which voter files lack."""
    return [c for c in default_comparisons() if c.name != "email"]


def weaken_comparison(c: Comparison, strength: float = 0.1) -> Comparison:
    """Agreement on the field counts less: m of all agreeing levels times ``strength``, the rest of the mass to ELSE; u and the null level stay."""
    if not 0 < strength <= 1:
        raise ValueError("strength must be above 0 and at most 1")
    agree = sum(x.m * strength for x in c.levels if not x.is_null and not x.is_else)
    level = lambda x: x if x.is_null else replace(x, m=max(1 - agree, 0.0) if x.is_else else x.m * strength)
    return replace(c, levels=tuple(level(x) for x in c.levels))


def compare(pairs: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """``pairs`` with ``gamma_<name>`` for each comparison."""
    measures = {m.name: m.column() for c in comparisons for m in c.measures}
    out = pairs.withColumns(measures) if measures else pairs
    return out.withColumns({f"gamma_{c.name}": c.gamma() for c in comparisons}).drop(*measures)
