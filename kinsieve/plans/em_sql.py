"""Expectation-maximisation said in SQL: a step is a CTE, and a session that has come to its end passes its values on."""

from __future__ import annotations

from kinsieve.operators import training
from kinsieve.operators.model import LinkModel

from . import fixture as X

PAIRED_SQL = ", ".join(f"a.{f} as {f}_l, b.{f} as {f}_r" for f in X.FIELDS)


def hash_sql(seed: int, tag: str, key: str) -> str:
    return f"cast('0x' || left(md5('{seed}:{tag}:' || {key}), 15) as bigint)"


def random_pairs_sql(n_pairs: int, seed: int = 42) -> str:
    """``drawn (position_l, position_r)``: different random pairs of ``person``."""
    place = lambda tag: f"{hash_sql(seed, tag, 'i')} % (select count(*) from person)"
    return f"drawn as materialized (select distinct least(a, b) as position_l, greatest(a, b) as position_r from (select {place('l')} as a, {place('r')} as b from range({n_pairs}) t(i)) where a <> b)"


def _levels_sql(source: str, extra: str = "") -> str:
    return " union all ".join(f"select {extra}'{f}' as comparison, gamma_{f} as level from {source}" for f in X.LEVELS)


def u_sql(n_pairs: int) -> str:
    """``u_seen (comparison, level, u)`` from random pairs."""
    return f"""{random_pairs_sql(n_pairs)}, u_cand as (select {PAIRED_SQL} from drawn d join person a on a.position = d.position_l join person b on b.position = d.position_r),
      u_gam as (select {X.GAMMAS_SQL} from u_cand), u_counts as (select comparison, level, count(*) as n from ({_levels_sql('u_gam')}) where level >= 0 group by all),
      u_seen as materialized (select comparison, level, n / sum(n) over (partition by comparison) as u from u_counts)"""


def _session_sql(name: str, rule: tuple[str, ...], steps: int, convergence: float) -> str:
    """CTEs of one session; the last is ``<name>_<steps>``. Without pairs its rows are not read."""
    join = " and ".join(f"a.{c} = b.{c}" for c in rule)
    gammas = ", ".join(f"gamma_{f}" for f in X.LEVELS)
    fixed = ", ".join(f"'{c}'" for c in rule)
    out = f"""{name}_cand as (select {PAIRED_SQL} from person a join person b on {join} and a.position < b.position), {name}_gam as (select {X.GAMMAS_SQL} from {name}_cand),
      {name}_pat as materialized (select row_number() over () as pid, * from (select {gammas}, count(*) as n from {name}_gam group by {gammas})),
      {name}_long as materialized (select * from ({_levels_sql(f'{name}_pat', 'pid, n, ')}) where comparison not in ({fixed})),
      {name}_0 as materialized (select comparison, level, m, u, (select prior from base) as lam, true as live from model where comparison not in ({fixed}))"""
    for k in range(1, steps + 1):
        s, t = f"{name}_{k - 1}", f"{name}_{k}"
        out += f""", {t}_odds as (select l.pid, any_value(l.n) as n, (select any_value(lam) from {s}) * product(coalesce(s.m, 1.0)) as a, (1 - (select any_value(lam) from {s})) * product(coalesce(s.u, 1.0)) as b
        from {name}_long l left join {s} s using (comparison, level) group by l.pid),
      {t}_match as materialized (select pid, n, case when a + b > 0 then a / greatest(a + b, 1e-300) else 0.0 end * n as w from {t}_odds),
      {t}_part as (select comparison, level, sum(w) as w from {name}_long join {t}_match using (pid) where level >= 0 group by all), {t}_known as (select comparison, sum(w) as known from {t}_part group by all),
      {t}_new as (select s.*, case when known > 0 then coalesce(p.w, 0.0) / known else m end as new from {s} s left join {t}_part p using (comparison, level) left join {t}_known using (comparison)),
      {t} as materialized (select comparison, level, case when live then new else m end as m, u, case when live then least(greatest((select sum(w) / sum(n) from {t}_match), 1e-12), 1 - 1e-12) else lam end as lam,
        live and max(abs(new - m)) over () >= {convergence} as live from {t}_new)"""
    return out


def fit_sql(model: LinkModel) -> str:
    """The fitted model's levels ``(comparison, level, label, m, u, prior)``, rounded."""
    rows = [(c.name, v, x.label, x.m, x.u) for c in model.comparisons for x, v in zip(c.levels, c.values, strict=True) if not x.is_null]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    start = ", ".join(f"({quote(a)}, {b}, {quote(c)}, {d!r}::double, {e!r}::double)" for a, b, c, d, e in rows)
    rules = training.TRAINING_RULES
    found = " or ".join("(" + " and ".join(f"a.{c} = b.{c}" for c in r) + ")" for r in rules)
    prior = f"least(count(*) / {training.RECALL}::double / (select count(*) * (count(*) - 1) / 2 from person), 1.0)"
    sessions = ",\n".join(_session_sql(f"s{k}", r, training.MAX_ITERATIONS, training.CONVERGENCE) for k, r in enumerate(rules))
    ends = " union all ".join(f"select comparison, level, m from s{k}_{training.MAX_ITERATIONS} where exists (select 1 from s{k}_pat)" for k in range(len(rules)))
    return f"""{X.BASE_SQL}, {u_sql(training.MAX_PAIRS)}, start (comparison, level, label, m, u) as (values {start}),
      model as materialized (select comparison, level, label, m, coalesce(x.u, s.u) as u from start s left join u_seen x using (comparison, level)),
      base as materialized (select least(greatest({prior}, 1e-12), 1 - 1e-9) as prior from person a join person b on a.position < b.position and ({found})),
      {sessions}, ends as (select comparison, level, avg(m) as m from ({ends}) group by all)
      select comparison, cast(level as int) as level, label, round(coalesce(e.m, o.m), 6) as m, round(o.u, 6) as u, round((select prior from base), 9) as prior from model o left join ends e using (comparison, level)"""
