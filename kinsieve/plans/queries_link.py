"""Queries on scoring, decisions, evaluation and training."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.operators import blocking, blocks, comparison, evaluation as ev, model as m, scoring, synth, training

from kinsieve.operators.embedding import LetterCountEmbedder

from . import em_sql, fixture as X
from .resolve import K, Resolver

TAU = m.TAU
TAUS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.99)
STRENGTHS = (0.6, 0.8, 0.9, 1.0)
PRIORS = (1e-5, 1e-4, 1e-3, 1e-2)
STEPS = (1, 7, 101, 333)
RANDOM_PAIRS = 20_000


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.query_candidates(X.query(spark, sf_dir), X.person(spark, sf_dir), X.RULES)


def _scored(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """``(query_id, position, match_weight, match_probability)`` of all candidate pairs, or of those at a probability of ``least``."""
    floor = None if least is None else math.log2(least / (1 - least)) - 1e-6  # the probability itself decides
    got = blocks.scored_pairs(X.query(spark, sf_dir), X.person(spark, sf_dir), X.RULES, m.LinkModel.untrained(), floor)
    got = got.withColumn("match_probability", scoring.probability(F.col("match_weight")))
    return got if least is None else got.where(F.col("match_probability") >= least)


def _best(spark: SparkSession, sf_dir: str, *models: m.LinkModel) -> DataFrame:
    return blocks.best_weights(X.query(spark, sf_dir), X.person(spark, sf_dir), X.RULES, models or [m.LinkModel.untrained()])


def _p6(df: DataFrame) -> DataFrame:
    return df.withColumn("match_probability", F.round("match_probability", 6))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.query(spark, sf_dir).select("query_id", "category", "expected_match")
    best = _best(spark, sf_dir).select("query_id", scoring.probability(F.col("w0")).alias("match_probability"))
    return scoring.max_probability(q, best).withColumnRenamed("max_probability", "probability")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).withColumn("predicted", F.col("probability") >= TAU)


def match_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "position", F.round("match_weight", 6).alias("match_weight"))


def match_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(_scored(spark, sf_dir).select("query_id", "position", "match_probability"))


def link_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(_scored(spark, sf_dir, TAU).select("query_id", "position", "match_probability"))


def _resolver(spark: SparkSession, sf_dir: str) -> tuple[Resolver, DataFrame]:
    """The whole pipeline (nearest neighbours, comparison, score, decision) over all people, and the queries whose id is divisible by 50."""
    return Resolver.default(X.person(spark, sf_dir), LetterCountEmbedder()), X.query(spark, sf_dir).where("query_id % 50 = 0")


def pipeline_resolve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries' matches, ranked, with the record found."""
    resolver, queries = _resolver(spark, sf_dir)
    found = resolver.resolve(queries).select("query_id", "position", "match_rank", "match_probability", "blocking_score", "first_name", "last_name")
    return found.withColumns({c: F.round(c, 6) for c in ("match_probability", "blocking_score")})


def link_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scored(spark, sf_dir, TAU).withColumn("match_probability", F.round("match_probability", 6))
    return scoring.best_match(found).select("query_id", "position", "match_probability")


def link_all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("query_id", "position", F.round("match_probability", 6).alias("p"), F.col("match_probability").alias("_p"))
    return scored.select("query_id", "position", F.when(F.col("_p") >= TAU, F.col("p")).alias("match_probability"))


def resolver_rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-record resolver: the best of a query's nearest neighbours that share a rule with it, whatever its probability."""
    resolver, queries = _resolver(spark, sf_dir)
    return resolver.resolve_best(queries, tau=0.0).select("query_id", "position", F.round("match_probability", 6).alias("match_probability"), F.round("blocking_score", 6).alias("blocking_score"))


def max_probability_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("query_id", F.round("probability", 6).alias("probability"))


def matched_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matched_queries(_best(spark, sf_dir).where(scoring.probability(F.col("w0")) >= TAU))


_METRICS = ["accuracy", "precision", "recall", "specificity", "f1", "false_match_rate"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _METRICS if c in df.columns})


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.confusion_matrix(_decided(spark, sf_dir))).drop("false_match_rate")


def confusion_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy("category", ev.cell().alias("cell")).agg(F.count("*").alias("n"))


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.confusion_by(_decided(spark, sf_dir), "category")).select("category", "recall", "f1", "false_match_rate")


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.calibration_bins(_cases(spark, sf_dir).withColumn("probability", F.round("probability", 6))).withColumns({c: F.round(c, 6) for c in ("lower", "upper", "mean_probability", "match_rate")})


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.latency_percentiles(X.read(spark, sf_dir, "events"), "value")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


def mean_probability_by_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.mean_probability(_cases(spark, sf_dir))


def tau_sweep_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.threshold_grid(_cases(spark, sf_dir), TAUS)).select("tau", "tp", "fn", "fp", "tn", "f1")


def _strength_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best probability of each query for each strength of the address, from levels compared once; a weight that is greater is a probability that is."""
    found = _best(spark, sf_dir, *[m.LinkModel.untrained().weakened("address", s) for s in STRENGTHS])
    each = F.array(*[F.struct(F.lit(s).alias("strength"), scoring.probability(F.col(f"w{k}")).alias("p")) for k, s in enumerate(STRENGTHS)])
    best = found.select("query_id", F.inline(each))
    q = X.query(spark, sf_dir).select("query_id", "category", "expected_match", F.explode(F.array(*[F.lit(s) for s in STRENGTHS])).alias("strength"))
    return q.join(best, ["query_id", "strength"], "left").withColumn("probability", F.coalesce("p", F.lit(0.0))).drop("p")


def strength_tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.threshold_grid(_strength_cases(spark, sf_dir), TAUS, "strength")).select("strength", "tau", "tp", "fn", "fp", "tn", "f1")


def best_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _rounded(ev.threshold_grid(_strength_cases(spark, sf_dir), TAUS, "strength"))
    return ev.best_point(grid, "strength", "tau").select("strength", "tau", "f1")


def prior_tau_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = m.LinkModel.untrained()
    found = _best(spark, sf_dir, base).select("query_id", F.col("w0").alias("match_weight"))  # the best for one prior is the best for all
    best = scoring.with_priors(found, base, PRIORS).select("query_id", "prior", F.col("match_probability").alias("p"))
    q = X.query(spark, sf_dir).select("query_id", "expected_match", F.explode(F.array(*[F.lit(p) for p in PRIORS])).alias("prior"))
    cases = q.join(best, ["query_id", "prior"], "left").withColumn("probability", F.coalesce("p", F.lit(0.0)))
    return _rounded(ev.threshold_grid(cases, TAUS, "prior")).select("prior", "tau", "f1")


def _training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.person(spark, sf_dir)
    return synth.labelled_pairs(p, X.close_person(p), X.unrelated_person(spark, sf_dir))


def calibrate_m_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = training.calibrate(_training_pairs(spark, sf_dir), m.LinkModel.untrained())
    rows = [(c.name, v, round(x.m, 6), round(x.u, 6)) for c in fitted.comparisons for x, v in zip(c.levels, c.values, strict=True) if not x.is_null]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double")


def estimate_u_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, cs = X.person(spark, sf_dir), comparison.default_comparisons()
    compared = comparison.compare(training.stepped_pairs(p, STEPS), cs)
    return training.u_frequencies(compared, cs).withColumn("u", F.round("u", 6))


def estimate_u_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.u_all_pairs(X.person(spark, sf_dir), comparison.default_comparisons()).withColumn("u", F.round("u", 6))


def random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.random_pairs(X.person(spark, sf_dir).select("position"), RANDOM_PAIRS).select("position_l", "position_r")


def estimate_u_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    cs = comparison.default_comparisons()
    compared = comparison.compare(training.random_pairs(X.person(spark, sf_dir), training.MAX_PAIRS), cs)
    return training.u_frequencies(compared, cs).withColumn("u", F.round("u", 6))


def estimate_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.prior_table(X.person(spark, sf_dir), training.TRAINING_RULES).select("n_pairs", F.round("prior", 9).alias("prior"))


def em_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.pattern_counts(blocking.rule_pairs(X.person(spark, sf_dir), [("date_of_birth",)]), comparison.default_comparisons())


def em_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = training.train(X.person(spark, sf_dir), m.LinkModel.untrained())
    rows = [(c.name, v, x.label, round(x.m, 6), round(x.u, 6), round(fitted.prior, 9)) for c in fitted.comparisons for x, v in zip(c.levels, c.values, strict=True) if not x.is_null]
    return spark.createDataFrame(rows, "comparison string, level int, label string, m double, u double, prior double")


QUERIES = {
    f.__name__: f
    for f in (
        match_weights, match_probability, link_threshold, pipeline_resolve_batch, link_best_match, link_all_candidates, resolver_rule_filter, max_probability_per_query, matched_queries,
        confusion_matrix, confusion_by_category, classification_metrics, calibration_bins, latency_percentiles, mean_probability_by_truth, tau_sweep_f1, strength_tau_sweep,
        best_operating_point, prior_tau_surface, calibrate_m_u, estimate_u_systematic, estimate_u_all_pairs, random_pairs, estimate_u_random, estimate_prior,
        em_patterns, em_fit,
    )
}

_RATIO = {
    "accuracy": ("tp + tn", "tp + fn + fp + tn"),
    "precision": ("tp", "tp + fp"),
    "recall": ("tp", "tp + fn"),
    "specificity": ("tn", "tn + fp"),
    "f1": ("2 * tp", "2 * tp + fp + fn"),
    "false_match_rate": ("fp", "fp + tn"),
}
_M = {n: f"coalesce(round(({a}) / nullif({b}, 0), 6), 0.0) as {n}" for n, (a, b) in _RATIO.items()}
_CELLS = "count(*) filter (where expected_match and {p}) as tp, count(*) filter (where expected_match and not ({p})) as fn, count(*) filter (where not expected_match and {p}) as fp, count(*) filter (where not expected_match and not ({p})) as tn"
_AT = _CELLS.format(p=f"probability >= {TAU}")
_GRID = _CELLS.format(p="probability >= tau")
_TAUS = f"taus as (select unnest([{', '.join(f'{t}::double' for t in TAUS)}]) as tau)"


def _weak(strength: float) -> dict[str, dict[int, float]]:
    out = {f: X.default_weights_sql(n) for f, n in X.LEVELS.items()}
    if strength < 1:
        raw = [-5.0] + [3.0 + 7.0 * k / 3 for k in range(4)]
        mm = [0.05 / 4] * 4 + [0.95]
        total = sum(a / 2**w for a, w in zip(mm, raw, strict=True))
        uu = [a / 2**w / total for a, w in zip(mm, raw, strict=True)]
        weak = [0.0, *[a * strength for a in mm[1:]]]
        weak[0] = 1 - sum(weak[1:])
        out["address"] = {k: math.log2(a / b) for k, (a, b) in enumerate(zip(weak, uu, strict=True))}
    return out


_STRONG = X.COMPARED_SQL + ", " + ", ".join(X.score_sql(weights=_weak(s), name=f"sc{k}") for k, s in enumerate(STRENGTHS))
_STRONG += ", scs as (" + " union all ".join(f"select {s}::double as strength, q.query_id, q.expected_match, coalesce(max(match_probability), 0.0) as probability from query q left join sc{k} using (query_id) group by all" for k, s in enumerate(STRENGTHS)) + ")"
_SURF = X.COMPARED_SQL + ", " + ", ".join(X.score_sql(prior=p, name=f"sp{k}") for k, p in enumerate(PRIORS))
_SURF += ", sps as (" + " union all ".join(f"select {p}::double as prior, q.query_id, q.expected_match, coalesce(max(match_probability), 0.0) as probability from query q left join sp{k} using (query_id) group by all" for k, p in enumerate(PRIORS)) + ")"
_CLOSE = f"twin as (select position, first_name, {X.SWAP_SQL('last_name')} as last_name, date_of_birth, address, email from person)"
_PAIRED = ", ".join(f"a.{f} as {f}_l, b.{f} as {f}_r" for f in X.FIELDS)
_LABELLED = f"{X.BASE_SQL}, {_CLOSE}, cand as (" + " union all ".join(f"select {_PAIRED}, {y} as is_match from person a join {t} b using (position)" for t, y in (("person", 1), ("twin", 1), ("stranger", 0))) + ")"
_LEVELS_ALL = "levels as (" + " union all ".join(f"select '{f}' as comparison, {k} as level, {n + 1} as n_levels" for f, n in X.LEVELS.items() for k in range(n)) + ")"
_LONG = " union all ".join(f"select '{f}' as comparison, gamma_{f} as level{{extra}} from gam" for f in X.LEVELS)
_BEST = "(partition by query_id order by match_probability desc, position)"
_COUNT_SQL = "[" + ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::double" for c in LetterCountEmbedder.LETTERS) + "]"
_VECTORS_SQL = "".join(f", {n}_v as (select {i}, {_COUNT_SQL} as v from (select {i}, lower({X.TEXT_SQL}) as t from {n}{w}))" for n, i, w in (("query", "query_id", " where query_id % 50 = 0"), ("person", "position", "")))
_NEAREST_SQL = f""", near as (select * from (select query_id, position, round(list_cosine_similarity(q.v, p.v), 9) as blocking_score, row_number() over (partition by query_id order by round(list_cosine_similarity(q.v, p.v), 9) desc, position) as rank
  from query_v q cross join person_v p) where rank <= {K}), cand as (select near.query_id, near.position, blocking_score, {X.PAIR_FIELDS_SQL} from near join query q using (query_id) join person p using (position))"""
_RESOLVED_SQL = f"{X.BASE_SQL}{_VECTORS_SQL}{_NEAREST_SQL}, {X.GAMMA_SQL}, {X.score_sql()}"
_SHARE_SQL = "(first_name_l = first_name_r and last_name_l = last_name_r or date_of_birth_l = date_of_birth_r)"
_LINKED = f"{X.SCORED_SQL}, linked as (select query_id, position, round(match_probability, 6) as match_probability from scored where match_probability >= {TAU}), rk as (select *, row_number() over {_BEST} as match_rank from linked)"

ORACLE_SQL = {
    "match_weights": f"{X.SCORED_SQL} select query_id, position, round(match_weight, 6) as match_weight from scored",
    "match_probability": f"{X.SCORED_SQL} select query_id, position, round(match_probability, 6) as match_probability from scored",
    "link_threshold": f"{_LINKED} select * from linked",
    "pipeline_resolve_batch": f"""{_RESOLVED_SQL} select query_id, position, cast(row_number() over (partition by query_id order by round(match_probability, 9) desc, blocking_score desc, position) as int) as match_rank,
      round(match_probability, 6) as match_probability, round(blocking_score, 6) as blocking_score, first_name_r as first_name, last_name_r as last_name from scored join cand using (query_id, position) where match_probability >= {TAU}""",
    "link_best_match": f"{_LINKED} select query_id, position, match_probability from rk where match_rank = 1",
    "resolver_rule_filter": f"""{_RESOLVED_SQL} select query_id, position, round(match_probability, 6) as match_probability, round(blocking_score, 6) as blocking_score from (
      select *, row_number() over (partition by query_id order by round(match_probability, 9) desc, blocking_score desc, position) as n from scored join cand using (query_id, position) where {_SHARE_SQL}) where n = 1""",
    "link_all_candidates": f"{X.SCORED_SQL} select query_id, position, case when match_probability >= {TAU} then round(match_probability, 6) end as match_probability from scored",
    "max_probability_per_query": f"{X.CASES_SQL} select query_id, round(probability, 6) as probability from cases",
    "matched_queries": f"{_LINKED} select distinct query_id from linked",
    "confusion_matrix": f"{X.CASES_SQL}, c as (select {_AT} from cases) select *, {', '.join(v for k, v in _M.items() if k != 'false_match_rate')} from c",
    "confusion_by_category": f"{X.CASES_SQL} select category, case when expected_match then case when probability >= {TAU} then 'TP' else 'FN' end when probability >= {TAU} then 'FP' else 'TN' end as cell, count(*) as n from cases group by all",
    "classification_metrics": f"{X.CASES_SQL}, c as (select category, {_AT} from cases group by category) select category, {_M['recall']}, {_M['f1']}, {_M['false_match_rate']} from c",
    "calibration_bins": f"""{X.CASES_SQL}, b as (select least(cast(floor(round(probability, 6) * 10) as bigint), 9) as bin, count(*) as n, avg(round(probability, 6)) as p, avg(expected_match::int) as r from cases group by 1)
      select range as bin, round(range / 10, 6) as lower, round((range + 1) / 10, 6) as upper, coalesce(n, 0) as n, round(coalesce(p, 0.0), 6) as mean_probability, round(coalesce(r, 0.0), 6) as match_rate from range(10) left join b on range = bin""",
    "latency_percentiles": "select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events",
    "mean_probability_by_truth": f"{X.CASES_SQL} select expected_match, round(avg(probability), 4) as mean_probability from cases group by 1",
    "tau_sweep_f1": f"{X.CASES_SQL}, {_TAUS}, c as (select tau, {_GRID} from cases cross join taus group by tau) select tau, tp, fn, fp, tn, {_M['f1']} from c",
    "strength_tau_sweep": f"{_STRONG}, {_TAUS}, c as (select strength, tau, {_GRID} from scs cross join taus group by all) select strength, tau, tp, fn, fp, tn, {_M['f1']} from c",
    "best_operating_point": f"{_STRONG}, {_TAUS}, c as (select strength, tau, {_GRID} from scs cross join taus group by all) select strength, tau, {_M['f1']} from c order by f1 desc, strength, tau limit 1",
    "prior_tau_surface": f"{_SURF}, {_TAUS}, c as (select prior, tau, {_GRID} from sps cross join taus group by all) select prior, tau, {_M['f1']} from c",
    "calibrate_m_u": f"""{_LABELLED}, gam as (select is_match, {X.GAMMAS_SQL} from cand), long as ({_LONG.format(extra=', is_match')}), {_LEVELS_ALL},
      n as (select comparison, level, count(*) filter (where is_match = 1) as a, count(*) filter (where is_match = 0) as b from long group by all),
      t as (select count(*) filter (where is_match = 1) as m, count(*) filter (where is_match = 0) as u from cand)
      select comparison, cast(level as int) as level, round((coalesce(a, 0) + 0.5::double) / (t.m + 0.5::double * n_levels), 6) as m, round((coalesce(b, 0) + 0.5::double) / (t.u + 0.5::double * n_levels), 6) as u from levels left join n using (comparison, level) cross join t""",
    "estimate_u_systematic": f"""{X.BASE_SQL}, st as (select unnest([{', '.join(map(str, STEPS))}]) as step), cand as (select {_PAIRED} from person a cross join st join person b on b.position = (a.position + step) % (select count(*) from person) and a.position <> b.position),
      gam as (select {X.GAMMAS_SQL} from cand), long as ({_LONG.format(extra='')}), c as (select comparison, level, count(*) as n from long where level >= 0 group by all)
      select comparison, cast(level as int) as level, round(n / sum(n) over (partition by comparison), 6) as u from c""",
    "estimate_u_all_pairs": f"""{X.BASE_SQL}, cand as (select {_PAIRED} from person a join person b on a.position < b.position),
      gam as (select {X.GAMMAS_SQL} from cand), long as ({_LONG.format(extra='')}), c as (select comparison, level, count(*) as n from long where level >= 0 group by all)
      select comparison, cast(level as int) as level, round(n / sum(n) over (partition by comparison), 6) as u from c""",
    "random_pairs": f"{X.BASE_SQL}, {em_sql.random_pairs_sql(RANDOM_PAIRS)} select position_l, position_r from drawn",
    "estimate_u_random": f"{X.BASE_SQL}, {em_sql.u_sql(training.MAX_PAIRS)} select comparison, cast(level as int) as level, round(u, 6) as u from u_seen",
    "em_fit": em_sql.fit_sql(m.LinkModel.untrained()),
    "estimate_prior": f"""{X.BASE_SQL}, c as (select count(*) as n_pairs from person a join person b on a.position < b.position and (a.first_name = b.first_name or a.date_of_birth = b.date_of_birth))
      select n_pairs, round(least(n_pairs / 0.7::double / (select count(*) * (count(*) - 1) / 2 from person), 1.0), 9) as prior from c""",
    "em_patterns": f"""{X.BASE_SQL}, cand as (select {_PAIRED} from person a join person b on a.date_of_birth = b.date_of_birth and a.position < b.position), gam as (select {X.GAMMAS_SQL} from cand)
      select {', '.join(f'cast(gamma_{f} as int) as gamma_{f}' for f in X.LEVELS)}, count(*) as n from gam group by all""",
}
