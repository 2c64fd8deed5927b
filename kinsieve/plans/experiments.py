"""The evaluations: labelled queries, blocking, one scoring pass, and all measures from it.

What an evaluation scores is written out once per call by the caller's choice of storage
(``cache``) and read by each measure; grids over thresholds, strengths and priors never
score again. Results are small documents.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsieve.operators import blocking, comparison, evaluation as ev, knn, sampling, scoring, synth, training
from kinsieve.operators.model import TAU, LinkModel
from kinsieve.sources.records import compact
from kinsieve.sources.store import ParquetStore, stored_bytes

from .resolve import Resolver

#: Defaults of the evaluations.
KS, TAUS, STRENGTHS = (10, 20, 50, 100), (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95), (0.6, 0.8, 0.9, 1.0)
PRIORS, STRATEGIES, SCORING_K = (1e-5, 1e-4, 1e-3, 1e-2), ("default", "identity_first", "compact"), 20
#: Queries whose single searches are timed, by default.
LATENCY_SAMPLES = 5


def row(df: DataFrame) -> dict:
    return df.first().asDict()


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def population(spark: SparkSession, count: int, seed: int = 42, require_change: bool = True, missing_rate: float = synth.MISSING_RATE) -> tuple[DataFrame, DataFrame]:
    """People and their labelled queries."""
    people = synth.generate_people(spark, count, missing_rate, seed).cache()
    close = synth.introduce_variations(people, seed=seed, require_change=require_change)
    strangers = synth.generate_people(spark, count, missing_rate, seed + 1)
    return people, synth.labelled_cases(people, close, strangers).cache()


def best_probability(cases: DataFrame, scored: DataFrame, *keys: str) -> DataFrame:
    most = scored.groupBy("query_id", *keys).agg(F.max("match_probability").alias("p"))
    return cases.join(most, ["query_id", *keys], "left").withColumn("probability", F.coalesce("p", F.lit(0.0))).drop("p")


def confusion_experiment(people: DataFrame, cases: DataFrame, model: LinkModel | None = None, k: int = SCORING_K, tau: float = TAU, address_strength: float = 1.0) -> dict:
    """Decisions at one threshold: matrix, metrics and counts by category."""
    began = time.time()
    model = (model or LinkModel.untrained()).weakened("address", address_strength)
    resolver = Resolver.default(people, model=model, k=k)
    scored = resolver.scored(cases).select("query_id", "match_probability")
    decided = best_probability(cases.select("query_id", "category", "expected_match"), scored).withColumn("predicted", F.col("probability") >= tau).cache()
    out = {"parameters": {"k": k, "tau": tau, "address_strength": address_strength}, "result": row(ev.confusion_matrix(decided)), "by_category": rows(ev.confusion_by(decided, "category").orderBy("category"))}
    decided.unpersist()
    return out | {"timing": {"seconds": time.time() - began}}


def _latency(store: ParquetStore, cases: DataFrame, k: int, samples: int) -> dict:
    """Milliseconds of searches for one query each (embedding and blocking), for a uniform sample of the cases."""
    spark, took = cases.sparkSession, []
    for r in sampling.uniform_sample(cases, samples, "query_id").collect():
        one = spark.createDataFrame([r], cases.schema)
        began = time.perf_counter()
        store.search(one, k).collect()
        took.append(((time.perf_counter() - began) * 1000,))
    if not took:
        return {"mean": 0.0, "p50": 0.0, "p95": 0.0, "p99": 0.0, "samples": 0}
    return row(ev.latency_percentiles(spark.createDataFrame(took, "ms double"), "ms")) | {"samples": len(took)}


def suite(
    people: DataFrame, cases: DataFrame, strategies: Sequence[str] = STRATEGIES, ks: Sequence[int] = KS, taus: Sequence[float] = TAUS, scoring_k: int = SCORING_K, model: LinkModel | None = None,
    storage_dir: str | None = None, latency_samples: int = LATENCY_SAMPLES,
) -> dict:
    """For each serialisation: build seconds, stored bytes, recall at each k from one search, thresholds, calibration, latency of single queries, and
    milliseconds a query from end to end.

    A store is saved below ``storage_dir`` (a folder that all executors share), read again for the searches and left there; without a folder
    it is cached and the bytes are null. Latency is measured on ``latency_samples`` queries, each a search of its own.
    """
    spark, model, out = cases.sparkSession, model or LinkModel.untrained(), {}
    n = cases.count()
    for strategy in strategies:
        began = time.perf_counter()
        store, size = ParquetStore.build(people, text=strategy), None
        if storage_dir:
            path = f"{storage_dir.rstrip('/')}/{strategy}"
            store.save(path)
            store, size = ParquetStore.load(spark, path), stored_bytes(spark, path)
        else:
            store.rows().cache().count()
        build_seconds = time.perf_counter() - began
        latency = _latency(store, cases, max(ks), latency_samples)
        found = store.search(cases, max(ks)).cache()
        hits = knn.hit_rank(found, cases)
        fields = [c for c in cases.columns if c in comparison_fields()]
        found.count()
        began = time.perf_counter()
        pairs = blocking.attach(found.where(F.col("rank") <= scoring_k), cases.select("query_id", *fields), store.rows().select("position", *fields))
        scored = scoring.score(pairs, model).select("query_id", "match_probability")
        best = best_probability(cases.select("query_id", "category", "expected_match"), scored).cache()
        best.count()
        scoring_seconds = time.perf_counter() - began
        out[strategy] = {
            "build_seconds": build_seconds,
            "stored_bytes": size,
            "scoring_k": scoring_k,
            "recall": rows(knn.recall_at_k(hits, list(ks)).orderBy("k")),
            "thresholds": rows(ev.threshold_grid(best, taus).orderBy("tau_order")),
            "calibration": rows(ev.calibration_bins(best).orderBy("bin")),
            "latency_ms": latency,
            "scoring_seconds": scoring_seconds,
            "end_to_end_ms": latency["mean"] + scoring_seconds / max(n, 1) * 1000,
        }
        found.unpersist()
        best.unpersist()
        if not storage_dir:
            store.rows().unpersist()
    return out


def suite_tables(spark: SparkSession, got: dict) -> list[DataFrame]:
    """Recall and threshold tables of a suite's result, for ``write_metrics``: a row for each strategy and parameter."""
    recall = [("blocking_recall", name, str(r["k"]), float(r["recall"])) for name, x in got.items() for r in x["recall"]]
    counts = ("tp", "fn", "fp", "tn")
    measures = ("accuracy", "precision", "recall", "specificity", "f1", "false_match_rate")
    grid = [("threshold_metrics", name, str(r["tau"]), *[r[c] for c in counts], *[float(r[c]) for c in measures]) for name, x in got.items() for r in x["thresholds"]]
    head = "`table` string, strategy string, parameter string"
    return [
        spark.createDataFrame(recall, f"{head}, recall double"),
        spark.createDataFrame(grid, ", ".join([head, *[f"{c} bigint" for c in counts], *[f"{c} double" for c in measures]])),
    ]


def comparison_fields() -> list[str]:
    return [f for c in comparison.default_comparisons() for f in c.fields]


def ablation_experiment(people: DataFrame, count: int, k: int = SCORING_K, tau: float = TAU, model: LinkModel | None = None, ks: Sequence[int] = (), taus: Sequence[float] = ()) -> list[dict]:
    """Decisions and recall for each controlled change of the first ``count`` people; with ``ks`` and ``taus`` also recall at each and the grid of thresholds, from one search."""
    variants = synth.ablation_variants(people.where(F.col("position") < count))
    cases = variants.select(F.concat_ws("_", "category", "true_position").alias("query_id"), F.lit(True).alias("expected_match"), *variants.columns).cache()
    resolver = Resolver.default(people, model=model or LinkModel.untrained(), k=max(k, *ks, 0))
    found = resolver.candidates(cases).cache()
    fields = [c for c in cases.columns if c in comparison_fields()]
    pairs = blocking.attach(found.where(F.col("rank") <= k), cases.select("query_id", *fields), resolver.store.rows().select("position", *fields))
    scored = scoring.score(pairs, resolver.model).select("query_id", "match_probability")
    hits = cases.select("query_id", "category").join(knn.hit_rank(found, cases), "query_id")
    best = best_probability(cases.select("query_id", "category", "expected_match"), scored).cache()
    predicted = best.withColumn("predicted", F.col("probability") >= tau)
    within = hits.groupBy("category").agg(F.avg((F.coalesce("hit_rank", F.lit(k + 1)) <= k).cast("double")).alias("recall_at_k"))
    out = rows(ev.confusion_by(predicted, "category").join(within, "category").orderBy("category"))
    recall = rows(knn.recall_at_k(hits, list(ks), "category").orderBy("category", "k")) if ks else []
    grid = rows(ev.threshold_grid(best, taus, "category").orderBy("category", "tau_order")) if taus else []
    for r in out:
        if ks:
            r["blocking_recall"] = [x for x in recall if x["category"] == r["category"]]
        if taus:
            r["thresholds"] = [x for x in grid if x["category"] == r["category"]]
    for df in (cases, found, best):
        df.unpersist()
    return out


def training_variants(people: DataFrame, pairs: DataFrame, max_pairs: int = 200_000) -> dict[str, LinkModel]:
    """Untrained, supervised and EM models, and EM with the untrained prior."""
    base = LinkModel.untrained()
    em = training.train(people, base, max_pairs=max_pairs)
    return {"untrained": base, "supervised": training.calibrate(pairs, base), "em": em, "em_prior_reset": em.with_(prior=base.prior)}


def trained_model(people: DataFrame, method: str = "supervised", train_rows: int = 2000, smoothing: float = training.SMOOTHING, prior: float | None = None, max_pairs: int = training.MAX_PAIRS,
                  max_iterations: int = training.MAX_ITERATIONS, convergence: float = training.CONVERGENCE, seed: int = 42) -> LinkModel:
    """A model fitted from labelled pairs of the first ``train_rows`` people (``supervised``, with ``prior`` or the untrained one), or by ``em`` on all people."""
    base = LinkModel.untrained()
    if method == "em":
        return training.train(people, base, max_pairs=max_pairs, seed=seed, max_iterations=max_iterations, convergence=convergence)
    if method != "supervised":
        raise ValueError(f"no training method {method}")
    some = people.where(F.col("position") < train_rows)
    close = synth.introduce_variations(some, seed=seed, require_change=True)
    strangers = synth.generate_people(people.sparkSession, train_rows, seed=seed + 1)
    model = training.calibrate(synth.labelled_pairs(some, close, strangers), base, smoothing)
    return model.with_(prior=base.prior if prior is None else prior)


def calibration_experiment(people: DataFrame, cases: DataFrame, trained: LinkModel, k: int = SCORING_K, tau: float = TAU) -> dict:
    """Untrained and trained model at one threshold: matrix, metrics and counts by category of each. Pairs are blocked and compared once, as the models share their levels."""
    began = time.perf_counter()
    compared = comparison.compare(Resolver.default(people, model=trained, k=k).pairs(cases), trained.comparisons)
    compared = compared.select("query_id", *[f"gamma_{c.name}" for c in trained.comparisons]).cache()
    compared.count()
    out = {"training": {"prior": trained.prior}, "timing": {"blocking_seconds": time.perf_counter() - began, "query_total_ms": {}}, "variants": {}}
    for name, model in (("untrained", LinkModel.untrained()), ("trained", trained)):
        began = time.perf_counter()
        best = best_probability(cases.select("query_id", "category", "expected_match"), scoring.score(compared, model, compared=True))
        decided = best.withColumn("predicted", F.col("probability") >= tau).cache()
        out["variants"][name] = {"result": row(ev.confusion_matrix(decided)), "by_category": rows(ev.confusion_by(decided, "category").orderBy("category"))}
        out["timing"]["query_total_ms"][name] = (time.perf_counter() - began) * 1000
        decided.unpersist()
    compared.unpersist()
    return out


def interaction_experiment(people: DataFrame, cases: DataFrame, variants: dict[str, LinkModel], taus: Sequence[float] = TAUS, k: int = SCORING_K) -> dict:
    """Each model at each threshold: the grid, its best point and mean probabilities. Pairs are blocked and compared once, as the models share their levels."""
    any_model = next(iter(variants.values()))
    pairs = Resolver.default(people, model=any_model, k=k).pairs(cases)
    compared = comparison.compare(pairs, any_model.comparisons).select("query_id", *[f"gamma_{c.name}" for c in any_model.comparisons]).cache()
    out = {}
    for name, model in variants.items():
        best = best_probability(cases.select("query_id", "expected_match"), scoring.score(compared, model, compared=True)).cache()
        grid = ev.threshold_grid(best, taus)
        out[name] = {"prior": model.prior, "grid": rows(grid.orderBy("tau_order")), "best": row(ev.best_point(grid, "tau_order")), "means": rows(ev.mean_probability(best).orderBy("expected_match"))}
        best.unpersist()
    compared.unpersist()
    return out


def surface_experiment(people: DataFrame, cases: DataFrame, variants: dict[str, LinkModel], priors: Sequence[float] = PRIORS, taus: Sequence[float] = TAUS, k: int = SCORING_K) -> dict:
    """f1 for each prior and threshold; one scoring pass a model, the prior shifts its weights."""
    pairs = Resolver.default(people, model=next(iter(variants.values())), k=k).pairs(cases).cache()
    out = {}
    for name, model in variants.items():
        scored = scoring.with_priors(scoring.score(pairs, model).select("query_id", "match_weight", "match_probability"), model, priors)
        grid_cases = cases.select("query_id", "expected_match", F.explode(F.array(*[F.lit(p) for p in priors])).alias("prior"))
        grid = ev.threshold_grid(best_probability(grid_cases, scored, "prior"), taus, "prior").cache()
        out[name] = {"surface": rows(grid.select("prior", "tau", "f1").orderBy("prior", "tau")), "best": row(ev.best_point(grid, "prior", "tau_order"))}
        grid.unpersist()
    pairs.unpersist()
    return out


def f1_sweep(people: DataFrame, cases: DataFrame, model: LinkModel | None = None, strengths: Sequence[float] = STRENGTHS, taus: Sequence[float] = TAUS, k: int = SCORING_K) -> dict:
    """Address strength by threshold, from levels compared once; strengths above 1 are left out."""
    base = model or LinkModel.untrained()
    strengths = [s for s in strengths if s <= 1]
    variants = {str(s): base.weakened("address", s) for s in strengths}
    got = interaction_experiment(people, cases, variants, taus, k)
    grid = [{"strength": s} | point for s in strengths for point in got[str(s)]["grid"]]
    best = None
    for point in grid:
        if best is None or point["f1"] > best["f1"]:
            best = point
    return {"grid": grid, "best": best}


def duplicate_benchmark(spark: SparkSession, count: int, match_rate: float = 0.03, seed: int = 42, k: int = SCORING_K, tau: float = TAU, max_pairs: int = 200_000) -> dict:
    """A reference with twins; queries are fresh variations of the twinned people, and strangers. Untrained, supervised and EM models."""
    people = synth.generate_people(spark, count, seed=seed).cache()
    twinned = sampling.rate_sample(people, match_rate, "position", seed).cache()
    fields = ["first_name", "last_name", "date_of_birth", "address", "email"]
    n = twinned.count()
    reference = synth.duplicate_bearing(people, synth.introduce_variations(twinned, seed=seed + 2, require_change=True), count)
    reference = compact(reference.select("position", *fields)).cache()
    fresh = synth.introduce_variations(twinned, seed=seed + 3, require_change=True)
    strangers = synth.generate_people(spark, n, seed=seed + 1)
    cases = (
        fresh.select(F.concat(F.lit("Q_pos_"), "position").alias("query_id"), F.lit("match").alias("category"), F.lit(True).alias("expected_match"), F.col("position").alias("true_position"), *fields)
        .unionByName(strangers.select(F.concat(F.lit("Q_neg_"), "position").alias("query_id"), F.lit("nonmatch").alias("category"), F.lit(False).alias("expected_match"), F.lit(None).cast("bigint").alias("true_position"), *fields))
        .cache()
    )
    pairs = synth.labelled_pairs(twinned, synth.introduce_variations(twinned, seed=seed + 2, require_change=True), synth.generate_people(spark, count, seed=seed + 4))
    variants = training_variants(reference.select("position", *fields), pairs, max_pairs)
    out = {name: confusion_experiment(reference.select("position", *fields), cases, model, k, tau) for name, model in variants.items() if name != "em_prior_reset"}
    for df in (people, twinned, reference, cases):
        df.unpersist()
    return out


def voter_cases(voters: DataFrame, in_index: int, positives: int, negatives: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Reference and queries of a voter file: mutations of the first indexed people, and people that are not in the index."""
    fields = ["first_name", "last_name", "date_of_birth", "address", "email"]
    reference = voters.where(F.col("position") < in_index)
    noisy = synth.mutate_voters(reference.where(F.col("position") < positives), seed)
    outside = voters.where((F.col("position") >= in_index) & (F.col("position") < in_index + negatives))
    case = lambda df, kind, match: df.select(
        F.concat(F.lit(f"Q_{kind}_"), "position").alias("query_id"), F.lit(kind).alias("category"), F.lit(match).alias("expected_match"), (F.col("position") if match else F.lit(None).cast("bigint")).alias("true_position"), *fields
    )
    return reference, case(noisy, "pos", True).unionByName(case(outside, "neg", False))


def voter_recall(voters: DataFrame, queries: int, ks: Sequence[int] = (5, 10, 20, 50, 100), seed: int = 7) -> list[dict]:
    """Blocking recall of mutated voters against all."""
    _, cases = voter_cases(voters, voters.count(), queries, 0, seed)
    found = ParquetStore.build(voters).search(cases, max(ks))
    return rows(knn.recall_at_k(knn.hit_rank(found, cases), list(ks)).orderBy("k"))


def voter_resolution(voters: DataFrame, in_index: int, positives: int, negatives: int, k: int = SCORING_K, tau: float = TAU, address_strength: float = 1.0, seed: int = 7) -> dict:
    """Decisions on mutated voters in the index and on others outside."""
    reference, cases = voter_cases(voters, in_index, positives, negatives, seed)
    return confusion_experiment(reference, cases, LinkModel.untrained(comparison.voter_comparisons()), k, tau, address_strength)


def voter_f1_sweep(voters: DataFrame, in_index: int, positives: int, negatives: int, k: int = SCORING_K, seed: int = 7, strengths: Sequence[float] = (0.8, 1.0), taus: Sequence[float] = (0.85, 0.9, 0.95)) -> dict:
    reference, cases = voter_cases(voters, in_index, positives, negatives, seed)
    return f1_sweep(reference, cases, LinkModel.untrained(comparison.voter_comparisons()), strengths, taus, k)
