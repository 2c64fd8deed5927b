"""Command line: ``python -m kinsieve.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinsieve.operators import sampling, synth, training
from kinsieve.operators.model import LinkModel
from kinsieve.plans import experiments as ex
from kinsieve.plans.resolve import Resolver, as_response, render
from kinsieve.sources import voter
from kinsieve.sources.records import FIELDS, compact, query_frame, read_people, with_row_number, write_csv, write_document, write_metrics
from kinsieve.sources.store import ParquetStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinsieve")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        c = sub.add_parser(name)
        for flag, default in options.items():
            kind = {"type": type(default)} if default is not None and not isinstance(default, (bool, list)) else {}
            if isinstance(default, list):
                kind = {"nargs": "+", "type": type(default[0])}
            c.add_argument(f"--{flag.replace('_', '-')}", default=default, **kind)

    fields = dict.fromkeys(FIELDS)
    command("generate", count=50000, missing_rate=0.3, seed=42, output_dir="data")
    command("search", index_dir="data", input_json=None, k=20, threshold=0.85, json=None, **fields)
    command("extract", input="", output="")
    command("subset", input="", output="")
    command("sample", input="", output="", count=5000, seed=42)
    command("confusion", count=5000, k=20, threshold=0.85, address_strength=1.0, missing_rate=0.3, seed=42, input_records=None, output="confusion.json")
    command("suite", count=1000, missing_rate=0.3, input_records=None, storage_dir="suite_store", csv_output="suite_metrics.csv", latency_samples=ex.LATENCY_SAMPLES, ablation_count=250, k_values=[10, 20, 50, 100], thresholds=list(ex.TAUS), strategies=list(ex.STRATEGIES), seed=42, output="suite.json")
    em = {"max_pairs": training.MAX_PAIRS, "max_iterations": training.MAX_ITERATIONS, "em_convergence": training.CONVERGENCE}
    command("calibration", index_dir=None, count=2000, train_method="supervised", train_rows=2000, smoothing=training.SMOOTHING, prior=LinkModel.untrained().prior, k=20, threshold=0.85, missing_rate=0.3, input_records=None, seed=42, **em, output="calibration.json")
    command("duplicates", base_count=100000, match_rate=0.03, max_pairs=2000000, seed=42, output="duplicates.json")
    command("sweep", missing_rate=0.3, input_records=None, count=5000, thresholds=list(ex.TAUS), address_strengths=list(ex.STRENGTHS), seed=42, output="sweep.json")
    command("interaction", missing_rate=0.3, input_records=None, count=5000, taus=list(ex.TAUS), seed=42, max_pairs=200000, output="interaction.json")
    command("surface", missing_rate=0.3, input_records=None, count=5000, priors=list(ex.PRIORS), taus=list(ex.TAUS), seed=42, max_pairs=200000, output="surface.json")
    command("voter-recall", sample="", queries=1000, k_values=[5, 10, 20, 50, 100], mutation_seed=7, output="voter_recall.json")
    command("voter-resolution", sample="", in_index=3000, positives=1500, negatives=1500, k=20, threshold=0.85, address_strength=1.0, mutation_seed=7, output="voter_resolution.json")
    command("voter-sweep", sample="", in_index=3000, positives=1500, negatives=1500, k=20, mutation_seed=7, output="voter_sweep.json")
    return p


def _search(spark: SparkSession, a: argparse.Namespace) -> str:
    record = json.loads(Path(a.input_json).read_text()) if a.input_json else {f: getattr(a, f) for f in FIELDS}
    query = query_frame(spark, record).withColumn("query_id", F.lit("INPUT_QUERY"))
    resolver = Resolver.from_store(spark, a.index_dir, k=a.k)
    found = resolver.resolve(query, a.threshold).orderBy("match_rank").collect()  # k rows at most
    return json.dumps(as_response(found), indent=2) if a.json else render(found, min(a.k, len(resolver.store)))


def _population(spark: SparkSession, a: argparse.Namespace):
    if getattr(a, "input_records", None):
        people = with_row_number(read_people(spark, a.input_records), "position").cache()
        close = synth.introduce_variations(people, seed=a.seed, require_change=True)
        return people, synth.labelled_cases(people, close, synth.generate_people(spark, people.count(), seed=a.seed + 1))
    return ex.population(spark, a.count, a.seed, missing_rate=a.missing_rate)


def _calibration_cases(spark: SparkSession, a: argparse.Namespace):
    """All people of a saved store, with labelled queries of the first ``count``; without a store as ``_population``."""
    if not a.index_dir:
        return _population(spark, a)
    people = ParquetStore.load(spark, a.index_dir).rows().select("position", *FIELDS).cache()
    some = people.where(F.col("position") < a.count)
    close = synth.introduce_variations(some, seed=a.seed, require_change=True)
    return people, synth.labelled_cases(some, close, synth.generate_people(spark, a.count, a.missing_rate, a.seed + 1)).cache()


def _voters(spark: SparkSession, path: str):
    return compact(voter.load_people(spark, path).drop("voter_reg_num").withColumnRenamed("row_no", "position")).cache()


def _variants(spark: SparkSession, people, a: argparse.Namespace):
    close = synth.introduce_variations(people, seed=a.seed + 5, require_change=True)
    return ex.training_variants(people, synth.labelled_pairs(people, close, synth.generate_people(spark, a.count, seed=a.seed + 6)), a.max_pairs)


def run(spark: SparkSession, argv: list[str]) -> str:
    p = parser()
    a = p.parse_args(argv)
    c = a.command
    if c == "search":
        return _search(spark, a)
    if c == "generate":
        ParquetStore.build(synth.generate_people(spark, a.count, a.missing_rate, a.seed)).save(a.output_dir)
        return f"saved {a.count} people to {a.output_dir}"
    if c in ("extract", "subset"):
        source = voter.read_voter_tsv(spark, a.input, "ISO-8859-1" if c == "extract" else "UTF-8")
        write_csv(voter.extract(source) if c == "extract" else voter.subset(source), a.output)
        return json.dumps(voter.extract_counts(source).first().asDict())
    if c == "sample":
        rows = with_row_number(spark.read.option("header", True).csv(a.input))
        write_csv(sampling.uniform_sample(rows, a.count, "row_no", a.seed).drop("row_no"), a.output)
        return f"sampled {a.count} rows"
    if c == "confusion":
        got = ex.confusion_experiment(*_population(spark, a), k=a.k, tau=a.threshold, address_strength=a.address_strength)
    elif c == "suite":
        if a.ablation_count > a.count:
            p.error("--ablation-count can't exceed --count")
        people, cases = _population(spark, a)
        strategies = ex.suite(people, cases, a.strategies, a.k_values, a.thresholds, storage_dir=a.storage_dir, latency_samples=a.latency_samples)
        got = {"strategies": strategies, "ablations": ex.ablation_experiment(people, a.ablation_count, ks=a.k_values, taus=a.thresholds)}
        write_metrics(ex.suite_tables(spark, strategies), a.csv_output)
    elif c == "duplicates":
        got = ex.duplicate_benchmark(spark, a.base_count, a.match_rate, a.seed, max_pairs=a.max_pairs)
    elif c == "calibration":
        people, cases = _calibration_cases(spark, a)
        trained = ex.trained_model(people, a.train_method, a.train_rows, a.smoothing, a.prior, a.max_pairs, a.max_iterations, a.em_convergence, a.seed)
        got = ex.calibration_experiment(people, cases, trained, a.k, a.threshold)
    elif c in ("interaction", "surface"):
        people, cases = _population(spark, a)
        variants = _variants(spark, people, a)
        got = ex.surface_experiment(people, cases, variants, a.priors, a.taus) if c == "surface" else ex.interaction_experiment(people, cases, variants, a.taus)
    elif c == "sweep":
        got = ex.f1_sweep(*_population(spark, a), None, a.address_strengths, a.thresholds)
    elif c == "voter-recall":
        got = ex.voter_recall(_voters(spark, a.sample), a.queries, a.k_values, a.mutation_seed)
    elif c == "voter-resolution":
        got = ex.voter_resolution(_voters(spark, a.sample), a.in_index, a.positives, a.negatives, a.k, a.threshold, a.address_strength, a.mutation_seed)
    else:
        got = ex.voter_f1_sweep(_voters(spark, a.sample), a.in_index, a.positives, a.negatives, a.k, a.mutation_seed)
    write_document({"parameters": {k: v for k, v in vars(a).items() if k != "command"}, "result": got}, a.output)
    return f"saved {a.output}"


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.appName("kinsieve").getOrCreate(), sys.argv[1:]))
