"""Fellegi-Sunter scores of compared pairs, and what is decided by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .comparison import Comparison, compare
from .model import LinkModel


def level_weight(model: LinkModel, c: Comparison) -> Column:
    """The weight of a pair's level, from a table: the level is read once, so that the levels' conditions are not repeated where plans are merged."""
    weights = model.weights(c)
    table = F.array(*[F.lit(weights.get(v, 0.0)) for v in range(-1, max(weights) + 1)])
    return F.element_at(table, F.col(f"gamma_{c.name}") + 2)


def match_weight(model: LinkModel) -> Column:
    """Prior log-odds and the weights of all levels."""
    total = F.lit(model.prior_weight)
    for c in model.comparisons:
        total = total + level_weight(model, c)
    return total


def probability(weight: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def score(pairs: DataFrame, model: LinkModel, compared: bool = False) -> DataFrame:
    """``pairs`` with gammas (unless ``compared``), ``match_weight`` and ``match_probability``. Nothing is filtered, so any threshold can follow."""
    out = pairs if compared else compare(pairs, model.comparisons)
    return out.withColumn("match_weight", match_weight(model)).withColumn("match_probability", probability(F.col("match_weight")))


def link(pairs: DataFrame, model: LinkModel, tau: float | None = None) -> DataFrame:
    """Scored pairs at ``tau`` or more."""
    return score(pairs, model).where(F.col("match_probability") >= (model.tau if tau is None else tau))


def _best_first(scored: DataFrame) -> Window:
    more = [F.col("blocking_score").desc()] if "blocking_score" in scored.columns else []
    return Window.partitionBy("query_id").orderBy(F.round("match_probability", 9).desc(), *more, F.col("position").asc())


def ranked(matches: DataFrame) -> DataFrame:
    """Matches with ``match_rank`` in their query: by probability (equal to 9 decimals is a tie), then blocking score, then position."""
    return matches.withColumn("match_rank", F.row_number().over(_best_first(matches)))


def best_match(matches: DataFrame) -> DataFrame:
    return ranked(matches).where("match_rank = 1").drop("match_rank")


def candidate_report(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """All candidates with the probability of those that match, null for the others."""
    return candidates.join(matches.select("query_id", "position", "match_probability"), ["query_id", "position"], "left")


def max_probability(queries: DataFrame, scored: DataFrame) -> DataFrame:
    """The greatest probability of each query; 0 without candidates."""
    most = scored.groupBy("query_id").agg(F.max("match_probability").alias("p"))
    return queries.join(most, "query_id", "left").withColumn("max_probability", F.coalesce("p", F.lit(0.0))).drop("p")


def matched_queries(matches: DataFrame) -> DataFrame:
    return matches.select("query_id").distinct()


def with_priors(scored: DataFrame, model: LinkModel, priors: Sequence[float]) -> DataFrame:
    """Each pair for each prior without scoring again: the prior is one term of the weight. ``scored`` has the model's own prior."""
    shifts = F.array(*[F.struct(F.lit(p).alias("prior"), F.lit(model.with_(prior=p).prior_weight - model.prior_weight).alias("shift")) for p in priors])
    out = scored.withColumn("x", F.explode(shifts))
    return out.withColumn("prior", F.col("x.prior")).withColumn("match_weight", F.col("match_weight") + F.col("x.shift")).withColumn("match_probability", probability(F.col("match_weight"))).drop("x")
