"""End-to-end plans: candidates, training, inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinlink.operators import blocking, decision, features, labels, ranker
from kinlink.operators.prepare import prepare, spread
from kinlink.sources import tsv
from kinlink.sources.shared import cut


@dataclass(frozen=True)
class Inference:
    """What a run gives: candidates with probabilities, matches, and both as id lists for every S1 record.

    ``counters`` (matched pairs, those ranked first by the blocker, best probability) is filled when ``matches`` or ``match_lists`` is computed.
    """

    scored: DataFrame
    matches: DataFrame
    candidate_lists: DataFrame
    match_lists: DataFrame
    counters: Observation


def candidates(entities: DataFrame, b: blocking.Blocking = blocking.Blocking()) -> tuple[DataFrame, DataFrame]:
    """(records, candidates) of raw entities."""
    records = spread(prepare(entities))
    return records, blocking.block(records, b)


def train(entities: DataFrame, truth: DataFrame, b: blocking.Blocking = blocking.Blocking(top_k=35), trees: ranker.Trees = ranker.LARGE, share: float = 0.8) -> tuple[PipelineModel, dict[str, float]]:
    """Fit on the first ``share`` of the queries and search the two thresholds on the rest."""
    records, found = candidates(entities, b)
    truth = labels.resolve_truth(truth, records)
    pairs = labels.label(features.features(found, records), truth)
    queries = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    last = labels.query_slice(queries, share, 1.0)
    # training stops when the later queries improve no more
    held = last.withColumn("_later", F.lit(True))
    pairs = cut(pairs.join(held, "s1_id", "left").withColumn("_later", F.coalesce("_later", F.lit(False))))
    model = ranker.train(pairs, trees, validation="_later")
    scored = ranker.predict(model, pairs.where("_later")).select("s1_id", "target_id", "prob")
    points = decision.grid(entities.sparkSession, *decision.TWO_STAGE)
    best = decision.best_point(decision.sweep(scored, last, labels.of_queries(truth, last), points)).first()
    return model, {"t_singleton": best["t_singleton"], "t_match": best["t_match"], "val_f05": best["macro_f"]}


def infer(entities: DataFrame, model: PipelineModel, policy: dict[str, float], b: blocking.Blocking = blocking.Blocking()) -> Inference:
    """Candidates, probabilities and matches of every S1 record."""
    records, found = candidates(entities, b)
    scored = ranker.predict(model, features.features(found, records)).select("s1_id", "target_id", "prob")
    scored = scored.join(found.select("s1_id", "target_id", "rank"), ["s1_id", "target_id"])
    counters = Observation("matches")
    matches = decision.decide(scored, policy["t_match"], policy["t_singleton"])
    matches = matches.observe(counters, F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("rank") == 1).alias("first_ranked"), F.max("prob").alias("best"))
    queries = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    return Inference(scored, matches, tsv.id_lists(queries, found, "candidate_entity_ids"), tsv.id_lists(queries, matches, "matched_entity_ids"), counters)
