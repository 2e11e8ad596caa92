"""From probabilities to matches, and the search for thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import f_beta, truth_counts

# fixed values: threshold grids of the searches
SINGLE = [round(0.45 + 0.01 * i, 2) for i in range(44)]
TWO_STAGE = ([0.40, 0.425, 0.45, 0.475, 0.50, 0.525, 0.55, 0.575, 0.60, 0.625, 0.65], [0.45, 0.475, 0.50, 0.525, 0.55, 0.575, 0.60, 0.625, 0.65, 0.675, 0.70, 0.725, 0.75])
TWO_STAGE_WIDE = (
    [0.0, 0.02, 0.05, 0.08, 0.10, 0.12, 0.15, 0.18, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50],
    [0.30, 0.35, 0.40, 0.45, 0.50, 0.52, 0.55, 0.57, 0.60, 0.625, 0.65, 0.68, 0.70, 0.75],
)
DEFAULT_POLICY = {"t_singleton": 0.48, "t_match": 0.65}


def decide(scored: DataFrame, t_match: float, t_singleton: float = 0.0) -> DataFrame:
    """Matches of (s1_id, target_id, prob): all with prob >= t_match of queries whose best reaches t_singleton."""
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    # before queries are dealt: a query's best is among these, or it has no match
    good = scored.where(F.col("prob") >= t_match)
    return good.withColumn("_best", best).where(F.col("_best") >= t_singleton).drop("_best")


def grid(spark: SparkSession, singles: list[float], matches: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a in singles for b in matches], "t_singleton double, t_match double")


def sweep(scored: DataFrame, queries: DataFrame, truth: DataFrame, points: DataFrame) -> DataFrame:
    """Macro F0.5 at every point of the grid (a bounded table, broadcast).

    Candidates shrink to one row for each query first: the sorted (probability, true) list that every threshold needs.  The
    grid then meets queries, not pairs, and only sums leave a task.
    """
    hits = scored.join(truth.select("s1_id", "target_id").distinct().withColumn("_t", F.lit(1)), ["s1_id", "target_id"], "left")
    per = hits.groupBy("s1_id").agg(F.collect_list(F.struct("prob", F.coalesce("_t", F.lit(0)).alias("t"))).alias("ps"), F.max("prob").alias("best"))
    per = truth_counts(queries, truth).join(per, "s1_id", "left")
    met = per.crossJoin(F.broadcast(points))
    kept = F.filter("ps", lambda p: p["prob"] >= F.col("t_match"))
    open_ = F.coalesce(F.col("best") >= F.col("t_singleton"), F.lit(False))
    found = F.when(open_, F.size(kept)).otherwise(0)
    hit = F.when(open_, F.size(F.filter(kept, lambda p: p["t"] == 1))).otherwise(0)
    met = met.select("t_singleton", "t_match", "n_true", found.alias("found"), hit.alias("hit"))
    f = f_beta(F.col("n_true"), F.col("found"), F.col("hit"))
    zero = F.lit(0.0)
    return met.groupBy("t_singleton", "t_match").agg(
        F.round(F.avg(f), 6).alias("macro_f"),
        F.round(F.coalesce(F.try_divide(F.sum("hit"), F.sum("found")), zero), 6).alias("micro_precision"),
        F.round(F.coalesce(F.try_divide(F.sum("hit"), F.sum("n_true")), zero), 6).alias("micro_recall"),
        F.round(F.coalesce(F.avg(F.when(F.col("n_true") == 0, (F.col("found") == 0).cast("double"))), zero), 6).alias("singleton_accuracy"),
    )


def best_point(swept: DataFrame) -> DataFrame:
    """The point of the highest score; the first in grid order wins ties."""
    return swept.orderBy(F.col("macro_f").desc(), "t_singleton", "t_match").limit(1)


def write_policy(path: str, t_singleton: float, t_match: float, score: float) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"t_singleton": t_singleton, "t_match": t_match, "val_f05": score}, f)


def read_policy(path: str | None, argument: float | None = None, model: float | None = None) -> dict[str, float]:
    """Thresholds: from the policy file, else the argument, else the model, else the default."""
    if path:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    t = next((x for x in (argument, model) if x is not None), DEFAULT_POLICY["t_match"])
    return {"t_singleton": DEFAULT_POLICY["t_singleton"], "t_match": t}
