"""Quality of candidates and matches against the truth (long tables: s1_id, target_id).

Queries are the S1 ids of ``queries``; a query without truth rows is a singleton.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import running


def _pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(s1_id, target_id, t, f): every distinct pair, and whether it is true and found; a query's pairs are dealt together, once."""
    side = lambda pairs, t, f: pairs.select("s1_id", "target_id", F.lit(t).alias("t"), F.lit(f).alias("f"))
    both = side(truth, True, False).unionByName(side(found, False, True)).repartition("s1_id")
    return both.groupBy("s1_id", "target_id").agg(F.bool_or("t").alias("t"), F.bool_or("f").alias("f"))


def _per_query(queries: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """s1_id, n_true, n_found, n_hit of every query."""
    hit = F.col("t") & F.col("f") & F.col("target_id").isNotNull()
    pairs = _pairs(truth, found).groupBy("s1_id").agg(F.count_if("t").alias("n_true"), F.count_if("f").alias("n_found"), F.count_if(hit).alias("n_hit"))
    zero = F.lit(0).cast("bigint")
    return queries.select("s1_id").distinct().join(pairs, "s1_id", "left").select("s1_id", *[F.coalesce(c, zero).alias(c) for c in ("n_true", "n_found", "n_hit")])


def f_beta(n_true: Column, n_found: Column, n_hit: Column, beta: float = 0.5) -> Column:
    """Score of one query: a singleton counts 1 if nothing is predicted for it, else 0."""
    p, r, b = n_hit / n_found, n_hit / n_true, beta * beta
    return F.when(n_true == 0, F.when(n_found == 0, 1.0).otherwise(0.0)).when(n_hit == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def entity_scores(queries: DataFrame, truth: DataFrame, matches: DataFrame, beta: float = 0.5) -> DataFrame:
    per = _per_query(queries, truth, matches)
    return per.withColumn("f_beta", f_beta(F.col("n_true"), F.col("n_found"), F.col("n_hit"), beta))


def macro(queries: DataFrame, truth: DataFrame, matches: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row: macro F-beta, micro precision and recall, singleton accuracy, matches of a query."""
    s = entity_scores(queries, truth, matches, beta)
    return s.agg(
        F.round(F.coalesce(F.avg("f_beta"), F.lit(0.0)), 6).alias("macro_f"),
        F.round(F.coalesce(F.try_divide(F.sum("n_hit"), F.sum("n_found")), F.lit(0.0)), 6).alias("micro_precision"),
        F.round(F.coalesce(F.try_divide(F.sum("n_hit"), F.sum("n_true")), F.lit(0.0)), 6).alias("micro_recall"),
        F.round(F.avg(F.when(F.col("n_true") == 0, (F.col("n_found") == 0).cast("double"))), 6).alias("singleton_accuracy"),
        F.count_if(F.col("n_true") == 0).alias("true_singletons"),
        F.count_if(F.col("n_found") == 0).alias("predicted_singletons"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def blocking_quality(queries: DataFrame, truth: DataFrame, candidates: DataFrame, n_targets: DataFrame) -> DataFrame:
    """One row: pair completeness (1 without truth), reduction ratio, candidates of a query, totals.

    ``n_targets``: one row with the size of the target pool.
    """
    s = _per_query(queries, truth, candidates).agg(F.sum("n_hit").alias("hit"), F.sum("n_true").alias("true"), F.sum("n_found").alias("cand"), F.count(F.lit(1)).alias("q"))
    every = F.col("q") * F.col("n_targets")
    return s.crossJoin(F.broadcast(n_targets.limit(1))).select(
        F.round(F.coalesce(F.try_divide("hit", "true"), F.lit(1.0)), 6).alias("pair_completeness"),
        F.round(F.coalesce(1 - F.try_divide(F.col("cand"), every), F.lit(1.0)), 8).alias("reduction_ratio"),
        F.round(F.coalesce(F.try_divide("cand", "q"), F.lit(0.0)), 6).alias("avg_candidates"),
        F.coalesce("cand", F.lit(0)).alias("candidate_pairs"),
        F.coalesce("true", F.lit(0)).alias("true_pairs"),
        F.coalesce("hit", F.lit(0)).alias("recalled_pairs"),
    )


def blocking_report(queries: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row over queries with truth: mean recall, queries without and with full recall; and singletons."""
    s = _per_query(queries, truth, candidates)
    has = F.col("n_true") > 0
    return s.agg(
        F.round(F.avg(F.when(has, F.col("n_hit") / F.when(has, F.col("n_true")))), 6).alias("mean_recall"),
        F.count_if(has & (F.col("n_hit") == 0)).alias("zero_recall"),
        F.count_if(has & (F.col("n_hit") == F.col("n_true"))).alias("full_recall"),
        F.count_if(~has).alias("singletons"),
        F.count_if(F.col("n_found") == 0).alias("without_candidates"),
    )


def missed_pairs(truth: DataFrame, found: DataFrame, per_query: int = 2, limit: int | None = 15) -> DataFrame:
    """True pairs not found: at most ``per_query`` of a query, the first ``limit`` by id."""
    # a pair with a missing id equals no other
    unmet = ~F.col("f") | F.col("s1_id").isNull() | F.col("target_id").isNull()
    missed = _pairs(truth, found).where(F.col("t") & unmet).select("s1_id", "target_id")
    order = Window.partitionBy("s1_id").orderBy("target_id")
    out = missed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_query).drop("n")
    return out if limit is None else out.orderBy("s1_id", "target_id").limit(limit)


def truth_counts(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """n_true of every query (0: a singleton)."""
    n = truth.select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("s1_id").distinct().join(n, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_true"))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve with ties counted half, from the counts at each distinct score.

    Rows are counted per score first; the running count goes over distinct scores only.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    area = running(per, [F.col("s")], F.col("n")).withColumn("a", F.col("p") * (F.col("before") + F.col("n") / 2))
    return area.agg(F.round(F.try_divide(F.sum("a"), F.sum("p").cast("double") * F.sum("n")), 6).alias("roc_auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def probability_profile(best: DataFrame, prob: str = "max_p", bounds: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.30, 0.40)) -> DataFrame:
    """One row: 5th, 10th and 20th percentile (linear) of a column, and the share of rows below each bound."""
    p = F.percentile(prob, F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2)))
    below = [F.round(F.avg((F.col(prob) < b).cast("double")), 6).alias(f"below_{round(b * 100):02d}") for b in bounds]
    return best.agg(p.alias("_p"), *below).select(*[F.round(F.col("_p")[i], 6).alias(n) for i, n in enumerate(("p05", "p10", "p20"))], *[f"below_{round(b * 100):02d}" for b in bounds])


def counted(lists: DataFrame, column: str, sink: Callable[[DataFrame], None]) -> dict[str, float]:
    """Give ``lists`` (comma-joined ids in ``column``, a row for each query) to ``sink`` and count on the way.

    Returns queries, ids, queries with ids, seconds, and queries a second; the rows are read once, by the sink.
    """
    n = F.when(F.col(column) == "", 0).otherwise(F.size(F.split(column, ",")))
    seen = Observation()
    began = time.perf_counter()
    sink(lists.observe(seen, F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum(n), F.lit(0)).alias("ids"), F.count_if(n > 0).alias("non_empty")))
    seconds = time.perf_counter() - began
    return {**seen.get, "seconds": seconds, "per_second": seen.get["queries"] / seconds}
