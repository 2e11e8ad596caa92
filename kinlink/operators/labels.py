"""Truth pairs and labels of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running
from .prepare import pool_order


def resolve_truth(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct (s1_id, target_id) whose sides both exist."""
    s1 = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    pool = records.where("source <> 'S1'").select(F.col("entity_id").alias("target_id"))
    return truth.select("s1_id", "target_id").distinct().join(s1, "s1_id", "left_semi").join(pool, "target_id", "left_semi").select("s1_id", "target_id")


def resolution_stats(truth: DataFrame, records: DataFrame) -> DataFrame:
    """One row: resolved pairs, unresolved pairs, singletons among the queries."""
    good = resolve_truth(truth, records)
    singles = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id")).join(good, "s1_id", "left_anti")
    every = truth.select("s1_id", "target_id").distinct()
    return good.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(every.agg(F.count(F.lit(1)).alias("all"))).crossJoin(singles.agg(F.count(F.lit(1)).alias("singletons"))).select("pairs", (F.col("all") - F.col("pairs")).alias("unresolved"), "singletons")


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with ``label``: 1 for true pairs, else 0."""
    t = truth.select("s1_id", "target_id").distinct().withColumn("_t", F.lit(1))
    return candidates.join(t, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("_t", F.lit(0))).drop("_t")


def query_rank(queries: DataFrame) -> DataFrame:
    """s1_id with ``row``: its place, from 0, among the queries in the order of their ids (source prefix, number, id)."""
    ids = queries.select("s1_id").distinct()
    return running(ids, pool_order("s1_id"), F.lit(1)).withColumnRenamed("before", "row")


def of_queries(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs whose query is among ``queries``."""
    return pairs.join(queries.select("s1_id").distinct(), "s1_id", "left_semi")


def sample_queries(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n queries in hash order: a sample without replacement that reruns agree on."""
    return queries.select("s1_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "s1_id")), "s1_id").limit(n)


def query_slice(queries: DataFrame, lo: float, hi: float) -> DataFrame:
    """Queries from the fraction ``lo`` of all rows to the fraction ``hi``, in the order of their ids; places are rounded down."""
    ranked = query_rank(queries)
    n = F.broadcast(queries.select("s1_id").distinct().agg(F.count(F.lit(1)).alias("_n")))  # one row
    at = lambda x: F.floor(F.lit(x) * F.col("_n") + 1e-9)
    return ranked.crossJoin(n).where((F.col("row") >= at(lo)) & (F.col("row") < at(hi))).select("s1_id")
