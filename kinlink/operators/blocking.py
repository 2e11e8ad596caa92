"""Candidate generation: rare tokens and composite keys, summed per pair, best k targets of each query.

All probes are equi-joins on a 64-bit hash of (namespace, token) or (family, key).  Three rules bound what a hot key can do:
* Rare-token joins only see tokens up to a document-frequency cap, applied before the join.
* A key's targets travel packed, as one list for each query that has the key; a list has at most ``wide`` targets.
* Keys of more targets are not expanded.  What they can add to a target is at most the sum R of their weights.  If a query's
  k-th best sum over the other keys exceeds R, no target that only they find can be among the best k; targets whose sum comes
  within R of the k-th best are finalists, and the wide keys that such a pair shares are looked up, not joined.  Queries for
  which this does not settle the result, and all if a key has more than ``dense`` hits on average, are searched slice against
  slice (``slices``), without expanded keys.  Results are exact either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.functions import vocabulary as V
from kinlink.sources.shared import cut

from . import keys as K
from . import prepare as P
from . import slices


@dataclass(frozen=True)
class Blocking:
    """Parameters of the blocker."""

    name_cap: int = 250
    addr_cap: int = 250
    doc_tokens: int = 4
    query_tokens: int = 5
    addr_weight: float = 0.8
    top_k: int = 30
    key_cap: int | None = None
    token_weight: str = "log1p_df"
    wide: int = 1000
    dense: int = 15
    max_tokens: int | None = V.MAX_TOKENS
    max_keys: int | None = V.MAX_KEYS


#: Sums in another order, and their single-precision forms, differ by less.
SLACK = 1e-4

#: Rare tokens that are sent to all tasks, at most.
FEW_TOKENS = 50_000


def token_counts(tokens: DataFrame) -> DataFrame:
    """(ns, token, df): occurrences of each token among the targets."""
    return tokens.groupBy("ns", "token").agg(F.count(F.lit(1)).alias("df"))


def document_counts(tokens: DataFrame) -> DataFrame:
    """(ns, token, df): records that hold each token."""
    return tokens.groupBy("ns", "token").agg(F.countDistinct("entity_id").alias("df"))


def _cap(b: Blocking) -> Column:
    return F.when(F.col("ns") == "name", F.lit(b.name_cap)).otherwise(F.lit(b.addr_cap))


def _own(df: DataFrame) -> list[str]:
    return [c for c in ("entity_id", "source", "row") if c in df.columns]


def _rare(tokens: DataFrame, counts: DataFrame, b: Blocking) -> DataFrame:
    """Tokens under the cap, with ``df``."""
    return tokens.join(counts.where(F.col("df") <= _cap(b)), ["ns", "token"])


def rare_doc_tokens(tokens: DataFrame, counts: DataFrame | None, b: Blocking = Blocking()) -> DataFrame:
    """Postings: each target's rarest distinct tokens under the cap, ties by first position.  Without ``counts`` tokens have ``df`` and are rare."""
    rare = tokens if counts is None else _rare(tokens, counts, b)
    rare = rare.groupBy(*_own(tokens), "ns", "token", "df").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("entity_id", "ns").orderBy("df", "pos")
    return rare.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= b.doc_tokens).select(*_own(tokens), "ns", "token", "df", "pos", "rank")


def rare_query_tokens(tokens: DataFrame, counts: DataFrame | None, b: Blocking = Blocking(), documents: int | None = None) -> DataFrame:
    """Each query's rarest tokens under the cap (repeats count), with their weight.  Without ``counts`` tokens have ``df`` and are rare."""
    rare = tokens if counts is None else _rare(tokens, counts, b)
    order = Window.partitionBy("entity_id", "ns").orderBy("df", "pos")
    if b.token_weight == "idf":
        weight = F.log((F.lit(1.0) + F.lit(documents or 0)) / (1 + F.col("df"))) + 1
    else:
        weight = F.log1p("df")
    return rare.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= b.query_tokens).select(*_own(tokens), "ns", "token", "df", "pos", "rank", weight.alias("weight"))


def _rare_sides(records: DataFrame, b: Blocking) -> tuple[DataFrame, DataFrame]:
    """Probes and postings of rare tokens, weights scaled by namespace."""
    tok = P.tokens(records, b.max_tokens)
    counts = cut(token_counts(P.targets(tok)).where(F.col("df") <= _cap(b)))
    # few tokens, as a rule: the others leave before rows are dealt
    known = F.broadcast(counts) if counts.count() <= FEW_TOKENS else counts
    tok = cut(tok.join(known, ["ns", "token"]))
    pool, asked = P.targets(tok), P.queries(tok)
    n = records.where("source <> 'S1'").count() if b.token_weight == "idf" else None
    scale = F.when(F.col("ns") == "name", 1.0).otherwise(b.addr_weight)
    probes = rare_query_tokens(asked, None, b, n).withColumn("weight", F.col("weight") * scale)
    return probes, rare_doc_tokens(pool, None, b)


def rare_hits(records: DataFrame, b: Blocking = Blocking()) -> DataFrame:
    """(s1_id, target_id, channel, weight) from equal rare tokens."""
    probes, posts = _rare_sides(records, b)
    hits = probes.select("ns", "token", F.col("entity_id").alias("s1_id"), "weight").join(posts.select("ns", "token", F.col("entity_id").alias("target_id")), ["ns", "token"])
    return hits.select("s1_id", "target_id", F.col("ns").alias("channel"), "weight")


def _capped(pool: DataFrame, b: Blocking, *key: str) -> DataFrame:
    if b.key_cap is None:
        return pool
    return pool.join(pool.groupBy(*key).count().where(F.col("count") <= b.key_cap).drop("count"), list(key))


def key_counts(records: DataFrame, family: str, b: Blocking = Blocking()) -> DataFrame:
    """(s1_id, n_targets): how many targets share a query's key of one family; targets are counted, not paired."""
    table = K.key_table(records).where(F.col("family") == family)
    n = _capped(table.where("source <> 'S1'"), b, "family", "key").groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"))
    return table.where("source = 'S1'").join(n, ["family", "key"]).groupBy(F.col("entity_id").alias("s1_id")).agg(F.sum("n").alias("n_targets"))


def top_k(pairs: DataFrame, k: int, order: list[str | Column] | None = None) -> DataFrame:
    """The best k targets of each query by score, ties by ``order`` (by default the pool's order of target ids); adds ``rank`` from 1."""
    by = Window.partitionBy("s1_id").orderBy(F.col("score").desc(), *(order or P.pool_order("target_id")))
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _best(k: int):
    """Per query with its packed hits: the finalists with their sums, or one row without a target if wide keys must be expanded."""

    def run(batches):
        for batch in batches:
            q, wide = np.asarray(batch.column(0)), batch.column(2)
            hits = batch.column(1)
            lists = hits.flatten()
            weight, posts = np.asarray(lists.field("weight")), lists.field("posts")
            entries = posts.flatten()
            size = np.diff(np.asarray(posts.offsets)[posts.offset :][: len(posts) + 1]) if len(posts) else np.zeros(0, dtype=np.int64)
            per = np.diff(np.asarray(hits.offsets)[hits.offset :][: len(hits) + 1])
            owner = np.repeat(np.repeat(np.arange(len(q)), per), size)
            t, mask, w = np.asarray(entries.field("t")), np.asarray(entries.field("mask")), np.repeat(weight, size)
            order = np.lexsort((t, owner))
            owner, t, mask, w = owner[order], t[order], mask[order], w[order]
            new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0)) if len(t) else np.zeros(0, dtype=np.int64)
            score = np.add.reduceat(w, new) if len(new) else np.zeros(0)
            owner, t, mask = owner[new], t[new], mask[new]
            # what a target's wide keys can add: those of the query whose bit the target has
            more, every = np.zeros(len(t)), np.zeros(len(q))
            first = np.searchsorted(owner, np.arange(len(q) + 1))
            for i in np.flatnonzero(np.asarray(wide.is_valid())):
                for x in wide[int(i)].as_py():
                    part = slice(first[i], first[i + 1])
                    more[part] += np.where(mask[part] >> (x["h"] % 63) & 1, x["weight"], 0.0)
                    every[i] += x["weight"]
            order = np.lexsort((t, -score.astype(np.float32), owner))
            owner, t, score, more = owner[order], t[order], score[order], more[order]
            kth = np.where(np.diff(first) >= k, score[np.minimum(first[:-1] + k - 1, max(0, len(score) - 1))] if len(score) else 0.0, -np.inf)
            settled = (every == 0) | (kth > every + SLACK)
            place = np.arange(len(t)) - first[owner]
            keep = settled[owner] & np.where(every[owner] > 0, score + more >= kth[owner] - SLACK, place < k)
            open_ = np.flatnonzero(~settled)
            yield pa.record_batch(
                [pa.array(np.concatenate([q[owner[keep]], q[open_]])), pa.array(np.concatenate([t[keep], np.full(len(open_), -1)])), pa.array(np.concatenate([score[keep], np.zeros(len(open_))]))],
                names=["q", "t", "score"],
            )

    return run


def _joined(asked_of: DataFrame, pool_of: DataFrame, sizes: DataFrame, b: Blocking) -> DataFrame:
    """(q, t, score, rank): the best targets by a join of the keys that are not wide, ``sizes`` being the targets of each key."""
    asked, pool = asked_of.select("q", F.inline("x")), pool_of.select("t", F.inline("x")).select("t", "h")
    wide = cut(sizes.where(F.col("n") > b.wide).select("h"))
    bit = F.expr("shiftleft(1L, cast(pmod(h, 63) as int))")
    wide_of_target = cut(pool.join(wide, "h").groupBy("t").agg(F.collect_list("h").alias("wide"), F.bit_or(bit).alias("mask")))
    light = pool.join(wide, "h", "left_anti").join(wide_of_target.select("t", "mask"), "t", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    posts = light.groupBy("h").agg(F.collect_list(F.struct("t", "mask")).alias("posts"))
    # a list of one query: its keys, 19 at most, and its rare tokens, each with at most ``wide`` targets
    hits = asked.join(posts, "h").groupBy("q").agg(F.collect_list(F.struct("weight", "posts")).alias("hits"))
    wide_of_query = cut(asked.join(wide, "h").groupBy("q").agg(F.collect_list(F.struct("h", "weight")).alias("wide")))
    hits = hits.join(wide_of_query, "q", "full").select("q", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"), "wide")
    found = cut(hits.mapInArrow(_best(b.top_k), "q long, t long, score double"))
    finalists = found.where("t >= 0").join(wide_of_target.select("t", F.col("wide").alias("_t")), "t", "left").join(wide_of_query.select("q", F.col("wide").alias("_q")), "q", "left")
    shared = F.filter("_q", lambda x: F.array_contains("_t", x["h"]))
    added = F.coalesce(F.aggregate(F.transform(shared, lambda x: x["weight"]), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    pairs = finalists.select("q", "t", (F.col("score") + added).cast("float").alias("score"))
    open_ = found.where("t < 0").select("q")
    if not open_.isEmpty():
        rest = slices.best_of_packed(asked_of.select("q", "x").join(open_, "q"), pool_of.select("t", "x"), b.top_k)
        pairs = pairs.unionByName(rest.select("q", "t", F.col("score").cast("float").alias("score")))
    best = top_k(pairs.withColumnRenamed("q", "s1_id"), b.top_k, ["t"])
    return best.withColumnRenamed("s1_id", "q")


def block(records: DataFrame, b: Blocking = Blocking(), rare: bool = True) -> DataFrame:
    """Candidates (s1_id, target_id, score, rank) of every query with a hit; without ``rare`` from composite keys alone.

    Sums are made in double precision and kept in single; ties go by the target pool's order.
    """
    records = records if "row" in records.columns else P.spread(records)
    # keys of queries and targets in one pass; a row for each record, so no list is dealt
    table = cut(K.packed_keys(records, b.max_keys))
    asked, pool = P.queries(table), P.targets(table)
    if b.key_cap is not None:
        few = _capped(pool.select("entity_id", "row", F.inline("x")), b, "h")
        pool = cut(few.groupBy("entity_id", "row").agg(F.collect_list(F.struct("h", "weight")).alias("x")))
    asked, pool = asked.select("entity_id", "row", "x"), pool.select("entity_id", "row", "x")
    if rare:
        probes, posts = _rare_sides(records, b)
        token = lambda side, weight: cut(side.select("entity_id", "row", F.array(F.struct(F.xxhash64("ns", "token").alias("h"), weight.cast("double").alias("weight"))).alias("x")))
        asked, pool = asked.unionByName(token(probes, F.col("weight"))), pool.unionByName(token(posts, F.lit(1.0)))
    asked, pool = asked.toDF("s1_id", "q", "x"), pool.toDF("target_id", "t", "x")
    flat = lambda side, one: side.select(F.lit(one).alias("one"), F.inline("x")).select("one", "h")
    sizes = flat(asked, 1).unionByName(flat(pool, 0)).groupBy("h").agg(F.sum("one").alias("keys"), F.sum(1 - F.col("one")).alias("n"))
    moved = sizes.agg(F.sum("keys").alias("keys"), F.sum(F.when(F.col("n") <= b.wide, F.col("keys") * F.col("n"))).alias("hits")).first()
    if (moved["hits"] or 0) > b.dense * (moved["keys"] or 0):
        rows = table.agg(F.count_if(F.col("source") == "S1"), F.count_if(F.col("source") != "S1")).first()
        best = slices.best_of_packed(asked, pool, b.top_k, rows=tuple(rows))
    else:
        name = lambda a, c: records.select(F.col("row").alias(a), F.col("entity_id").alias(c))
        best = _joined(asked, pool, sizes.where("n > 0"), b).join(name("q", "s1_id"), "q").join(name("t", "target_id"), "t")
    return best.select("s1_id", "target_id", F.col("score").cast("float").alias("score"), "rank")
