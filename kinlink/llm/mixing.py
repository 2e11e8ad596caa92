"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are summed per source; capped targets are found by water-filling in the order in which sources hit their cap.
2. A source's documents are dealt by hash into blocks (at least ``least_blocks``, and about ``block_rows`` documents in each of
   more), and its blocks are put into a permuted order.  The mix draws ``passes`` whole rounds of all blocks and then a
   prefix of the permuted order; the block in which the quota ends is cut inside, in hash order of its documents, so the words
   taken equal the rounded target.  Running totals over a source's blocks go by stretches of the order, so no source is a task.
3. A splitting tree over the output shards divides every source's number of drawn block copies: a node gives its left
   half a multivariate hypergeometric sample of its quotas.  Leaf quotas are exact.  The tree runs twice: over STRATA groups of
   sources, and in each group, within the group's quotas, over its sources (a sample of a sample has the same law), so the
   driver holds one number for each group.  A shard then takes its quota from the source's permuted order, next to the
   preceding shard's, so draws are disjoint.  The seed fixes every draw.
4. Within a shard rows are ordered by hash (the local shuffle).

Words are counted once, into narrow rows; only ``mix``, which returns texts, counts them again where it reads them.  One narrow row
for each source is ordered in one task.

Defined results for odd inputs: a null or blank text has size 0, is never taken and belongs to its source; a null source
is a source of its own, ordered last; repeated rows are taken separately (each at most twice its size); a table without
words gives targets of 0; extra columns pass through and own columns win over equal names; keys are of any type that has text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import shield, stored, type_of

#: Words of a piece of a shard that one task shuffles.
PIECE_WORDS = 1_000_000
#: A word of the size measure.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) -> the same with ``target``.

    Weights repeat over the sources in code-point order, null last.  A source is capped at ``cap`` times its size; the
    excess goes to the others by weight.  The fixed point is min(cap * size, weight * level) for one level, found where
    the sources are ordered by the level at which they hit their cap.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    t = t.withColumn("level", (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # while earlier sources stand at their caps, this one does too if even its cap is below its share of what is left
    t = t.withColumn("capped", F.col("top") <= F.col("w") * F.col("level"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("top") / F.col("w"), F.col("level")))).over(Window.partitionBy(F.lit(1)))["level"]
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("top")).otherwise(F.col("w") * free).alias("target"))


@dataclass(frozen=True)
class Recipe:
    """What to mix: weights repeat over the sources; all targets share ``share`` of all words; none exceeds ``cap`` times its source."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    seed: int = 17
    block_rows: int = 1000
    least_blocks: int = 8
    shards: int = 16


#: Groups of sources whose quotas the driver splits.
STRATA = 1024
#: Hex digits of a block's hash that name a stretch of its source's permuted order.
STRETCH = 3


def split_quotas(copies: list[int] | np.ndarray, shards: int, seed: int | list[int], sizes: np.ndarray | None = None) -> np.ndarray:
    """Exact quotas (shard, source) of block copies from a splitting tree over the shards.

    A node holds a vector of source quotas and a range of shards; it gives its left half a multivariate hypergeometric
    sample whose size is what the left half's shards hold: ``sizes`` copies each, or by default equal shares.
    """
    out = np.zeros((shards, len(copies)), dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    todo = [(np.asarray(copies, dtype=np.int64), 0, shards)]
    while todo:
        have, lo, hi = todo.pop()
        if hi - lo == 1 or not have.sum():
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = int(have.sum()) * (mid - lo) // (hi - lo) if sizes is None else int(sizes[lo:mid].sum())
        left = rng.multivariate_hypergeometric(have, left, method="marginals")
        todo += [(have - left, mid, hi), (left, lo, mid)]
    return out


def _shard_ends(copies: DataFrame, r: Recipe) -> DataFrame:
    """copies (_s, c) -> (_s2, _ends): how many of a source's copies, in order, the shards up to each have."""
    spark = copies.sparkSession
    grouped = copies.withColumn("_g", F.pmod(F.xxhash64("_s"), F.lit(STRATA)).cast("int"))
    totals = sorted((x["_g"], int(x["c"])) for x in grouped.groupBy("_g").agg(F.sum("c").alias("c")).collect())  # at most STRATA rows
    top = split_quotas([c for _, c in totals], r.shards, r.seed)
    quotas = spark.createDataFrame([(g, [int(v) for v in top[:, i]]) for i, (g, _) in enumerate(totals)], "_g int, _q array<bigint>")

    def run(key, t):
        t = t.take(pa.array(sorted(range(t.num_rows), key=lambda i: str(t["_s"][i].as_py()))))
        ends = split_quotas(np.asarray(t["c"]), r.shards, [r.seed, key[0].as_py()], np.array(t["_q"][0].as_py())).cumsum(axis=0)
        return pa.table([t["_s"], pa.array(ends[:-1].T.tolist(), pa.list_(pa.int64()))], names=["_s2", "_ends"])

    return grouped.join(F.broadcast(quotas), "_g").groupBy("_g").applyInArrow(run, f"_s2 {type_of(copies, '_s')}, _ends array<bigint>")


def _hash(*parts: Column) -> Column:
    """60-bit hash of texts joined by bars, the same in any SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _with_goal(df: DataFrame, text: str, source: str, key: str, r: Recipe) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with size, source statistics and block: with their texts, and narrow (without); and the small table of sources."""
    rows = df.withColumn("_size", word_count(F.col(text))).withColumn("_r", _hash(F.lit(str(r.seed)), _text(key), F.md5(_text(text))))
    narrow = stored(rows.drop(text), "sizes")
    stats = narrow.groupBy(F.col(source).alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    stats = stored(stats, "sources")
    goal = targets(stats, list(r.weights), r.share, r.cap).withColumnRenamed("source", "_s")
    goal = goal.join(stats.select(F.col("source").alias("_s2"), "n"), F.col("_s").eqNullSafe(F.col("_s2")))
    blocks = F.greatest(F.lit(r.least_blocks), F.ceil(F.col("n") / r.block_rows)).cast("long")
    goal = stored(goal.select("_s", F.col("source_size").alias("_ssize"), F.col("target").alias("_target"), F.round("target").cast("long").alias("_words"), blocks.alias("_nb")), "goals")
    placed = lambda x: x.join(goal, F.col(source).eqNullSafe(F.col("_s"))).drop("_s").withColumn("_b", F.pmod("_r", "_nb"))
    return placed(rows), placed(narrow), goal


def _before(b: DataFrame, value: str) -> Column:
    """Sum of ``value`` over the blocks of a source that come earlier: those of earlier stretches, and those inside the stretch."""
    inside = Window.partitionBy("_s", "_st").orderBy("_perm", "_blk").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(f"_{value}_ahead")


def _with_stretches(b: DataFrame, value: str) -> DataFrame:
    """``b`` with the sum of ``value`` over the earlier stretches of the source (at most 16 ** STRETCH of them)."""
    ahead = Window.partitionBy("_s3").orderBy("_st3").rowsBetween(Window.unboundedPreceding, -1)
    per = b.groupBy(F.col("_s").alias("_s3"), F.col("_st").alias("_st3")).agg(F.sum(value).alias("v"))
    per = per.select("_s3", "_st3", F.coalesce(F.sum("v").over(ahead), F.lit(0)).alias(f"_{value}_ahead"))
    return b.join(per, F.col("_s").eqNullSafe(F.col("_s3")) & (F.col("_st") == F.col("_st3"))).drop("_s3", "_st3")


def _draw(narrow: DataFrame, source: str, r: Recipe) -> DataFrame:
    """Per block: whole rounds, the words of its last, partial round, and the shard of every copy drawn."""
    b = narrow.groupBy(F.col(source).alias("_s"), F.col("_b").alias("_blk")).agg(F.sum("_size").alias("_bsize"), F.first("_ssize").alias("_ssize"), F.first("_words").alias("_words"))
    b = b.withColumn("_perm", F.md5(F.concat_ws("|", F.lit(str(r.seed + 2)), F.col("_blk").cast("string")))).withColumn("_st", F.substring("_perm", 1, STRETCH))
    b = stored(b, "block_sizes")
    some = F.col("_ssize") > 0
    b = _with_stretches(b, "_bsize").withColumns(
        {
            "_passes": F.when(some, F.floor(F.col("_words") / F.when(some, F.col("_ssize")))).otherwise(0).cast("int"),
            "_rest": F.when(some, F.col("_words") % F.when(some, F.col("_ssize"))).otherwise(0),
            "_from": _before(b, "_bsize"),
        }
    )
    b = b.withColumn("_extra", F.least("_bsize", F.greatest(F.lit(0), F.col("_rest") - F.col("_from"))).cast("long"))
    b = b.withColumn("_copies", F.when(F.col("_bsize") > 0, F.col("_passes") + (F.col("_extra") > 0).cast("int")).otherwise(0))
    b = stored(b.select("_s", "_blk", "_bsize", "_passes", "_extra", "_copies", "_perm", "_st"), "copies")
    # copies of one block are neighbours in the permuted order of its source
    placed = _with_stretches(b, "_copies").withColumn("_at", _before(b, "_copies").cast("long"))
    bounds = stored(_shard_ends(b.groupBy("_s").agg(F.sum("_copies").cast("long").alias("c")), r), "shard_ends")
    placed = placed.join(bounds, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    shard = "transform(sequence(0, _copies - 1), i -> size(filter(_ends, e -> e <= _at + i)))"
    placed = placed.withColumn("_shards", F.expr(f"if(_copies > 0, {shard}, cast(array() as array<int>))"))
    return stored(placed.select("_s", "_blk", "_bsize", "_passes", "_extra", "_shards"), "draw")


OWN = ("size", "source_size", "target", "taken", "shards")


def assign(df: DataFrame, text: str, source: str, key: str, recipe: Recipe = Recipe()) -> DataFrame:
    """Every input row, without its text, with ``size``, ``source_size``, ``target``, ``taken`` (words) and ``shards`` (of the copies drawn)."""
    df, back = shield(_without_own(df, text, source, key), text, source, key)
    _, narrow, _ = _with_goal(df, text, source, key, recipe)
    return _placed(narrow, _draw(narrow, source, recipe), source, key, [c for c in df.columns if c != text]).withColumnsRenamed(back)


def _without_own(df: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return df.drop(*[c for c in OWN if c not in (text, source, key)])


def _placed(rows: DataFrame, drawn: DataFrame, source: str, key: str, names: list[str]) -> DataFrame:
    """Rows (``names``) with OWN, from the draw of their blocks."""
    rows = rows.join(drawn, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_blk")))
    cut_inside = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_bsize"))
    whole = rows.where(~cut_inside).withColumn("_part", F.when(F.col("_extra") > 0, F.col("_size")).otherwise(F.lit(0)))
    # at most one block of a source is cut; only its rows are ordered
    inside = Window.partitionBy(F.col(source), "_b").orderBy("_r", F.col(key).cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    part = rows.where(cut_inside).withColumn("_part", F.least("_size", F.greatest(F.lit(0), F.col("_extra") - F.coalesce(F.sum("_size").over(inside), F.lit(0)))))
    both = whole.unionByName(part)
    taken = (F.col("_passes") * F.col("_size") + F.col("_part")).cast("long")
    shards = F.when(F.col("_size") == 0, F.expr("cast(array() as array<int>)")).when(F.col("_part") > 0, F.col("_shards")).otherwise(F.slice("_shards", F.lit(1), F.col("_passes")))
    return both.select(*[F.col(c) for c in names], F.col("_size").alias("size"), F.col("_ssize").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), shards.alias("shards"))


def mix(df: DataFrame, text: str, source: str, key: str, recipe: Recipe = Recipe()) -> DataFrame:
    """The mix itself: one row for each copy drawn, in shuffled order within its shard; columns of ``df`` and ``shard``.

    The copy in which a source's quota ends carries its first words only, up to the quota (at most one row per source).
    """
    df, back = shield(df, text, source, key)
    names = [c for c in df.columns if c != "shard"]
    hidden = {c: f"_own_{c}" for c in OWN if c in df.columns and c not in (text, source, key)}
    df = df.withColumnsRenamed(hidden)
    rows, narrow, goal = _with_goal(df, text, source, key, recipe)
    words = goal.agg(F.coalesce(F.sum("_words"), F.lit(0)).alias("w")).first()["w"]
    a = _placed(rows, _draw(narrow, source, recipe), source, key, df.columns)
    # a shard is shuffled in pieces of about PIECE_WORDS words, so tasks stay alike at any size
    pieces = max(1, -(-words // (recipe.shards * PIECE_WORDS)))
    a = a.select("*", F.posexplode("shards").alias("_i", "_shard"))
    left = F.col("taken") - F.col("_i") * F.col("size")
    split = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    lead = F.array_join(F.slice(split, F.lit(1), left.cast("int")), "")
    a = a.withColumn(text, F.when(left < F.col("size"), lead).otherwise(F.col(text)))
    a = a.withColumn("_o", F.xxhash64(F.lit(recipe.seed + 3), F.col(key).cast("string"), "_i"))
    a = a.repartition("_shard", F.pmod("_o", F.lit(pieces))).sortWithinPartitions("_shard", "_o")
    return a.select(*[F.col(hidden.get(c, c)).alias(c) for c in names], F.col("_shard").alias("shard")).withColumnsRenamed(back)
