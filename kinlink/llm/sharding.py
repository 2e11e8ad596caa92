"""Extendible-hash sharding (native).

A directory is addressed by the leading bits of a row's hash.  A bucket that exceeds the byte limit is split on one
more bit, and only that bucket, until every bucket fits.  Only DataFrame functions run on the rows.

Defined results for odd inputs:
* null or empty payload: 0 bytes; the row still gets a shard.  An empty table gives an empty result.
* a null key is hashed like the text ``\\N``.
* rows with one and the same hash (repeated keys) cannot be told apart by bits.  Where such rows alone exceed the limit,
  their bucket gets overflow pages, filled in row order, each within the limit.
* one row larger than the limit stands alone on its page or bucket: ``shard_bytes`` then exceeds the limit, nothing is cut.
* extra columns pass through untouched; the operator's own columns win over input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import cut, shield, stored

#: Bits of a row's hash: fifteen hex digits of an MD5.
HASH_BITS = 60
#: Directory levels settled with one aggregation over the rows; deeper levels take further aggregations.
STEP_BITS = 12


def key_hash(key: Column) -> Column:
    """60-bit hash of a key, the same in any SQL engine that has MD5."""
    text = F.coalesce(key.cast("string"), F.lit("\\N"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _settle(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cells (prefix of ``high`` bits, bytes, n) -> (prefix, depth): the first level from ``low`` on whose bucket fits, else null.

    Every cell adds its bytes to its ancestor at each level (partial sums before the shuffle), so no level needs a
    window over the whole directory.
    """
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("node", F.expr(f"shiftright(prefix, {high} - d)"))
    sums = levels.groupBy("d", "node").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    fitting = sums.where((F.col("b") <= limit) | (F.col("r") <= 1)).select("d", "node", F.lit(True).alias("fits"))
    return levels.select("prefix", "d", "node").join(fitting, ["d", "node"], "left").groupBy("prefix").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("depth"))


def directory(rows: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """Directory of ``rows`` (h, size): per round its high level and a frame (prefix, depth), and the hashes left over.

    A round aggregates the rows of yet unsettled buckets by a prefix that is STEP_BITS longer; the first usually settles all.
    """
    rounds: list[tuple[int, DataFrame]] = []
    open_rows, low = rows, 0
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    while True:
        # a first step deep enough for the average bucket, so that a single pass over the rows serves large inputs
        ahead = max(0, (total // max(1, limit)).bit_length() + 3 - low)
        high = min(HASH_BITS, low + max(STEP_BITS if low else 4, ahead))
        cells = open_rows.groupBy(_prefix(F.col("h"), high).alias("prefix")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        settled = stored(_settle(stored(cells, "cells"), low, high, limit), "directory")
        rounds.append((high, settled.where("depth is not null").select("prefix", "depth")))
        unsettled = settled.where("depth is null").select("prefix")
        if unsettled.isEmpty():
            return rounds, None
        open_rows = open_rows.withColumn("_p", _prefix(F.col("h"), high)).join(unsettled.withColumnRenamed("prefix", "_p"), "_p", "left_semi").drop("_p")
        if high == HASH_BITS:
            return rounds, unsettled.withColumnRenamed("prefix", "h")
        low = high + 1


def shard(df: DataFrame, key: str, payload: str, limit_bytes: int) -> DataFrame:
    """Add ``shard_id`` (``depth:prefix`` and, for overflow pages, ``:page``), ``shard_depth`` and ``row_bytes`` to every row."""
    df, back = shield(df, key, payload)
    own = ["shard_id", "shard_depth", "row_bytes"]
    base = df.drop(*[c for c in own if c not in (key, payload)])
    names = base.columns
    rows = base.withColumns({"_h": key_hash(F.col(key)), "_size": F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")})
    rounds, left = directory(rows.select(F.col("_h").alias("h"), F.col("_size").alias("size")), limit_bytes)
    found = F.lit(None).cast("int")
    for k, (high, frame) in enumerate(rounds):
        side = frame.select(F.col("prefix").alias(f"_p{k}"), F.col("depth").alias(f"_d{k}"))
        rows = rows.withColumn(f"_p{k}", _prefix(F.col("_h"), high)).join(side, f"_p{k}", "left")
        found = F.coalesce(found, F.col(f"_d{k}"))
    rows = rows.withColumn("_depth", found)
    prefix = F.expr(f"shiftright(_h, cast({HASH_BITS} - _depth as int))")
    rows = rows.withColumn("_id", F.concat_ws(":", F.col("_depth").cast("string"), F.when(F.col("_depth") > 0, prefix).otherwise(F.lit(0)).cast("string")))
    if left is not None:
        rows = _overflow(rows, limit_bytes)
    return rows.select(*[F.col(c) for c in names if c not in own], F.col("_id").alias("shard_id"), F.coalesce("_depth", F.lit(HASH_BITS)).alias("shard_depth"), F.col("_size").alias("row_bytes")).withColumnsRenamed(back)


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for hashes that no bit can split: rows are numbered per scan partition, partitions are then offset by their predecessors.

    Only rows of such a hash are numbered, and each window covers one hash within one partition.
    """
    rest = rows.where("_depth is not null")
    stuck = cut(rows.where("_depth is null").withColumn("_pid", F.spark_partition_id()))  # partition numbers must not change between uses
    local = Window.partitionBy("_h", "_pid").orderBy("_size", F.xxhash64(*[F.col(c) for c in rows.columns if not c.startswith("_")]))
    pages = Window.partitionBy("_h").orderBy("_pid")
    # pages of one partition are its own: a partition's page count is known from its bytes and largest row
    packed = stuck.withColumn("_run", F.sum("_size").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_big", F.max("_size").over(Window.partitionBy("_h", "_pid")))
    room = F.greatest(F.lit(1).cast("long"), F.lit(limit) - F.col("_big"))
    packed = packed.withColumn("_page", F.floor((F.col("_run") - F.col("_size")) / room))
    last = packed.groupBy("_h", "_pid").agg((F.max("_page") + 1).alias("_n"))
    offs = last.withColumn("_off", F.coalesce(F.sum("_n").over(pages.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_h", "_pid", "_off")
    out = packed.join(offs, ["_h", "_pid"]).withColumn("_id", F.concat_ws(":", F.lit(str(HASH_BITS)), F.col("_h").cast("string"), (F.col("_page") + F.col("_off")).cast("string")))
    return rest.unionByName(out.select(*rest.columns))


def write_shards(df: DataFrame, key: str, payload: str, limit_bytes: int, path: str) -> None:
    """Write the rows as Parquet, one folder per shard."""
    shard(df, key, payload, limit_bytes).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
