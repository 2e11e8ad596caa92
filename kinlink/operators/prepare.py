"""Normalized records: the columns that blocking and features use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text as X
from kinlink.functions import vocabulary as V
from kinlink.sources.shared import cut

#: Longest normalized name and address kept, in characters, unless texts are taken whole.
NAME_CHARS, ADDR_CHARS = 88, 160

#: Records of a part, about, unless the parts are fewer than twice the cores or more than the shuffle partitions.
PART_ROWS = 10_000


def prepare(entities: DataFrame, strict_phrases: bool = False, whole: bool = False) -> DataFrame:
    """entity_id, source, name_norm, addr_norm, country for every record; missing text is empty.  ``whole``: texts of any length."""
    name, addr = X.normalize_name(F.col("business_name"), strict_phrases), X.normalize_addr(F.col("business_address"))
    if not whole:
        name, addr = F.substring(name, 1, NAME_CHARS), F.substring(addr, 1, ADDR_CHARS)
    return entities.select("entity_id", "source", name.alias("name_norm"), addr.alias("addr_norm"), F.trim(F.coalesce("country", F.lit(""))).alias("country"))


def pool_order(key: str) -> list[Column]:
    """The target pool's order of an id: source prefix, then number, then the id itself."""
    return [F.substring(key, 1, 2), F.coalesce(F.regexp_extract(key, r"(\d+)$", 1).try_cast("bigint"), F.lit(-1)), F.col(key)]


def spread(records: DataFrame) -> DataFrame:
    """The same records with ``row``, a number in the pool's order (source prefix, number in the id, id), kept in the shared folder.

    Blocking uses the records several times (tokens and keys, queries and targets), each time filtered and pruned in
    another way, so Spark would normalize them anew each time.  Joins and ties then go by ``row`` instead of the id's text.
    """
    spark = records.sparkSession
    # kept before it is dealt, which reads it twice (ranges are sampled), and after: dealt anew, ranges and so numbers could differ
    keyed = cut(records.withColumns({f"_{i}": c for i, c in enumerate(pool_order("entity_id"))}))
    order = [c for c in keyed.columns if c.startswith("_")]
    # as many parts as the rows are worth: small ones cost more to start than to read
    n = max(2 * spark.sparkContext.defaultParallelism, -(-keyed.count() // PART_ROWS))
    n = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(dealt.drop(*order).withColumn("row", F.monotonically_increasing_id()))


def targets(records: DataFrame) -> DataFrame:
    """The target pool."""
    return records.where("source <> 'S1'")


def queries(records: DataFrame) -> DataFrame:
    return records.where("source = 'S1'")


def tokens(records: DataFrame, most: int | None = V.MAX_TOKENS) -> DataFrame:
    """(entity_id, source, ns, pos, token, and row if there is one): name and address tokens, at most ``most`` of each (None: all), in order."""
    own = [c for c in ("entity_id", "source", "row") if c in records.columns]
    base = records.select(*own, X.first_tokens(X.name_tokens(F.col("name_norm")), most).alias("name"), X.first_tokens(X.addr_tokens(F.col("addr_norm")), most).alias("addr"))
    both = F.array(F.struct(F.lit("name").alias("ns"), F.col("name").alias("t")), F.struct(F.lit("addr").alias("ns"), F.col("addr").alias("t")))
    # outer explodes: before inner ones Spark would build the lists once more to test them for emptiness
    each = base.select(*own, F.explode_outer(both).alias("f")).select(*own, "f.ns", F.posexplode_outer("f.t").alias("pos", "token"))
    return each.where("token is not null")
