"""Labelled documents: held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import type_of

FOLDS = 5
#: Documents and bytes of text of a training sample: bounds of what the driver holds.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 6 << 20


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def held_out(key: Column) -> Column:
    """Whether a document's labels are never learned from (a null id: held out)."""
    return F.coalesce(fold(key) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", max_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], float]:
    """Whole texts and labels of at most ``max_docs`` documents and ``max_bytes`` bytes, in hash order of their ids.

    Half of the documents and bytes are of each class where there are enough; what a class leaves goes to the other.  A document
    that does not fit is passed over; if no document of a class fits, there is no sample but an error.  Of several rows of one
    id the one with the shortest text is learned from, so that no repeated id makes the sample larger than its bounds.  The third
    value is the share of label 1 among all rows that may be learned from.  Rows of the held-out fold and null labels are left out.
    """
    known = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    prior = known.agg(F.coalesce(F.avg("_y"), F.lit(0.5)).alias("p")).first()["p"]
    order = F.xxhash64(F.lit(29), F.col(key))
    ids = [known.where(F.col("_y") == y).orderBy(order).limit(max_docs // 2).collect() for y in (0, 1)]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r[key], r["_y"]) for part in ids for r in part], f"`{key}` {type_of(labels, key)}, _y int")
    # at most max_docs ids are broadcast
    rows = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(chosen), key)
    rows = rows.select(order.alias("_o"), F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n"), F.coalesce(F.xxhash64("_t"), F.lit(0)).alias("_h"), "_y", "_t")
    one = rows.groupBy("_o").agg(F.min(F.struct("_n", "_h")).alias("f"), F.first("_y").alias("_y"))
    sizes = sorted((r["_o"], r["f"]["_n"], r["_y"], r["f"]["_h"]) for r in one.collect())
    taken = fitting([x[:3] for x in sizes], max_bytes)
    short = {x[2] for x in sizes} - {y for _, _, y in taken}
    if short:
        raise ValueError(f"no document of {label} {sorted(short)} fits into the {max_bytes} bytes of a sample")
    if not taken:
        return [], [], prior
    fits = {o for o, _, _ in taken}
    fit = spark.createDataFrame([(o, n, h) for o, n, _, h in sizes if o in fits], "_o long, _n int, _h long")
    got = rows.join(F.broadcast(fit), ["_o", "_n", "_h"]).groupBy("_o").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y")).orderBy("_o").collect()
    return [r["_t"] or "" for r in got], [r["_y"] for r in got], prior


def fitting(sizes: list[tuple[int, int, int]], max_bytes: int) -> list[tuple[int, int, int]]:
    """Of (order, bytes, class) those that fit, in order: first into half of the bytes for each class, then into what is left."""
    left, taken, over = {0: max_bytes // 2, 1: max_bytes // 2}, [], []
    for x in sizes:
        if x[1] <= left[x[2]]:
            left[x[2]] -= x[1]
            taken.append(x)
        else:
            over.append(x)
    rest = max_bytes - sum(n for _, n, _ in taken)
    for x in over:
        if x[1] <= rest:
            rest -= x[1]
            taken.append(x)
    return sorted(taken)
