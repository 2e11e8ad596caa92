"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors are one class with a multiplicity, so copies cost one row.  Classes are hashed by the signs of random
projections; classes that share all signs of a table meet in a bucket.  The number of signs follows the number of classes
(buckets of about BUCKET rows for unlike vectors) and the number of tables follows from the wanted recall at the
threshold.  A bucket's rows are dealt into blocks of about BLOCK rows and pairs of blocks are compared; so a bucket of any size
spreads over many tasks of bounded memory.  A pair counts in the first table in which it meets.

A class goes to its buckets as a sketch of about SKETCH signs.  Only classes with a likely partner there - so many equal signs that
a pair at the threshold has fewer with probability LOST - are compared again, with their vectors, in double precision.  So vectors
move for likely pairs, not for every table.  A block pair returns link counts and a spanning forest, never its links.

Defined results for odd inputs: null vectors, zero vectors and vectors with null or non-finite components link with nothing;
so do vectors of different length.  Ids are of any type that has an order.  Repeated ids are rows of their own: each is returned, a component is named by its
smallest id.  Rows with a null id are returned and belong to a component by their vector.  An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .components import components
from .scratch import bound_batches, stored

BUCKET, BLOCK = 16, 2048
RECALL = 0.995
SKETCH, LOST = 192, 1e-6


def geometry(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Signs in a table and number of tables for n classes."""
    bits = min(48, max(4, math.ceil(math.log2(max(2, n) / BUCKET))))
    meet = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def likely(signs: int, cosine: float, lost: float = LOST) -> int:
    """Equal signs of ``signs`` that a pair at the threshold falls short of with a probability of at most ``lost``."""
    p, below, k = 1 - math.acos(min(1.0, cosine)) / math.pi, 0.0, 0
    while True:
        below += math.comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if below > lost or k == signs:
            return k
        k += 1


def _sign_type(bits: int):
    return np.dtype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)


def _hash(classes: DataFrame, bits: int, tables: int, seed: int, wide: bool) -> DataFrame:
    """(class, m, packed vector, signs as packed numbers, one for each table)."""
    kind, store = _sign_type(bits), np.float64 if wide else np.float32

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(2)
            n = np.diff(np.asarray(rows.offsets))
            edge = np.concatenate([[0], np.cumsum(n)])
            flat = np.asarray(rows.flatten(), dtype=np.float64)
            out, signs = [b""] * len(rows), [b""] * len(rows)
            for d in set(n.tolist()):
                at = np.flatnonzero(n == d)
                x = flat[edge[at][:, None] + np.arange(d)]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((bits * tables, d))
                on = ((x / np.abs(x).max(axis=1, keepdims=True)) @ planes[d].T >= 0).reshape(len(at), tables, bits)
                packed = (on.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(kind)
                for i, v, s in zip(at.tolist(), x.astype(store), packed, strict=True):
                    out[i], signs[i] = v.tobytes(), s.tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(signs, pa.binary())], names=["class", "m", "vec", "signs"])

    return classes.select("class", "m", "embedding").mapInArrow(run, "class long, m long, vec binary, signs binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _needy(tables: int, bits: int, agree: int):
    """Rows of a cell that have a likely partner which they meet in no earlier table of the sketch."""
    kind = _sign_type(bits)

    def run(key, t):
        table, one, two = key[0].as_py(), key[2].as_py(), key[3].as_py()
        t = t.take(np.argsort(np.asarray(t["bucket"]), kind="stable")).combine_chunks()
        ids, side, bucket = (np.asarray(t[c]) for c in ("class", "block", "bucket"))
        sketch = np.frombuffer(b"".join(x.as_py() for x in t["sketch"]), dtype=kind).reshape(-1, tables)
        need = np.zeros(len(ids), dtype=bool)
        edge = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            on = ((sketch[lo:hi, :, None] >> np.arange(bits, dtype=kind)) & kind.type(1)).reshape(hi - lo, -1).astype(np.float32) * 2 - 1
            left, right = (np.arange(hi - lo),) * 2 if one == two else (np.flatnonzero(side[lo:hi] == one), np.flatnonzero(side[lo:hi] == two))
            for at in range(0, len(left), 512):
                a, b = np.nonzero(on[left[at : at + 512]] @ on[right].T >= 2 * agree - on.shape[1])
                a, b = lo + left[at + a], lo + right[b]
                a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
                first = min(table, tables)
                if first:
                    new = ~(sketch[a, :first] == sketch[b, :first]).any(axis=1)
                    a, b = a[new], b[new]
                need[a] = need[b] = True
        return t.filter(pa.array(need)).drop_columns(["sketch"])

    return run


def _compare(cosine: float, tables: int, bits: int, wide: bool):
    """Buckets of one table, or two blocks of a large bucket: link counts of each class, and a spanning forest of the links."""
    kind, store = _sign_type(bits), np.float64 if wide else np.float32

    def run(key, t):
        table, one, two = key[0].as_py(), key[2].as_py(), key[3].as_py()
        t = t.take(np.argsort(np.asarray(t["bucket"]), kind="stable")).combine_chunks()
        ids, m, side, bucket = (np.asarray(t[c]) for c in ("class", "m", "block", "bucket"))
        raw = [x.as_py() for x in t["vec"]]
        length = np.array([len(x) for x in raw])
        signs = np.frombuffer(b"".join(x.as_py() for x in t["signs"]), dtype=kind).reshape(-1, tables)
        edge = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            for size in set(length[lo:hi].tolist()):
                rows = lo + np.flatnonzero(length[lo:hi] == size)
                if len(rows) < 2:
                    continue
                x = _unit(np.frombuffer(b"".join(raw[i] for i in rows), dtype=store).reshape(len(rows), -1).astype(np.float64))
                left, right = (rows, rows) if one == two else (rows[side[rows] == one], rows[side[rows] == two])
                xl, xr = (x, x) if one == two else (x[side[rows] == one], x[side[rows] == two])
                for at in range(0, len(left), 512):
                    a, b = np.nonzero(xl[at : at + 512] @ xr.T >= cosine)
                    a, b = left[at + a], right[b]
                    if one == two:
                        a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
                    if table:
                        new = ~(signs[a, :table] == signs[b, :table]).any(axis=1)
                        a, b = a[new], b[new]
                    found.append((a, b))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.bincount(a, weights=m[b], minlength=len(ids)) + np.bincount(b, weights=m[a], minlength=len(ids))
        root = np.arange(len(ids))
        while len(a):  # the smallest root spreads along links, then ways to it are shortened
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(links > 0)
        return pa.table([pa.array(ids[at], pa.int64()), pa.array(links[at].astype(np.int64), pa.int64()), pa.array(ids[root[at]], pa.int64())], names=["class", "links", "root"])

    return run


def link(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    bound_batches(vectors.sparkSession)
    kind = vectors.schema[vector].dataType
    wide = not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    good = F.coalesce(F.col("embedding").isNotNull() & ~bad & ~zero, F.lit(False))
    # a class is a vector: 96 bits of hash stand for it (0.0 and -0.0 are one value)
    flat = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = rows.withColumns({"_x": F.when(good, F.xxhash64(flat)), "_y": F.when(good, F.hash(flat, F.lit(7)))})
    grouped = rows.where("_x is not null").groupBy("_x", "_y").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"))
    classes = stored(grouped.withColumn("class", F.col("_x")), "classes")
    n = classes.count()
    bits, tables = geometry(n, cosine, recall)
    width = _sign_type(bits).itemsize
    hashed = stored(_hash(classes, bits, tables, seed, wide), "signs")
    keys = hashed.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("bucket", F.xxhash64(F.expr(f"substring(signs, table * {width} + 1, {width})")))
    large = keys.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = stored(large.select("table", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    met = keys.join(large, ["table", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class", "table"), "blocks").cast("int"))
    # small buckets travel some at a time; a block of a large one meets itself and every other block once
    met = met.withColumn("cell", F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(-(-n // BLOCK) or 1))))
    met = met.withColumn("p", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(block, o) as one, greatest(block, o) as two))")))
    seen = min(tables, -(-SKETCH // bits))
    met = met.select("table", "cell", "p.one", "p.two", "bucket", "class", "block", F.expr(f"substring(signs, 1, {seen * width})").alias("sketch"))
    cell = ["table", "cell", "one", "two"]
    need = met.groupBy(*cell).applyInArrow(textkit.frugal(_needy(seen, bits, likely(seen * bits, cosine))), met.drop("sketch").schema)
    need = stored(need, "likely").join(hashed, "class").select(*cell, "bucket", "class", "m", "vec", "signs", "block")
    out = need.groupBy(*cell).applyInArrow(textkit.frugal(_compare(cosine, tables, bits, wide)), "class long, links long, root long")
    out = stored(out, "links")
    degree = out.groupBy("class").agg(F.sum("links").alias("links"))
    comp = components(out.select(F.col("class").alias("a"), F.col("root").alias("b")))
    info = classes.select("_x", "_y", "class", "first", "m").join(degree, "class", "left").join(comp.withColumnRenamed("node", "class"), "class", "left")
    info = info.withColumn("root", F.coalesce("root", "class"))
    names = info.groupBy("root").agg(F.min("first").alias("component_id"))
    info = info.join(names, "root").select("_x", "_y", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.join(info, ["_x", "_y"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
