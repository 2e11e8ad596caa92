"""Which keys do other parts of the corpus share?  One packed question and answer for all texts.

Texts are dealt by hash into slices of a few megabytes.  A slice sends each distinct key once, packed as bytes and cut by
key range into buckets; a bucket answers, for each slice, which of its keys another slice has too.  A key that a third of
all documents hold so crosses the shuffle once for each slice and never as rows of its own, and a task holds one bucket
or one slice.  Keys that occur twice inside a slice need no answer.

The number of buckets follows from the bytes of text, and slices grow with the input up to a bound, so both stay of bounded
size.  Rows that agree in id and text fall into one slice; of more than REPEATS such rows two go there, and results are given
back as often as the rows occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import bound_batches, stored

U = np.uint64
#: Bytes of text of a slice: least and most, between them the number of slices that grows no further.
SLICE_BYTES, MOST_SLICE_BYTES, SLICES = 4 << 20, 16 << 20, 4096
#: Bytes of text for each bucket: keys and what goes with them take up to four times as much.
BUCKET_BYTES = 16 << 20
#: Rows alike in id and text that go through as they are.
REPEATS = 100
ASKED = "slice long, bucket long, kind int, keys binary, data binary"
ANSWER = "slice long, bucket long, kind int, mask binary"
_ASKED = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])
_ANSWER = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("mask", pa.binary())])


@dataclass(frozen=True)
class Slices:
    """Texts dealt into slices: (slice, key, text, times), the number of buckets, and whether any row stands for several."""

    rows: DataFrame
    buckets: int
    folded: bool


def sliced(docs: DataFrame, key: str, text: str, slice_bytes: int | None = None) -> Slices:
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key, text).alias("_h"))
    same = stored(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("times"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")), "rows")
    total = same.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    size = slice_bytes or min(MOST_SLICE_BYTES, max(SLICE_BYTES, total // SLICES))
    n = max(1, -(-total // size))
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    hot = same.where(F.col("times") > REPEATS).select("_h", "times")
    folded = not hot.isEmpty()
    if folded:
        pair = F.explode(F.array(F.lit(1).cast("long"), F.col("times") - 1))
        twice = rows.join(hot, "_h").dropDuplicates(["key", "text"]).withColumn("times", pair)
        rows = rows.join(hot.select("_h"), "_h", "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(twice)
    else:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    return Slices(rows.select(F.pmod("_h", F.lit(n)).alias("slice"), "key", "text", "times"), buckets, folded)


def given_back(results: DataFrame, slices: Slices) -> DataFrame:
    """Results with ``times`` -> each as often as its row occurs."""
    if slices.folded:
        results = results.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return results.drop("times")


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys."""
    cuts = np.array([(b << 64) // buckets for b in range(buckets)], dtype=U)
    return np.append(np.searchsorted(keys, cuts), len(keys))


def ask(slice_id: int, kind: int, keys: np.ndarray, data: np.ndarray | None, buckets: int) -> pa.Table:
    """Rows with the sorted distinct ``keys`` of a slice, and ``data`` (a row for each key) beside them."""
    edge = bucket_edges(keys, buckets)
    at = np.flatnonzero(np.diff(edge))
    return pa.table(
        [
            pa.array([slice_id] * len(at), pa.int64()),
            pa.array(at, pa.int64()),
            pa.array([kind] * len(at), pa.int32()),
            pa.array([keys[edge[b] : edge[b + 1]].tobytes() for b in at], pa.binary()),
            pa.array([b"" if data is None else data[edge[b] : edge[b + 1]].tobytes() for b in at], pa.binary()),
        ],
        schema=_ASKED,
    )


#: Solver of a kind of question, and the bytes that it says of each key.
Solver = tuple[Callable[[np.ndarray, np.ndarray, bytes], np.ndarray], int]


def answers(asked: DataFrame, solvers: dict[int, Solver]) -> DataFrame:
    """Per bucket and kind: ``solve(keys, slice of each key, data)`` gives bytes for each key, zero where there is nothing to say."""

    def run(key, table):
        solve, width = solvers[key[1].as_py()]
        raw = [k.as_py() for k in table["keys"]]
        n = np.array([len(k) // 8 for k in raw])
        said = solve(np.frombuffer(b"".join(raw), dtype=U), np.repeat(np.arange(len(raw)), n), b"".join(k.as_py() for k in table["data"]))
        said = np.ascontiguousarray(said).view(np.uint8).reshape(-1, width)
        edge = np.append(0, np.cumsum(n))
        parts = [said[edge[i] : edge[i + 1]] for i in range(len(raw))]
        keep = [i for i, p in enumerate(parts) if p.any()]
        at = pa.array(keep, pa.int64())
        return pa.table([table["slice"].take(at), table["bucket"].take(at), table["kind"].take(at), pa.array([parts[i].tobytes() for i in keep], pa.binary())], schema=_ANSWER)

    return asked.groupBy("bucket", "kind").applyInArrow(textkit.frugal(run), ANSWER)


def shared(keys: np.ndarray, rows: np.ndarray, data: bytes, many: int | None = None) -> np.ndarray:
    """1 for keys that more than one slice sent, 2 for keys that more than ``many`` slices sent."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(new, len(k)))
    said = (n > 1).astype(np.uint8) + (n > (many or len(k))).astype(np.uint8)
    out = np.zeros(len(k), dtype=np.uint8)
    out[order] = np.repeat(said, n)
    return out


def heard(table: pa.Table, kind: int, keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """The answers of one kind to a slice, a row for each of its sorted keys."""
    out = np.zeros((len(keys), width), dtype=np.uint8)
    edge = bucket_edges(keys, buckets)
    for b, k, mask in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["mask"], strict=True):
        if k == kind:
            out[edge[b] : edge[b + 1]] = np.frombuffer(mask.as_py(), dtype=np.uint8).reshape(-1, width)
    return out


def with_slices(slices: Slices, fn: Callable[[int, pa.Table, pa.Table | None], Iterator[pa.Table] | pa.Table], schema: str, heard_: DataFrame | None = None) -> DataFrame:
    """``fn(slice, texts, answers)`` over every slice; a slice without texts gives nothing."""
    if heard_ is None:
        return slices.rows.groupBy("slice").applyInArrow(textkit.frugal(lambda key, t: fn(key[0].as_py(), t, None)), schema)

    def both(key, t, a):
        return fn(key[0].as_py(), t, a)

    return slices.rows.groupBy("slice").cogroup(heard_.groupBy("slice")).applyInArrow(textkit.frugal(both), schema)
