"""Dense retrieval: cosine of embedding columns, and scoring of pairs by a model.

Targets are packed into blocks of bounded size; every block of queries meets every block of targets in one matrix product,
and only the best k of each query and block leave a task.  A query set is stated by the caller; each task holds one
block of either side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexical import ranked

BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, side: str, n: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return ok.select(F.col(key).cast("string").alias("id"), v.alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(side))


def top_cosine(queries: DataFrame, targets: DataFrame, key: str, vector: str, k: int = 15, block: int = BLOCK, others: bool = False) -> DataFrame:
    """(s1_id, target_id, score, rank): the k targets of the largest cosine with each query; ties by id.

    Vectors with null or NaN components are left out; a zero vector has cosine 0 with everything.  With ``others`` a query
    never gets its own id: for one table on both sides.
    """
    nq, nt = (max(1, -(-df.count() // block)) for df in (queries, targets))
    q = _blocks(queries, key, vector, "qb", nq).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    t = _blocks(targets, key, vector, "tb", nt).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def unit(rows: pa.ChunkedArray) -> np.ndarray:
        x = np.array(rows.to_pylist(), dtype=np.float64)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def best(left, right):
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=["s1_id", "target_id", "score"])
        a, b = unit(left["v"]), unit(right["v"])
        ids = np.array(right["id"].to_pylist(), dtype=object)
        by_id = np.argsort(ids, kind="stable")
        names = ids[by_id]
        score = np.round(a @ b[by_id].T, 9)
        if others:
            own = left["id"].to_pylist()
            first, end = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
            for i in np.flatnonzero(first < end):
                score[i, first[i] : end[i]] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at, to = np.repeat(np.arange(len(a)), top.shape[1]), top.ravel()
        if others:
            ok = score[at, to] > -np.inf
            at, to = at[ok], to[ok]
        return pa.table([left["id"].take(pa.array(at)), pa.array(names[to].tolist(), pa.string()), pa.array(score[at, to])], names=["s1_id", "target_id", "score"])

    near = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInArrow(best, "s1_id string, target_id string, score double")
    return ranked(near, k)


def pair_text(name, addr, country):
    return F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in (name, addr, country)])


def cross_encode(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """Pairs (text_a, text_b and any others) with ``prob`` from a model that ``load`` brings up once for each task.

    The model maps two lists of texts to logits of shape (n, 2); ``prob`` is the softmax of class 1.
    """
    schema = T.StructType([*pairs.schema.fields, T.StructField("prob", T.DoubleType())])
    a, b = pairs.columns.index("text_a"), pairs.columns.index("text_b")

    def run(batches):
        model = load()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                logits = np.asarray(model(part.column(a).to_pylist(), part.column(b).to_pylist()), dtype=np.float64)
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                yield pa.record_batch([*part.columns, pa.array(e[:, 1] / e.sum(axis=1))], names=schema.names)

    return pairs.mapInArrow(run, schema)
