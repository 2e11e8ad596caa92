"""Exact best k by weighted keys: slices of queries against slices of targets, each an inverted index in memory.

A pair's score is the sum over common keys of the query's weight times the target's.  In a slice of n targets a key of more than
n / WIDE of them is wide.  Queries alike in their wide keys share one dense sum over the slice and its best k; their other keys
then move single targets.  These only add, so a target that only wide keys find cannot be among a query's best k unless it is
among those best k, and nothing else is left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from kinlink.sources.shared import cut

#: Rows of a slice at most, about (bounds of memory, not of results), and queries of a slice if they are few.
TARGETS, QUERIES, FEW = 200_000, 50_000, 2_000
WIDE = 100

#: Queries whose narrow keys are looked up together: a key has at most n / WIDE targets, a query some 30 keys.
TOGETHER = 20


def packed(rows: DataFrame, key: str, *also: str) -> DataFrame:
    """(key, x): one row for each id of (key, h, weight), with its keys, and columns that are the same in all rows of an id."""
    return rows.groupBy(key).agg(F.collect_list(F.struct("h", F.col("weight").cast("double").alias("weight"))).alias("x"), *[F.first(c).alias(c) for c in also])


def _bundles(batches):
    """Rows (part, columns, x) as one of all that are in a part of a batch: Spark would copy each key of each row to each slice."""
    for batch in batches:
        part = np.asarray(batch.column("part"))
        rows = pa.table({c: batch.column(c) for c in batch.schema.names if c != "part"})
        weight = np.asarray(rows.column("x").combine_chunks().flatten().field("weight"))
        if (weight == 1).all():
            x = rows.column("x").combine_chunks()
            ends = np.append(0, np.cumsum(np.asarray(x.value_lengths(), dtype=np.int32)))
            rows = rows.set_column(rows.column_names.index("x"), "x", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.flatten().field("h")))
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        packs = []
        for some in np.split(order, first[1:]) if len(order) else []:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as to:
                to.write_table(rows.take(pa.array(some)))
            packs.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(part[order][first], pa.int32()), pa.array(packs, pa.binary())], names=["part", "rows"])


def _opened(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Of bundles: the columns of every id in the order of ids, how many keys it has, all keys, all weights."""
    rows = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")]
    lists = [c for x in rows for c in x.column("x").chunks]
    alone = [pa.types.is_struct(x.type.value_type) for x in lists]
    per = np.concatenate([np.asarray(x.value_lengths(), dtype=np.int64) for x in lists])
    h = np.concatenate([np.asarray(x.flatten().field("h") if s else x.flatten()) for x, s in zip(lists, alone, strict=True)])
    w = np.concatenate([np.asarray(x.flatten().field("weight")) if s else np.ones(len(x.flatten())) for x, s in zip(lists, alone, strict=True)])
    rows = pa.concat_tables([x.drop_columns(["x"]) for x in rows])
    order = np.asarray(pc.sort_indices(rows.column(key)))
    some = _ranges((np.cumsum(per) - per)[order], per[order])
    rows, per, h, w = rows.take(pa.array(order)), per[order], h[some], w[some]
    ids = rows.column(key).combine_chunks()
    new = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
    return rows.take(pa.array(new)), np.add.reduceat(per, new), h, w


def _lead(base: np.ndarray, k: int, place) -> np.ndarray:
    """The best k of the positive sums by place, the first of equals."""
    found = np.flatnonzero(base > 0)
    if len(found) <= k:
        return found
    x = base[found]
    kth = np.partition(x, len(x) - k)[len(x) - k]
    # sums of the same place lie closer than this
    found = found[x >= kth - 1e-6 * max(1.0, kth)]
    x, kth = place(base[found]), place(np.array([kth]))[0]
    above = found[x > kth]
    return np.concatenate([above, found[x == kth][: k - len(above)]])


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... (n numbers) of each, one after another."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _moves(members: np.ndarray, first: np.ndarray, middle: np.ndarray, i: np.ndarray, w: np.ndarray, start: np.ndarray, at: np.ndarray, tw: np.ndarray):
    """Some queries at a time, targets that their narrow keys move, by how much, and how many each query moves."""
    for lo in range(0, len(members), TOGETHER):
        part = members[lo : lo + TOGETHER]
        per = first[part + 1] - middle[part]
        x = _ranges(middle[part], per)
        n = start[i[x] + 1] - start[i[x]]
        some = _ranges(start[i[x]], n)
        yield part, at[some], np.repeat(w[x], n) * tw[some], np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per))])


def search(queries: tuple, targets: tuple, k: int, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of targets (in the order of their ids) and scores of each query's best k."""
    nq, per_q, qh, qw = queries
    n, at, th, tw = targets
    order = np.argsort(th, kind="stable")  # a key's targets stay in their order
    th, at, tw = th[order], at[order], tw[order]
    new = np.ones(len(th), dtype=bool)
    new[1:] = (th[1:] != th[:-1]) | (at[1:] != at[:-1])
    if not new.all():
        tw, th, at = np.add.reduceat(tw, np.flatnonzero(new)), th[new], at[new]
    start = np.flatnonzero(np.append(True, th[1:] != th[:-1]))
    heads, least = th[start], np.minimum.reduceat(tw, start)
    start = np.append(start, len(th))
    size = np.diff(start)
    i = np.minimum(np.searchsorted(heads, qh), len(heads) - 1)
    met = heads[i] == qh
    owner, i, w = np.repeat(np.arange(nq), per_q)[met], i[met], qw[met]
    wide = (size[i] > n / WIDE) | (least[i] < 0) | (w < 0)
    order = np.lexsort((w, i, ~wide, owner))
    owner, i, w, wide = owner[order], i[order], w[order], wide[order]
    first = np.searchsorted(owner, np.arange(nq + 1))
    middle = first[:-1] + np.bincount(owner, weights=wide, minlength=nq).astype(np.int64)
    alike = defaultdict(list)
    for q in np.flatnonzero(np.diff(first)):
        part = slice(first[q], middle[q])
        alike[i[part].tobytes(), w[part].tobytes()].append(q)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # what narrow keys add, a stretch of n targets for each query of those looked up together; zero but for those
    work = np.zeros(n * min(TOGETHER, max(map(len, alike.values()), default=0)))
    for members in alike.values():
        base, q = np.zeros(n), members[0]
        for x in range(first[q], middle[q]):
            some = slice(start[i[x]], start[i[x] + 1])
            base[at[some]] += w[x] * tw[some]
        lead = _lead(base, k, place)
        low = place(base[lead]).min() if len(lead) == k else -np.inf
        for part, moved, added, per in _moves(np.array(members), first, middle, i, w, start, at, tw):
            cell = np.repeat(np.arange(len(part)) * n, per) + moved
            np.add.at(work, cell, added)
            score = work[cell] + base[moved]
            hit = np.concatenate([cell[place(score) >= low], (np.arange(len(part))[:, None] * n + lead).ravel()])
            hit.sort()
            hit = hit[np.append(True, hit[1:] != hit[:-1])] if len(hit) else hit
            of, t = np.divmod(hit, n)
            score = work[hit] + base[t]
            work[cell] = 0
            good = score > 0
            of, t, score = of[good], t[good], score[good]
            order = np.lexsort((-place(score), of))  # stable: equals stay in the order of targets
            of, t, score = of[order], t[order], score[order]
            good = np.arange(len(of)) - np.searchsorted(of, of) < k
            out.append((part[of[good]], t[good], score[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _place(digits: int | None):
    """What scores are ordered by: rounded to so many digits, or in single precision."""
    return (lambda x: x.astype(np.float32)) if digits is None else (lambda x: np.round(x, digits))


def _met(k: int, digits: int | None, schema: pa.Schema):
    place = _place(digits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        left, per_q, qh, qw = _opened(left, "q")
        right, per_t, th, tw = _opened(right, "t")
        if not (len(qh) and len(th)):
            return schema.empty_table()
        n = right.num_rows
        x, y, score = search((left.num_rows, per_q, qh, qw), (n, np.repeat(np.arange(n), per_t), th, tw), k, place)
        # a query's targets are together, the best first
        new = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else x
        rank = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        found = {c: rows.column(c).take(pa.array(i)) for rows, i in ((left, x), (right, y)) for c in rows.column_names}
        return pa.table({**found, "score": pa.array(score), "place": pa.array(place(score).astype(np.float64)), "rank": pa.array((rank + 1).astype(np.int32))})

    return run


def _spark_hash(x: int) -> int:
    """Spark's ``hash`` of an integer (Murmur3, seed 42), unsigned."""
    turned = lambda v, r: (v << r | v >> 32 - r) & 0xFFFFFFFF
    h = 42 ^ turned(x * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turned(h, 13) * 5 + 0xE6546B64 ^ 4) & 0xFFFFFFFF
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def names(n: int) -> list[int]:
    """n numbers that Spark deals to n different partitions of n: hashed as they come, some tasks would get several slices."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        h = _spark_hash(x)
        found.setdefault((h - (h >> 31 << 32)) % n, x)
        x += 1
    return list(found.values())


def best(asked: DataFrame, pool: DataFrame, k: int, digits: int | None = None, rows: tuple[int, int] | None = None, alike: str | None = None) -> DataFrame:
    """(q, t, score, rank) of (q, h, weight) and (t, h, weight): the k targets of the highest positive sums, ties by t.

    Sums are ordered by their single-precision form, or as rounded to ``digits`` places.  ``rows``: about how many queries and
    targets there are; without it they are counted.  ``alike``: a column of queries, equal in those that share many keys.
    """
    return best_of_packed(packed(asked, "q", *([alike] if alike else [])), packed(pool, "t"), k, digits, rows, alike)


def _together(a: DataFrame, alike: str, sets: int) -> DataFrame:
    """``a`` with ``part``: queries equal in ``alike`` in one slice, or in as many as they fill."""
    many = a.groupBy(alike).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERIES).select(alike, F.ceil(F.col("n") / QUERIES).alias("_s"))
    dealt = F.xxhash64(alike, F.pmod(F.xxhash64("q"), F.coalesce("_s", F.lit(1))))
    return a.join(F.broadcast(many), alike, "left").withColumn("part", F.pmod(dealt, F.lit(sets)).cast("int")).drop(alike, "_s")


def best_of_packed(a: DataFrame, b: DataFrame, k: int, digits: int | None = None, rows: tuple[int, int] | None = None, alike: str | None = None) -> DataFrame:
    """``best`` of packed rows, (q, x) and (t, x).  An id may have several; other columns, the same in all rows of an id, are kept."""
    if rows is None:
        a, b = cut(a), cut(b)
        rows = a.count(), b.count()
    n, many = rows[0], max(1, -(-rows[1] // TARGETS))
    # a query slice for each core, if it is worth it: a slice of targets is sent to each and sorted there
    sets = max(1, -(-n // QUERIES), min(n // FEW, -(-a.sparkSession.sparkContext.defaultParallelism // many)))
    number = lambda name, m: F.pmod(F.xxhash64(name), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    each = sets * many
    to = F.get(F.array(*map(F.lit, names(each))), F.col("i") * many + F.col("j")).alias("to")
    bundled = lambda rows: rows.mapInArrow(_bundles, "part int, rows binary")
    dealt = a.withColumn("part", number("q", sets)) if alike is None else _together(a, alike, sets)
    a = a.drop(alike) if alike else a
    one = bundled(dealt).select(F.col("part").alias("i"), every(many).alias("j"), "rows").select(to, "rows").repartition(each, "to")
    two = bundled(b.withColumn("part", number("t", many))).select(every(sets).alias("i"), F.col("part").alias("j"), "rows").select(to, "rows").repartition(each, "to")
    kept = [f for f in (*a.schema, *b.schema) if f.name != "x"]
    schema = StructType([*kept, StructField("score", DoubleType()), StructField("place", DoubleType()), StructField("rank", IntegerType())])
    found = one.groupBy("to").cogroup(two.groupBy("to")).applyInArrow(_met(k, digits, to_arrow_schema(schema)), schema)
    if many > 1:
        order = Window.partitionBy("q").orderBy(F.col("place").desc(), "t")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(*[f.name for f in kept], "score", "rank")
