"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed words are summed over all documents (a table of fixed size, as hashing TF-IDF has it).
   A shingle of SHINGLE words weighs its count in the text times the mean inverse document frequency of its words.  (A
   shingle's own document frequency would make what many copies share weigh less than the edits in which they differ.)
2. Every text gets SAMPLES consistent weighted samples: two texts agree in one with the probability of their weighted
   Jaccard similarity.  Texts with equal words are one class with one signature.
3. Bands of ROWS samples put classes into buckets.  Every class is compared with the most central class of its buckets (the
   one with most company in all its buckets: an original rather than one of its copies).  So candidate pairs grow with the
   classes.  The classes of one centre are dealt into cells of bounded rows and bytes, and each cell gets the centre's
   signature and text once, so that no centre gathers its classes in one task.  Signatures first; what passes is verified by
   exact weighted Jaccard similarity and gives components.
4. What is left are pairs of a bucket in different components.  Every class outside the component of the bucket's centre
   is compared with all classes of the bucket, in blocks: first by signature; classes with a likely partner then with
   their texts, exactly, inside the block.  Only links leave a block, one for each class and component; so no link between
   unlike members of a bucket is lost, no pairs are written, and a bucket that forms one component costs nothing more.

Words: A-Z lower-cased; runs of ASCII letters, digits and non-ASCII characters.

Defined results for odd inputs: null and empty texts, and texts without words, are near nothing: each is its own class.
Texts of fewer words than a shingle have all their words as one shingle.  Repeated rows are copies.  Ids are of any type that
has an order; a null id belongs to its text's class and never names it unless all ids are null (the name is then null).  An
empty table gives an empty result.  Only the id and text columns are read; ``keep_one`` passes all columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .scratch import bound_batches, shield, stored, type_of

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
#: Samples, samples in a band, and agreeing samples that a pair needs before it is verified in full: at the threshold
#: this test loses no more pairs than the bands.
SAMPLES, ROWS, AGREE = 64, 4, 39
SLOT_BITS = 18
#: Sums of weights in another order differ by less.
EQUAL = 1e-12
#: Bytes of text whose shingles are in memory at once, and rows of a block of a large bucket.
PIECE_BYTES = 512 << 10
BLOCK = 512
#: Bytes of text in a cell or block, on average (a longer text stands with few others).
BLOCK_BYTES = 4 << 20
#: Parts of the table of document frequencies, and partial sums of each part.
SEGMENTS, SALTS = 256, 1024
SIGNED = "raw long, h1 long, h2 long, bytes long, sig binary"


def _words(buf: np.ndarray, offs: np.ndarray) -> textkit.Words:
    return textkit.Words(buf, offs, textkit.ALNUM, lower=True)


def _slots(w: textkit.Words) -> np.ndarray:
    return (w.hash >> U(64 - SLOT_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the slot's words)) + 1 for each of 2**SLOT_BITS slots."""
    size = 1 << SLOT_BITS

    def count(batches):
        total, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for lo, hi, buf, offs in textkit.pieces(batch.column(0), PIECE_BYTES):
                w = _words(buf, offs)
                pairs = np.unique(w.doc << SLOT_BITS | _slots(w))
                total += np.bincount(pairs & (size - 1), minlength=size)
                n += hi - lo
        salt = TaskContext.get().partitionId() % SALTS
        parts = [x.tobytes() for x in total.reshape(SEGMENTS, -1)] + [np.array([n]).tobytes()]
        yield pa.record_batch([pa.array(range(SEGMENTS + 1), pa.int64()), pa.array([salt] * (SEGMENTS + 1), pa.int64()), pa.array(parts, pa.binary())], names=["segment", "salt", "counts"])

    def add(t):
        total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in t["counts"])
        return pa.table([t["segment"][:1], t["salt"][:1], pa.array([total.tobytes()], pa.binary())], names=["segment", "salt", "counts"])

    # a task sends its table as SEGMENTS packed parts, which are added in two steps
    schema = "segment long, salt long, counts binary"
    parts = docs.select(text).mapInArrow(textkit.frugal(count), schema).groupBy("segment", "salt").applyInArrow(add, schema).groupBy("segment").applyInArrow(add, schema)
    got = {r["segment"]: np.frombuffer(r["counts"], dtype=np.int64) for r in parts.collect()}
    n = int(got[SEGMENTS][0]) if got else 0
    df = np.concatenate([got[k] for k in range(SEGMENTS)]) if got else np.zeros(size)
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


class Shingles:
    """Distinct shingles of a batch of texts, sorted by text: hash, weight, and where each text's begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, idf: np.ndarray):
        w = self.words = _words(buf, offs)
        at = np.flatnonzero(w.fits(SHINGLE))
        short = np.flatnonzero((w.n > 0) & (w.n < SHINGLE))
        size = np.concatenate([np.full(len(at), SHINGLE), w.n[short]])
        at = np.concatenate([at, w.first[:-1][short]])
        order = np.argsort(at, kind="stable")
        at, size = at[order], size[order]
        sums = np.concatenate([[0.0], np.cumsum(idf[_slots(w)], dtype=np.float64)])
        # rounded, so that equal shingles weigh the same wherever they stand in a batch
        mean = np.round((sums[at + size] - sums[at]) / np.maximum(1, size), 4)
        h = textkit.mix(textkit.span_hash(w.hash, at, at + size, textkit.WORD_BASE) + U(SHINGLE))
        doc = np.searchsorted(w.first, at, side="right") - 1
        order = np.lexsort((h, doc))
        h, doc, mean = h[order], doc[order], mean[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
        self.hash, self.doc = h[new], doc[new]
        self.weight = np.diff(np.append(new, len(h))) * mean[new]
        self.first = np.searchsorted(self.doc, np.arange(len(w.n) + 1))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """-ln of 16-bit uniforms, and the quantiles of Gamma(2, 1) at them (Newton steps on 1 - (1 + x) exp(-x))."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(u), 2.0)
    for _ in range(60):
        x = np.maximum(1e-9, x - np.clip((1 - (1 + x) * np.exp(-x) - u) / np.maximum(1e-12, x * np.exp(-x)), -1, 1))
    return -np.log(u).astype(np.float32), x.astype(np.float32)


def sample(s: Shingles, samples: int = SAMPLES, chunk: int = 1 << 15) -> np.ndarray:
    """Improved consistent weighted samples (text, sample) as 32-bit codes; texts without shingles get zeros.

    Per shingle and sample: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln w / r + b); ln y = r (t - b); the shingle with
    the least ln c - ln y - r is drawn, and the pair (shingle, t) is the sample.
    """
    out = np.zeros((len(s.first) - 1, samples), dtype=np.uint32)
    log_u, gamma = _tables()
    some = np.flatnonzero(np.diff(s.first))
    k = 0
    while k < len(some):
        lo = s.first[some[k]]
        last = max(k + 1, int(np.searchsorted(s.first[some + 1], lo + chunk, side="right")))
        rows = some[k:last]
        hi = s.first[rows[-1] + 1]
        h, lw = s.hash[lo:hi], np.log(s.weight[lo:hi]).astype(np.float32)
        at = s.first[rows] - lo
        n = np.diff(np.append(at, hi - lo))
        for j in range(samples):
            z = textkit.mix(h + U((j + 1) * textkit.MIX_A & 0xFFFFFFFFFFFFFFFF))
            parts = z.view(np.uint16).reshape(-1, 4)
            r = gamma[parts[:, 0]]
            b = parts[:, 1].astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(lw / r + b)
            a = np.log(log_u[parts[:, 2]] + log_u[parts[:, 3]]) - r * (t - b) - r
            low = np.minimum.reduceat(a, at)
            drawn = np.flatnonzero(a == np.repeat(low, n))
            drawn = drawn[np.searchsorted(drawn, at)]
            out[rows, j] = (textkit.mix(h[drawn] + t[drawn].astype(np.int64).astype(U) * U(textkit.WORD_BASE)) >> U(32)).astype(np.uint32)
        k = last
    return out


def signatures(docs: DataFrame, key: str, text: str, idf: np.ndarray) -> DataFrame:
    """doc_id, hash of the raw text, 128-bit hash of its words, bytes of text, and its signature (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in textkit.pieces(batch.column(1), PIECE_BYTES):
                s = Shingles(buf, offs, shared.value)
                w = s.words
                one = textkit.mix(textkit.span_hash(w.hash, w.first[:-1], w.first[1:], textkit.WORD_BASE) + w.n.astype(U))
                two = textkit.mix(textkit.span_hash(w.hash, w.first[:-1], w.first[1:], textkit.BYTE_BASE) + U(1))
                sig = sample(s)
                packed = pa.array([x.tobytes() if n else None for x, n in zip(sig, w.n, strict=True)], pa.binary())
                yield pa.record_batch([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(offs)), packed], names=["doc_id", "raw", "h1", "h2", "bytes", "sig"])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(textkit.frugal(run), f"doc_id {type_of(docs, key)}, {SIGNED}")


def _near_centre(idf, threshold: float):
    """Exact comparison of a cell's texts with its centre's: (a, b) for pairs at the threshold.  Texts are taken in pieces."""

    def run(t: pa.Table) -> pa.Table:
        lead = np.asarray(t["lead"])
        node, at = np.asarray(t["node"]), np.flatnonzero(~lead)
        middle = Shingles(*textkit.column_bytes(t["text"].take(pa.array(np.flatnonzero(lead)[:1]))), idf.value)
        total, got = middle.weight.sum(), [np.zeros(0, dtype=np.int64)]
        for lo, hi, buf, offs in textkit.pieces(t["text"].take(pa.array(at)).combine_chunks(), PIECE_BYTES):
            s = Shingles(buf, offs, idf.value)
            k = np.minimum(np.searchsorted(middle.hash, s.hash), len(middle.hash) - 1)
            low = np.where(middle.hash[k] == s.hash, np.minimum(middle.weight[k], s.weight), 0.0)
            low, own = (np.bincount(s.doc, weights=x, minlength=hi - lo) for x in (low, s.weight))
            got.append(at[lo:hi][low / (total + own - low) >= threshold - EQUAL])
        found = node[np.concatenate(got)]
        middle_node = int(node[lead][0])
        return pa.table([pa.array(np.full(len(found), middle_node, dtype=np.int64)), pa.array(found, pa.int64())], names=["a", "b"])

    return run


def _likely(t: pa.Table, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (minor row, other row) of a block in different components that agree in AGREE samples and in no earlier band."""
    comp, minor = np.asarray(t["comp"]), np.asarray(t["minor"])
    sig = np.frombuffer(b"".join(x.as_py() for x in t["sig"]), dtype=np.uint32).reshape(-1, SAMPLES)
    one, every = np.flatnonzero(minor), np.flatnonzero(~minor)
    columns = np.ascontiguousarray(sig[every].T)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(one), 64):
        a = one[lo : lo + 64]
        same = np.zeros((len(a), len(every)), dtype=np.uint8)
        for j in range(SAMPLES):
            same += sig[a, j][:, None] == columns[j][None, :]
        x, y = np.nonzero((same >= AGREE) & (comp[a][:, None] != comp[every][None, :]))
        x, y = a[x], every[y]
        if band:
            before = (sig[x, : band * ROWS] == sig[y, : band * ROWS]).reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
            x, y = x[~before], y[~before]
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right), comp, minor


def _needy(key, t):
    """Rows of a block that have a likely partner in another component."""
    x, y, _, _ = _likely(t, key[0].as_py())
    at = pa.array(np.unique(np.concatenate([x, y])), pa.int64())
    n = len(at)
    fixed = [pa.array([k.as_py()] * n, kind) for k, kind in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
    return pa.table([*fixed, *[t[c].take(at) for c in ("node", "comp", "minor", "sig")]], names=["band", "key", "one", "two", "node", "comp", "minor", "sig"])


def _linked(idf, threshold: float):
    """Exact comparison of the likely pairs of a block: (a, b) for pairs at the threshold, one for each row and component."""
    def run(key, t):
        x, y, comp, _ = _likely(t, key[0].as_py())
        node = np.asarray(t["node"])
        texts, number = np.unique(node, return_inverse=True)
        first = np.unique(number, return_index=True)[1]
        s = Shingles(*textkit.column_bytes(t["text"].take(pa.array(first, pa.int64()))), idf.value)
        total = np.add.reduceat(np.append(s.weight, 0.0), s.first[:-1]) if len(s.hash) else np.zeros(len(texts))
        got: list[tuple[int, int]] = []
        cut_at = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
        for lo, hi in zip(cut_at[:-1], cut_at[1:], strict=True):
            i, others = number[x[lo]], number[y[lo:hi]]
            mine = slice(s.first[i], s.first[i + 1])
            n = s.first[others + 1] - s.first[others]
            at = textkit.ranges(s.first[others], n)
            k = np.minimum(np.searchsorted(s.hash[mine], s.hash[at]), mine.stop - mine.start - 1)
            low = np.where(s.hash[mine][k] == s.hash[at], np.minimum(s.weight[mine][k], s.weight[at]), 0.0)
            low = np.bincount(np.repeat(np.arange(len(n)), n), weights=low, minlength=len(n))
            ok = np.flatnonzero(low / (total[i] + total[others] - low) >= threshold - EQUAL)
            once = ok[np.unique(comp[y[lo:hi]][ok], return_index=True)[1]]
            got += [(int(node[x[lo]]), int(node[y[lo + j]])) for j in once]
        return pa.table([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], names=["a", "b"])

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, raw (hash of the text), root (a number of the near-duplicate class; null without words) and class_id (its smallest id) for every input row."""
    bound_batches(docs.sparkSession)
    idf = inverse_frequencies(docs, text)
    signed = stored(signatures(docs, key, text, idf), "signatures")
    nodes = signed.where("sig is not null").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "raw", "bytes")).alias("f"), F.first("sig").alias("sig"))
    nodes = stored(nodes.select(F.col("h1").alias("node"), "h2", F.col("f.doc_id").alias("first"), F.col("f.raw").alias("raw"), F.col("f.bytes").alias("bytes"), "sig"), "nodes")
    band = F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})")
    keys = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // ROWS - 1)))).select("node", "band", F.xxhash64("band", band).alias("key"))
    buckets = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(keys.join(buckets, ["band", "key"]), "buckets")
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    centre = met.join(company, "node").groupBy("band", "key").agg(F.max(F.struct("company", "node")).alias("c")).select("band", "key", F.col("c.node").alias("centre"))
    centre = stored(centre, "middles")
    met = stored(met.join(centre, ["band", "key"]), "met")
    texts = _texts(docs, key, text, nodes.join(met.select("node").distinct(), "node"))

    sig = nodes.select("node", "sig")
    star = met.where("node <> centre").select("centre", "node").distinct().join(nodes.select("node", "bytes"), "node")
    sizes = star.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    # only centres of several cells, at most one for BLOCK classes; the planner sees the table's true size
    many = stored(sizes.select("centre", _blocks(F.col("n"), F.col("bytes")).alias("cells")).where("cells > 1"), "centres")
    cell = F.pmod(F.xxhash64("node", "centre"), F.coalesce("cells", F.lit(1))).cast("int")
    star = stored(star.join(many, "centre", "left").select("centre", cell.alias("cell"), "node"), "star")
    middle = stored(star.select("centre", "cell").distinct(), "cells")
    # one row for each cell, so a centre's signature and text travel once for each
    one = middle.join(sig.toDF("centre", "sig_a"), "centre")
    two = star.join(sig.toDF("node", "sig_b"), "node")
    same = F.expr(f"size(filter(sequence(0, {SAMPLES - 1}), i -> substring(sig_a, 4 * i + 1, 4) = substring(sig_b, 4 * i + 1, 4)))")
    near = stored(two.join(one, ["centre", "cell"]).where(same >= AGREE).select("centre", "cell", "node"), "near")
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    leads = near.select("centre", "cell").distinct().join(texts.toDF("centre", "text"), "centre").select("centre", "cell", F.col("centre").alias("node"), "text", F.lit(True).alias("lead"))
    members = near.join(texts, "node").select("centre", "cell", "node", "text", F.lit(False).alias("lead"))
    links = stored(members.unionByName(leads).groupBy("centre", "cell").applyInArrow(textkit.frugal(_near_centre(shared, threshold)), "a long, b long"), "links")
    comp = stored(components(links), "components")

    # pairs of a bucket in different components
    inside = met.join(comp.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lead = inside.where("node = centre").select("band", "key", F.col("comp").alias("lead"))
    inside = inside.join(lead, ["band", "key"]).withColumn("minor", F.col("comp") != F.col("lead"))
    inside = inside.join(nodes.select("node", "bytes"), "node")
    minor = lambda c: F.when(F.col("minor"), c)
    open_ = inside.groupBy("band", "key").agg(F.count(minor(F.lit(1))).alias("minors"), F.sum(minor(F.col("bytes"))).alias("minor_bytes"), F.sum("bytes").alias("all_bytes")).where("minors > 0")
    open_ = stored(open_, "open")
    inside = inside.join(open_, ["band", "key"]).join(sig, "node")
    blocks, rows = _blocks(F.col("n"), F.col("all_bytes")), _blocks(F.col("minors"), F.col("minor_bytes"))
    # a minor row meets every block of the bucket, and every row every block of minor rows
    cell = ["band", "key", "one", "two", "node", "comp", "sig"]
    own_one, own_two = F.pmod(F.xxhash64("node"), rows).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    left = inside.where("minor").withColumn("one", own_one).withColumn("two", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*cell, F.lit(True).alias("minor"))
    right = inside.withColumn("two", own_two).withColumn("one", F.explode(F.sequence(F.lit(0), rows - 1))).select(*cell, F.lit(False).alias("minor"))
    schema = "band int, key long, one int, two int, node long, comp long, minor boolean, sig binary"
    needy = stored(left.unionByName(right).groupBy("band", "key", "one", "two").applyInArrow(textkit.frugal(_needy), schema), "needy")
    if not needy.isEmpty():
        more = needy.join(texts, "node").groupBy("band", "key", "one", "two").applyInArrow(textkit.frugal(_linked(shared, threshold)), "a long, b long")
        comp = components(links.unionByName(stored(more, "more")))

    named = nodes.select("node", "h2", "first").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(ids, "root").select(F.col("node").alias("h1"), "h2", "root", "class_id")
    out = signed.select("doc_id", "raw", F.when(F.col("sig").isNotNull(), F.col("h1")).alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    return out.select("doc_id", "raw", "root", F.coalesce("class_id", "doc_id").alias("class_id"))


def _blocks(n: Column, size: Column) -> Column:
    """Blocks for n rows with so many bytes of text together."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _texts(docs: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """(node, text) of the document that stands for each node."""
    needed = stored(nodes.select("node", F.col("first").alias("_k"), F.col("raw").alias("_r")), "needed")
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_raw"))
    # a merge join at every size: texts move once, needed or not
    texts = stored(texts.join(needed.hint("merge"), F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_raw") == F.col("_r"))).select("node", "text"), "found")
    if texts.count() != needed.count():  # repeated rows
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return texts


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (all columns), one of each class: of the smallest id, and of rows alike in id (all null included) any one.

    Texts without words stay as they are.
    """
    docs, back = shield(docs, key, text)
    found = stored(classes(docs, key, text, threshold).where("root is not null"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "raw")).alias("f")
    kept = stored(found.groupBy("root").agg(first).select("root", F.col("f.doc_id").alias("_id"), F.col("f.raw").alias("_first")), "kept")
    same = found.join(kept, "root").withColumn("_stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_first")))
    mine = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_raw") == F.col("_r"))
    gone = same.where("not _stays").select(F.col("doc_id").alias("_k"), F.col("raw").alias("_r")).distinct()
    out = docs.withColumn("_raw", F.xxhash64(text)).join(gone, mine, "left_anti")
    # rows alike in id and text
    twice = stored(same.where("_stays").groupBy(F.col("doc_id").alias("_k"), F.col("raw").alias("_r")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    if not twice.isEmpty():
        out = out.join(twice, mine, "left_anti").unionByName(out.join(twice, mine, "left_semi").dropDuplicates([key, "_raw"]))
    return out.drop("_raw").withColumnsRenamed(back)
