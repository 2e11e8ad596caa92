"""Toxic spans and document scores from a linear-chain conditional random field over words.

Training (driver, bounded sample): a word is labelled toxic where it stands in a document labelled toxic and one of its
forms - the word, its first four, five or six bytes - is tied to toxic documents beyond chance (likelihood ratio over document
counts).  The field is fitted to these labelled tokens with the hashed forms as features.

Scoring (every whole text): forward-backward marginals of all words.  A span is a run of words of marginal 0.5 or more.
The document score is a calibrated logistic function of the largest marginal and of the number of such words.

Defined results for odd inputs: null and empty texts have no words and get the score of a document without any toxic
word; a null id is scored and counts as held out; without labelled rows of both classes every score is 0.  Repeated rows
are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, labels, textkit
from .scratch import bound_batches, type_of

U = np.uint64
BITS = 18
RESULT = "score double, predicted int, spans array<array<int>>"
#: Bytes of the leading parts of a word that are features beside the word itself.
PREFIXES = (4, 5, 6)


def _lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 letters."""
    out = textkit.LOWER[buf]
    high = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1 if len(buf) else []
    out[high] += 32
    return out


def _features(buf: np.ndarray, offs: np.ndarray) -> tuple[textkit.Words, np.ndarray]:
    """Words and, for each, the numbers of its hashed forms."""
    w = textkit.Words(_lowered(buf), offs, textkit.ALNUM)
    forms = [w.hash]
    for k, n in enumerate(PREFIXES):
        end = np.minimum(w.end, w.start + n)
        forms.append(textkit.mix(textkit.span_hash(w.buf, w.start, end, textkit.BYTE_BASE) + (end - w.start).astype(U) * U(textkit.WORD_BASE) + U(k + 1)))
    return w, np.stack([(f >> U(64 - BITS)).astype(np.int32) for f in forms])


def _tied(word: np.ndarray, feat: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features tied to toxic documents: likelihood ratio of document counts above what the number of features lets expect.

    A word counts once with the same neighbours on both sides, so copies of a toxic text do not tie its clean words.
    """
    size = 1 << BITS
    beside = np.concatenate([[U(0)], word, [U(0)]])
    around = textkit.mix(beside[:-2] * U(3) + textkit.mix(beside[2:] + U(1)) + word * U(5))
    _, once = np.unique(around, return_index=True)
    a, n = np.zeros(size), np.zeros(size)
    for form in feat:
        pairs = np.unique(form[once].astype(np.int64) * len(y) + doc[once])
        f = pairs // len(y)
        a += np.bincount(f, weights=y[pairs % len(y)], minlength=size)
        n += np.bincount(f, minlength=size)
    base = y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        b = n - a
        g = 2 * (np.where(a > 0, a * np.log(a / (n * base)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - base))), 0))
    tested = max(2, int((n >= 3).sum()))
    return (n >= 3) & (a / np.maximum(n, 1) > (1 + base) / 2) & (g > 2 * np.log(tested))


def _emission(weights: np.ndarray, feat: np.ndarray) -> np.ndarray:
    out = weights[feat[0]].astype(float)
    for f in feat[1:]:
        out += weights[f]
    return out


def train(texts: list[str], toxic: list[int], prior: float) -> crf.Model | None:
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    buf, offs = textkit.column_bytes(pa.array(texts, pa.large_string()))
    w, feat = _features(buf, offs)
    doc = w.doc
    tied = _tied(w.hash, feat, doc, y)
    label = np.zeros(len(doc))
    for form in feat:
        label[tied[form] & (y[doc] > 0)] = 1.0
    starts = np.zeros(len(doc), dtype=bool)
    starts[w.first[:-1][w.n > 0]] = True
    size = 1 << BITS

    def pull(grad: np.ndarray) -> np.ndarray:
        return sum(np.bincount(f, weights=grad, minlength=size) for f in feat)

    m = crf.fit(lambda v: _emission(v, feat), pull, size, starts, label, steps=40, rate=0.25, l2=1e-5)
    m.calibration = crf.calibrate(_summary(m.marginals(_emission(m.weights, feat), starts), w), y, prior)
    m.weights = m.weights.astype(np.float32)
    return m


def _summary(marg: np.ndarray, w: textkit.Words) -> np.ndarray:
    """Per document: logit of the largest marginal (no words: the lowest), and log of one plus the number of toxic words."""
    top, many = np.full(len(w.n), 1e-6), np.zeros(len(w.n))
    some = w.n > 0
    if some.any():
        top[some] = np.clip(np.maximum.reduceat(marg, w.first[:-1][some]), 1e-6, 1 - 1e-6)
        many[some] = np.add.reduceat((marg >= 0.5).astype(float), w.first[:-1][some])
    return np.column_stack([np.log(top / (1 - top)), np.log1p(many)])


def score(docs: DataFrame, model: crf.Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted and the byte offsets (begin, end) of the toxic spans of each whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi, buf, offs in textkit.pieces(batch.column(1), 1 << 20):
                if m is None:
                    s, spans = np.zeros(hi - lo), [[]] * (hi - lo)
                else:
                    w, feat = _features(buf, offs)
                    starts = np.zeros(len(w.start), dtype=bool)
                    starts[w.first[:-1][w.n > 0]] = True
                    marg = m.marginals(_emission(m.weights, feat), starts)
                    s = crf.predict(m.calibration, _summary(marg, w))
                    spans = _spans(marg >= 0.5, w)
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(textkit.frugal(run), f"doc_id {type_of(docs, key)}, {RESULT}")


def _spans(on: np.ndarray, w: textkit.Words) -> list[list[list[int]]]:
    out: list[list[list[int]]] = [[] for _ in w.n]
    at = np.flatnonzero(on)
    doc = np.searchsorted(w.first, at, side="right") - 1
    last = (-2, -1)
    for i, d in zip(at.tolist(), doc.tolist(), strict=True):
        if last == (i - 1, d):
            out[d][-1][1] = int(w.end[i] - w.offs[d])
        else:
            out[d].append([int(w.start[i] - w.offs[d]), int(w.end[i] - w.offs[d])])
        last = (i, d)
    return out


def detect(docs: DataFrame, known: DataFrame, label: str = "toxic", max_docs: int = labels.SAMPLE_DOCS) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and score every document."""
    out = score(docs, train(*labels.sample(docs, known, label, max_docs=max_docs)))
    return out.withColumn("held_out", labels.held_out(F.col("doc_id")))
