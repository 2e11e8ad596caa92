"""Document quality from a linear-chain conditional random field over lines.

Every line has a few measures of its form - words, shouting, symbols, digits, repeats - cut into bins.  Features of a line
are its own bins and those of the lines before and after it.  The field labels each line good (1) or bad (0);
forward-backward marginals, weighted by the lines' lengths, aggregate into the share of good text, from which a
calibrated logistic function gives the document score.

Training (driver, bounded sample): lines take their document's label; then, twice, lines of bad documents that the
field holds for good are relabelled good, as bad documents hold clean lines too, and the field is fitted again.

Defined results for odd inputs: null and empty texts have no line and score as the calibration's lowest share of good
text; a null id is scored and counts as held out; without labelled rows of both classes every score is 1 (nothing is
known against a document).  Repeated rows are scored alike; extra columns pass through ``keep_good`` and are ignored else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, labels, textkit
from .scratch import bound_batches, type_of

RESULT = "score double, n_lines int, good_lines int"
THRESHOLD = 0.3
#: Bin edges of each measure of a line.
SHARE = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.9)
EDGES = {
    "words": (0, 1, 2, 4, 8, 16, 32, 64),
    "word_bytes": (1.5, 2.5, 3.5, 4.5, 6, 8, 12, 20),
    "upper": SHARE,
    "symbols": SHARE,
    "digits": SHARE,
    "marked_words": SHARE,
    "repeats": SHARE,
    "other_repeats": SHARE,
    "non_ascii": SHARE,
}
BINS = 9
#: Punctuation of plain prose (fixed values); other ASCII signs are symbols.
PROSE = b".,;:'\"()-?"
_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[0x21:0x7F] = True
_SYMBOL &= ~(_LETTER | _DIGIT)
_SYMBOL[list(PROSE)] = False


class Lines:
    """Non-empty lines of a batch of texts: bytes, texts they belong to, and their bins."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        table = np.ones(256, dtype=bool)
        table[[0x0A, 0x0D]] = False
        lines = textkit.Words(buf, offs, table)
        w = textkit.Words(buf, offs, textkit.NON_BLANK)
        inside = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
        keep = inside[1] > inside[0]
        self.first = np.concatenate([[0], np.cumsum(keep)])[lines.first]
        self.n = np.diff(self.first)
        lo, hi = inside[0][keep], inside[1][keep]
        start, end = lines.start[keep], lines.end[keep]
        self.bytes = end - start
        self.starts = np.zeros(len(start), dtype=bool)
        self.starts[self.first[:-1][self.n > 0]] = True

        def among(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return sums[end] - sums[start]

        def of_words(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return sums[hi] - sums[lo]

        words = hi - lo
        letters = np.maximum(1, among(_LETTER[buf]))
        same = np.zeros(len(w.start), dtype=bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) if len(w.start) else False
        same[lo] = False  # a line's first word has none before it
        line = np.repeat(np.arange(len(lo)), words)
        seen = w.hash[textkit.ranges(lo, words)]
        order = np.lexsort((seen, line))
        again = np.zeros(len(seen), dtype=bool)
        again[1:] = (seen[order][1:] == seen[order][:-1]) & (line[order][1:] == line[order][:-1])
        repeats = np.bincount(line[order][again], minlength=len(lo))
        sizes = np.maximum(1, self.bytes)
        measures = {
            "words": words,
            "word_bytes": of_bytes(w, lo, hi) / words,
            "upper": among(_UPPER[buf]) / letters,
            "symbols": among(_SYMBOL[buf]) / sizes,
            "digits": among(_DIGIT[buf]) / sizes,
            "marked_words": of_words(_SYMBOL[buf[w.end - 1]] if len(w.end) else np.zeros(0, bool)) / words,
            "repeats": of_words(same) / words,
            "other_repeats": repeats / words,
            "non_ascii": among(buf >= 0x80) / sizes,
        }
        self.bins = np.stack([k * BINS + np.searchsorted(edges, measures[name], side="left") for k, (name, edges) in enumerate(EDGES.items())]) if len(lo) else np.zeros((len(EDGES), 0), dtype=np.int64)


def of_bytes(w: textkit.Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return sums[hi] - sums[lo]


OWN = len(EDGES) * BINS
SIZE = 3 * OWN + 1


def _shifted(x: Lines) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Feature blocks: (lines that get, lines whose bins they get, first feature): own, the line before, the line after."""
    every = np.arange(len(x.starts))
    after = np.flatnonzero(~x.starts)
    return [(every, every, 0), (after, after - 1, OWN), (after - 1, after, 2 * OWN)]


def emissions(weights: np.ndarray, x: Lines) -> np.ndarray:
    out = np.full(len(x.starts), weights[-1])
    for to, of, at in _shifted(x):
        out[to] += weights[at + x.bins[:, of]].sum(axis=0)
    return out


def _pull(grad: np.ndarray, x: Lines) -> np.ndarray:
    out = np.zeros(SIZE)
    out[-1] = grad.sum()
    for to, of, at in _shifted(x):
        for row in x.bins:
            out[at : at + OWN] += np.bincount(row[of], weights=grad[to], minlength=OWN)
    return out


def _share(marg: np.ndarray, x: Lines) -> np.ndarray:
    """Length-weighted share of good text of each document (no lines: 0), as a logit and as a share."""
    good = np.zeros(len(x.n))
    some = x.n > 0
    if some.any():
        at = x.first[:-1][some]
        good[some] = np.add.reduceat(marg * x.bytes, at) / np.add.reduceat(x.bytes, at)
    s = np.clip(good, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(s / (1 - s)), good])


def train(texts: list[str], good: list[int], prior: float, rounds: int = 3) -> crf.Model | None:
    y = np.array(good, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    x = Lines(*textkit.column_bytes(pa.array(texts, pa.large_string())))
    doc = np.repeat(np.arange(len(y)), x.n)
    label = y[doc]
    m = None
    for _ in range(rounds):
        m = crf.fit(lambda v: emissions(v, x), lambda g: _pull(g, x), SIZE, x.starts, label, steps=60, rate=0.1, l2=1e-4)
        marg = m.marginals(emissions(m.weights, x), x.starts)
        label = np.where(y[doc] > 0, 1.0, (marg > 0.5).astype(float))
        # a bad document keeps at least its worst line
        worst = np.lexsort((marg, doc))
        label[worst[x.first[:-1][(x.n > 0) & (y == 0)]]] = 0.0
    m.calibration = crf.calibrate(_share(marg, x), y, prior)
    return m


def score(docs: DataFrame, model: crf.Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_lines and good_lines of each whole text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in textkit.pieces(batch.column(1), 1 << 20):
                s, n, good = score_batch(shared.value, buf, offs)
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(s), pa.array(n, pa.int32()), pa.array(good, pa.int32())], names=["doc_id", "score", "n_lines", "good_lines"])

    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(textkit.frugal(run), f"doc_id {type_of(docs, key)}, {RESULT}")


def score_batch(m: crf.Model | None, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = Lines(buf, offs)
    if m is None:
        return np.ones(len(x.n)), x.n, x.n
    marg = m.marginals(emissions(m.weights, x), x.starts)
    good = np.concatenate([[0], np.cumsum(marg >= 0.5)])[x.first]
    return crf.predict(m.calibration, _share(marg, x)), x.n, np.diff(good)


def assess(docs: DataFrame, known: DataFrame, label: str = "quality", max_docs: int = labels.SAMPLE_DOCS) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and score every document."""
    out = score(docs, train(*labels.sample(docs, known, label, max_docs=max_docs)))
    return out.withColumns({"held_out": labels.held_out(F.col("doc_id")), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def keep_good(docs: DataFrame, known: DataFrame, label: str = "quality", text: str = "text", threshold: float = THRESHOLD, max_docs: int = labels.SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches the threshold; rows are judged where they lie, without a join."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(*labels.sample(docs, known, label, max_docs=max_docs)))
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            ok = [score_batch(shared.value, buf, offs)[0] >= threshold for _, _, buf, offs in textkit.pieces(batch.column(at), 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(ok) if ok else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(textkit.frugal(run), docs.schema)
