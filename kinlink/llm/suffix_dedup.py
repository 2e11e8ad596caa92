"""Repeated passages by a sparse suffix array.

Only suffixes that begin at content-selected minimisers are kept: in every window of ``min_words`` words the run of GRAM
words with the smallest hash is chosen, so equal windows choose the same suffix, and about one word in twenty begins one.
Suffixes whose leading run occurs elsewhere go, with their words to the right and left, to the bucket of that run.  A
bucket sorts them, takes the common prefix of neighbours, and extends to the left: the window that begins t words before
a suffix is repeated if, within the stretch of the sorted order whose neighbours share min_words - t words, another suffix
has the same t words before it.  All suffixes of such a stretch are compared, not only direct neighbours, so no repeat
is lost between unlike neighbours.  Repeated windows unite to maximal spans.

Words are runs of non-blank characters, compared by 32-bit codes within equal 64-bit leading runs.  Equal suffixes of one
slice of the corpus travel once, so one passage in a third of all documents is no hot key.  A leading run that more than MANY
slices share may stand in as many contexts as there are documents, and its suffixes would fill one bucket: they are split by
all the words of their windows instead of the leading run (64-bit hashes of whole windows, each once for a slice).

Defined results for odd inputs: null, empty and shorter texts have no span; repeated rows repeat all their windows; an
empty table gives an empty result; a null id is kept in its spans.  Only the id and text columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange, textkit
from .scratch import type_of

U = np.uint64
#: Words in a suffix's leading run, and the number of slices up to which its suffixes meet in one bucket.
GRAM = 10
MANY = 64
RESULT = "n_words long, span_start long, span_words long, times long"


def minimisers(w: textkit.Words, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``min_words`` words: its first word and the word at which its chosen run begins."""
    n = len(w.start)
    wins = np.flatnonzero(w.fits(min_words))
    if not len(wins):
        return wins, wins
    runs = np.flatnonzero(w.fits(gram))
    # 40 bits of the run's hash and then its place: the leftmost of equals wins, whatever lies around the window
    packed = np.full(n, np.iinfo(U).max, dtype=U)
    packed[runs] = (w.window_hash(runs, gram) >> U(24) << U(24)) | (runs & 0xFFFFFF).astype(U)
    size, best, reach = min_words - gram + 1, packed, 1
    while reach * 2 <= size:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    low = np.minimum(best[wins], best[wins + size - reach])
    at = (low & U(0xFFFFFF)).astype(np.int64)
    return wins, at + ((wins - at + 0xFFFFFF) >> 24 << 24)


def _halves(keys: np.ndarray) -> np.ndarray:
    """64-bit keys as two columns of 32 bits, high half first."""
    return np.stack([keys >> U(32), keys & U(0xFFFFFFFF)], axis=1).astype(np.uint32)


def _sortable(rows: np.ndarray, kind: str) -> np.ndarray:
    """Rows of 32-bit numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"{kind}{4 * rows.shape[1]}").reshape(-1)


class _Slice:
    def __init__(self, table: pa.Table, min_words: int, gram: int):
        self.size, self.gram = min_words, gram
        buf, offs = textkit.column_bytes(table["text"])
        self.w = textkit.Words(buf, offs, textkit.NON_BLANK)
        self.wins, self.of = minimisers(self.w, min_words, gram)
        self.at, self.first, per = np.unique(self.of, return_index=True, return_counts=True)
        # windows of one suffix are neighbours: they begin from t_max down to t_min words before it
        self.t_max = self.at - self.wins[self.first] if len(self.at) else self.at
        self.t_min = self.t_max - per + 1
        self.heads, self.inv, self.count = np.unique(self._key(self.at), return_inverse=True, return_counts=True)

    def _key(self, at: np.ndarray) -> np.ndarray:
        """Keys of leading runs: hashed once more, as chosen runs have small hashes and would crowd the first buckets."""
        return textkit.mix(self.w.window_hash(at, self.gram))

    def context(self, elsewhere: np.ndarray) -> None:
        """Records of the suffixes whose leading run is shared (1) and windows of those in many slices (2); equal ones count once."""
        self.split(np.flatnonzero((elsewhere > 1)[self.inv]))
        self.sel = np.flatnonzero((((self.count > 1) | (elsewhere > 0)) & (elsewhere < 2))[self.inv])
        at, span = self.at[self.sel], self.size - self.gram
        codes = np.zeros(len(self.w.start) + 2 * self.size, dtype=np.uint32)
        codes[self.size : self.size + len(self.w.start)] = (self.w.hash >> U(32)).astype(np.uint32)
        right = codes[(at + self.size)[:, None] + np.arange(self.size)]
        left = codes[(at + self.size)[:, None] - 1 - np.arange(span)]
        # words outside the suffix's own windows never count
        right[np.arange(self.size) >= (self.size - self.t_min[self.sel])[:, None]] = 0
        left[np.arange(span) >= self.t_max[self.sel][:, None]] = 0
        bounds = np.stack([self.t_min[self.sel], self.t_max[self.sel]], axis=1).astype(np.uint32)
        full = np.concatenate([_halves(self._key(at)), right, left, bounds], axis=1)
        if len(full):
            rows, self.rinv, self.rcount = np.unique(_sortable(full, "V"), return_inverse=True, return_counts=True)
            body = np.frombuffer(rows.tobytes(), dtype=">u4").reshape(len(rows), -1)
        else:
            body, self.rinv, self.rcount = full, np.zeros(0, dtype=int), np.zeros(0, dtype=int)
        self.rkeys = body[:, 0].astype(U) << U(32) | body[:, 1].astype(U)
        self.rbody = np.concatenate([body[:, 2:].astype(np.uint32), (self.rcount > 1).astype(np.uint32)[:, None]], axis=1)


    def split(self, hot: np.ndarray) -> None:
        """Windows of the suffixes ``hot``: their first words and keys."""
        n = self.t_max[hot] - self.t_min[hot] + 1
        self.wat = np.sort(textkit.ranges(self.at[hot] - self.t_max[hot], n))
        self.wkeys, self.winv, self.wcount = np.unique(self.w.window_hash(self.wat, self.size), return_inverse=True, return_counts=True)


def _repeats(size: int, gram: int):
    """Solver of a bucket: for each record the set of t whose window is repeated, as bits."""
    span = size - gram
    width = size + span + 3

    def solve(keys: np.ndarray, rows: np.ndarray, data: bytes) -> np.ndarray:
        rec = np.frombuffer(data, dtype=np.uint32).reshape(len(keys), width)
        out = np.zeros(len(keys), dtype=U)
        right = rec[:, :size]
        order = np.argsort(_sortable(np.concatenate([_halves(keys), right], axis=1), "S"), kind="stable")
        r, k = right[order], keys[order]
        unlike = r[1:] != r[:-1]
        lcp = np.where(unlike.any(axis=1), unlike.argmax(axis=1), size)
        lcp[k[1:] != k[:-1]] = 0
        left, t_min, t_max, multi = rec[order, size : size + span], rec[order, -3].astype(int), rec[order, -2].astype(int), rec[order, -1] > 0
        before = np.zeros(len(keys), dtype=U)
        found = np.zeros(len(keys), dtype=U)
        for t in range(span + 1):
            if t:
                before = before * U(textkit.WORD_BASE) + left[:, t - 1].astype(U) + U(1)
            live = np.flatnonzero((t_min <= t) & (t <= t_max))
            if not len(live):
                continue
            stretch = np.concatenate([[0], np.cumsum(lcp < size - t)])
            key = textkit.mix(before[live] ^ textkit.mix(stretch[live].astype(U)))
            _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
            found[live[(count[inv] > 1) | multi[live]]] |= U(1) << U(t)
        out[order] = found
        return out

    return solve


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """One row for each maximal span of words all of whose windows of ``min_words`` words begin elsewhere too.

    doc_id, n_words (of the text), span_start (word index) and span_words.  ``min_words`` is at most gram + 63.
    """
    if not gram < min_words <= gram + 63:
        raise ValueError("min_words must lie between gram + 1 and gram + 63")
    slices = exchange.sliced(docs, key, text)
    buckets = slices.buckets

    def heads(s: int, t: pa.Table, _) -> pa.Table:
        return exchange.ask(s, 0, _Slice(t, min_words, gram).heads, None, buckets)

    def suffixes(s: int, t: pa.Table, a: pa.Table) -> pa.Table:
        x = _Slice(t, min_words, gram)
        x.context(exchange.heard(a, 0, x.heads, buckets, 1)[:, 0])
        return pa.concat_tables([exchange.ask(s, 1, x.rkeys, x.rbody, buckets), exchange.ask(s, 2, x.wkeys, None, buckets)])

    def spans(s: int, t: pa.Table, a: pa.Table) -> pa.Table:
        x = _Slice(t, min_words, gram)
        x.context(exchange.heard(a, 0, x.heads, buckets, 1)[:, 0])
        bits = np.ascontiguousarray(exchange.heard(a, 1, x.rkeys, buckets, 8)).view(U).reshape(-1)[x.rinv] if len(x.sel) else np.zeros(0, U)
        t_of = np.arange(64, dtype=U)
        k, shift = np.nonzero((bits[:, None] >> t_of) & U(1))
        again = x.wat[((x.wcount > 1) | (exchange.heard(a, 2, x.wkeys, buckets, 1)[:, 0] > 0))[x.winv]]
        n, first = len(x.w.start), x.w.first
        inside = textkit.cover(n, np.concatenate([x.at[x.sel][k] - shift, again]), min_words)
        doc = x.w.doc
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        b = np.flatnonzero(begin)
        length = np.add.reduceat(inside, b, dtype=np.int64) if len(b) else b
        d = doc[b]
        row = pa.array(d, pa.int64())
        return pa.table([t["key"].take(row), pa.array(x.w.n[d], pa.int64()), pa.array(b - first[d], pa.int64()), pa.array(length, pa.int64()), t["times"].take(row)], names=["doc_id", "n_words", "span_start", "span_words", "times"])

    often = partial(exchange.shared, many=many)
    first = exchange.answers(exchange.with_slices(slices, heads, exchange.ASKED), {0: (often, 1)})
    second = exchange.answers(exchange.with_slices(slices, suffixes, exchange.ASKED, first), {1: (_repeats(min_words, gram), 8), 2: (exchange.shared, 1)})
    out = exchange.with_slices(slices, spans, f"doc_id {type_of(docs, key)}, {RESULT}", first.unionByName(second))
    return exchange.given_back(out, slices)
