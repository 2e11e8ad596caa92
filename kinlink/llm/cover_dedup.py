"""Substring dedup with difference-cover anchors.

A difference cover D modulo v holds, for any two positions i and j, a shift s < v with both i+s and j+s at residues in D.
So two equal windows of ``window`` words share an aligned anchor of window-v+1 words that begins at a cover position in
both.  First the anchors at cover positions are hashed and those that occur twice are found.  Each is then extended left
and right to all windows around it; the windows that occur twice are the matches.  Every word that a match covers goes.

Anchors and windows are identified by 64-bit hashes (anchor and window hash must both agree).  Keys cross the shuffle
packed, once for each slice of the corpus (``exchange``), so one passage in a third of all documents is no hot key.

Defined results for odd inputs: a null, empty or shorter text has no window and keeps all its words; repeated rows (same id
and text) are different texts and remove each other's windows; an empty table gives an empty result; a null id stays null.
Only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange, textkit
from .scratch import type_of

#: Perfect difference sets (fixed values): any difference modulo v occurs between two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
RESULT = "n_words long, n_removed long, kept_text string, times long"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that leaves anchors of at least eight words, or of one word for short windows; no cover below that."""
    fits = [v for v in COVERS if window - v + 1 >= min(8, max(1, window // 2))]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class _Slice:
    """Anchors and windows of a slice, in the order in which it asks about them."""

    def __init__(self, table: pa.Table, window: int):
        self.v, cover = cover_for(window)
        self.window, self.anchor = window, window - self.v + 1
        buf, offs = textkit.column_bytes(table["text"])
        self.w = textkit.Words(buf, offs, textkit.NON_BLANK)
        at = np.flatnonzero(self.w.fits(self.anchor))
        member = np.zeros(self.v, dtype=bool)
        member[list(cover)] = True
        first = np.repeat(self.w.first[:-1], self.w.n)
        at = at[member[(at - first[at]) % self.v]]
        self.at = at
        self.keys, self.inv, self.count = np.unique(self.w.window_hash(at, self.anchor), return_inverse=True, return_counts=True)

    def extend(self, anchors: np.ndarray) -> None:
        """Windows around the anchors that are shared (here or elsewhere)."""
        hit = self.at[((self.count > 1) | anchors)[self.inv]]
        room = self.window - self.anchor
        around = textkit.cover(len(self.w.start) + room + 1, hit, room + 1)[room:-1]
        self.wat = np.flatnonzero(self.w.fits(self.window) & around)
        self.wkeys, self.winv, self.wcount = np.unique(self.w.window_hash(self.wat, self.window), return_inverse=True, return_counts=True)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by single spaces, one row for each input row."""
    slices = exchange.sliced(docs, key, text)
    buckets = slices.buckets

    def anchors(s: int, t: pa.Table, _) -> pa.Table:
        x = _Slice(t, window)
        return exchange.ask(s, 0, x.keys, None, buckets)

    def windows(s: int, t: pa.Table, a: pa.Table) -> pa.Table:
        x = _Slice(t, window)
        x.extend(exchange.heard(a, 0, x.keys, buckets, 1)[:, 0] > 0)
        return exchange.ask(s, 1, x.wkeys, None, buckets)

    def remove(s: int, t: pa.Table, a: pa.Table) -> pa.Table:
        x = _Slice(t, window)
        x.extend(exchange.heard(a, 0, x.keys, buckets, 1)[:, 0] > 0)
        again = (x.wcount > 1) | (exchange.heard(a, 1, x.wkeys, buckets, 1)[:, 0] > 0)
        gone = textkit.cover(len(x.w.start), x.wat[again[x.winv]], window)
        first, kept, removed = x.w.first, [], []
        lost = np.concatenate([[0], np.cumsum(gone)])
        for i, value in enumerate(t["text"]):
            words = (value.as_py() or "").encode().split()
            k = int(lost[first[i + 1]] - lost[first[i]])
            removed.append(k)
            kept.append(b" ".join(words if not k else compress(words, ~gone[first[i] : first[i + 1]])))
        return pa.table([t["key"], pa.array(x.w.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), t["times"]], names=["doc_id", "n_words", "n_removed", "kept_text", "times"])

    first = exchange.answers(exchange.with_slices(slices, anchors, exchange.ASKED), {0: (exchange.shared, 1)})
    second = exchange.answers(exchange.with_slices(slices, windows, exchange.ASKED, first), {1: (exchange.shared, 1)})
    return exchange.given_back(exchange.with_slices(slices, remove, f"doc_id {type_of(docs, key)}, {RESULT}", first.unionByName(second)), slices)
