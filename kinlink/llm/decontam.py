"""Benchmark decontamination with a stored, distributed positional inverted index.

``build_index`` reads the corpus once and stores, for every segment of about SEGMENT_BYTES of text, its terms in order and for
each term the number of its documents and the list of its places (document and position in one numbering).  The index holds all
terms of the corpus and so serves any test set.  It is divided by documents: a segment's lists lie together, and no term - however
frequent - gathers postings in one task.

``term_counts`` sums document frequencies of the test terms over the segments; they order each query's terms from the rarest on.

``phrase_matches`` intersects, for each query phrase whose rarest term a segment has, the offset-adjusted posting lists: the
places of its rarest term, shifted to the phrase's start, are looked up in the list of the next rarest, and so on through all
its terms, so a hit is an exact phrase.  ``proximity_matches`` asks that the rarest terms of an item lie within a number of words.

Test sets are broadcast in blocks of at most BLOCK_WORDS words, whatever their size.  The corpus is read once; the index is
read twice for each block.

Words: A-Z are lower-cased, a word is a run of ASCII letters, digits and non-ASCII characters.  Terms are 64-bit hashes.

Defined results for odd inputs: null or empty texts and items have no words and match nothing; items shorter than the
window are one phrase; an item id in several rows is listed once; repeated documents are judged each alone; an empty document
table gives an empty result and an empty test set leaves everything clean; ids are of any type, null ids are kept (a null item id
is not listed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .scratch import bound_batches, shield, stored, type_of

U = np.uint64
#: Words of test items in one broadcast block, bytes of text of a segment (a row of the index), and of a row group.
BLOCK_WORDS = 500_000
SEGMENT_BYTES, GROUP_BYTES = 256 << 10, 8 << 20
#: Numbers without a word between two documents of a segment: more than a phrase or a neighbourhood is long.
MARGIN = 64
INDEX = "segment long, ids array<{id}>, rows binary, n_words binary, terms binary, docs binary, counts binary, places binary"


def _words(col: pa.Array) -> textkit.Words:
    buf, offs = textkit.column_bytes(col)
    return textkit.Words(buf, offs, textkit.ALNUM, lower=True)


class Phrases:
    """Items of a block: terms of their words, phrases, and the order in which a phrase's words are looked up."""

    def __init__(self, ids: list[str | None], w: textkit.Words, window: int):
        self.ids = ids
        self.vocab, term = np.unique(w.hash, return_inverse=True)
        self.term = term.astype(np.int32)
        long = w.n >= window
        starts = np.flatnonzero(w.fits(window))
        short = np.flatnonzero(~long & (w.n > 0))
        self.start = np.concatenate([starts, w.first[:-1][short]])
        self.length = np.concatenate([np.full(len(starts), window), w.n[short]])
        self.item = np.concatenate([w.doc[starts], short])
        self.first, self.n = w.first, w.n

    def order(self, df: np.ndarray) -> None:
        """Places within each phrase, the rarest term first, padded with the last of them; phrases sorted by their rarest term."""
        width = int(self.length.max()) if len(self.length) else 1
        place = np.minimum(np.arange(width), self.length[:, None] - 1)
        rank = np.argsort(df[self.term[self.start[:, None] + place]], axis=1, kind="stable")
        self.place = np.take_along_axis(place, rank, axis=1).astype(np.uint8)
        rarest = self.lookup(np.arange(len(self.start)), 0)
        by = np.argsort(rarest, kind="stable")
        self.start, self.length, self.item, self.place = self.start[by], self.length[by], self.item[by], self.place[by]
        self.of_term = np.searchsorted(rarest[by], np.arange(len(self.vocab) + 1))

    def lookup(self, phrase: np.ndarray, k: int) -> np.ndarray:
        """Term of the k-th word looked up."""
        return self.term[self.start[phrase] + self.place[phrase, k]].astype(np.int64)


def item_blocks(items: DataFrame, key: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test set in blocks; the driver holds one block of rows at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(key).cast("string"), text).toLocalIterator():
        n = len(row[1] or "") // 2 + 1
        if ids and size + n > block_words:
            yield Phrases(ids, _words(pa.array(texts, pa.string())), window)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield Phrases(ids, _words(pa.array(texts, pa.string())), window)


def _by_term(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and places, sorted by term and then by place (places come in order)."""
    bits = U(int(place[-1]).bit_length() if len(place) else 0)
    # the leading bits of a hash and a place's number in one number sort fastest
    at = (np.sort((h >> bits << bits) | np.arange(len(h), dtype=U)) & ((U(1) << bits) - U(1))).astype(np.int64)
    t = h[at]
    if (t[1:] < t[:-1]).any() or ((t[1:] == t[:-1]) & (at[1:] < at[:-1])).any():  # terms that agree in these bits
        at = np.lexsort((place, h))
        t = h[at]
    return t, place[at]


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each segment: its documents, its terms in order, documents and places of each, packed."""
    bound_batches(docs.sparkSession)

    def index(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offs in textkit.pieces(batch.column(1), SEGMENT_BYTES):
                w = textkit.Words(buf, offs, textkit.ALNUM, lower=True)
                t, place = _by_term(w.hash, np.arange(len(w.start)) + MARGIN * w.doc)
                new = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, dtype=np.int64)
                doc = np.searchsorted(_bases(w.n), place, side="right")
                once = np.cumsum(np.append(True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1]))) if len(t) else np.zeros(0, dtype=np.int64)
                n_docs = np.diff(np.append(once[new], once[-1] + 1 if len(once) else 0))
                pack = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.large_binary()).cast(pa.binary())
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0)[lo:hi])
                yield pa.record_batch(
                    [pa.array([number], pa.int64()), ids, pack(np.asarray(batch.column(2)[lo:hi]), np.int64), pack(w.n, np.int64), pack(t[new], U), pack(n_docs, np.uint32), pack(np.diff(np.append(new, len(t))), np.uint32), pack(place, np.uint32)],
                    names=["segment", "ids", "rows", "n_words", "terms", "docs", "counts", "places"],
                )
                number += 1

    return docs.select(F.col(key), text, F.xxhash64(key, text)).mapInArrow(textkit.frugal(index), INDEX.format(id=type_of(docs, key)))


def _bases(n: np.ndarray) -> np.ndarray:
    """First number of each document's words, and the end."""
    return np.concatenate([[0], np.cumsum(n + MARGIN)])


def _load(batch: pa.RecordBatch, i: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)


def term_counts(index: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """Number of documents that hold each term, over all segments."""
    shared = index.sparkSession.sparkContext.broadcast(vocab)

    def count(batches):
        terms = shared.value
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, k = _common(_load(batch, i, "terms", U), terms)
                total[k] += _load(batch, i, "docs", np.uint32)[at]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocab), dtype=np.int64)
    if len(vocab):
        for term, n in index.select("terms", "docs").mapInArrow(textkit.frugal(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
            out[term] = n
    return out


def _common(terms: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms that both sorted lists have: in the first and in the second."""
    if not len(vocab):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    k = np.minimum(np.searchsorted(vocab, terms), len(vocab) - 1)
    at = np.flatnonzero(vocab[k] == terms)
    return at, k[at]


class _Postings:
    """Lists of a segment for the terms of a test block, as sorted numbers (term, place)."""

    def __init__(self, batch: pa.RecordBatch, i: int, vocab: np.ndarray):
        self.n = _load(batch, i, "n_words", np.int64)
        self.base = _bases(self.n)
        counts, places = _load(batch, i, "counts", np.uint32).astype(np.int64), _load(batch, i, "places", np.uint32)
        at, self.terms = _common(_load(batch, i, "terms", U), vocab)
        begin = np.concatenate([[0], np.cumsum(counts)])[at]
        self.count = counts[at]
        self.place = places[textkit.ranges(begin, self.count)].astype(np.int64)
        self.key = np.repeat(self.terms, self.count) << 32 | self.place
        self.begin = np.concatenate([[0], np.cumsum(self.count)])

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins, and its length (0: not in the segment)."""
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.begin[k], np.where(self.terms[k] == terms, self.count[k], 0)

    def holds(self, terms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a term stands anywhere from lo to hi (inclusive)."""
        at = np.searchsorted(self.key, terms << 32 | np.maximum(lo, 0))
        found = self.key[np.minimum(at, len(self.key) - 1)]
        return (at < len(self.key)) & (found <= (terms << 32 | np.maximum(hi, 0))) & (hi >= 0)

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1


def _phrases_in(p: _Postings, q: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and place of every exact match in the segment."""
    some = q.of_term[p.terms + 1] - q.of_term[p.terms]
    # phrases whose rarest term is here, each with all places of that term
    phrase = textkit.ranges(q.of_term[p.terms], some)
    each = np.repeat(p.count, some)
    begin = p.place[textkit.ranges(np.repeat(p.begin[:-1], some), each)]
    phrase = np.repeat(phrase, each)
    begin = begin - q.place[phrase, 0]
    for k in range(1, q.place.shape[1]):
        if not len(phrase):
            break
        at = begin + q.place[phrase, k]
        ok = p.holds(q.lookup(phrase, k), at, at)
        phrase, begin = phrase[ok], begin[ok]
    # a phrase may not begin before its document: the margin before a document has no words, so only the first can
    ok = begin >= 0
    return phrase[ok], begin[ok]


MATCHES = "segment long, ord int, doc_id {id}, doc_row long, n_words long, n_hit long, spans binary, items array<string>"
MATCH_NAMES = ["segment", "ord", "doc_id", "doc_row", "n_words", "n_hit", "spans", "items"]


def _ids_type(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def match(index: DataFrame, q: Phrases) -> DataFrame:
    """Phrases in an index of ``build_index``.

    Per document: words inside any occurrence of a phrase, their merged spans, and the items with occurrences.
    """
    shared = index.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        for batch in batches:
            for s in range(batch.num_rows):
                p = _Postings(batch, s, q.vocab)
                phrase, begin = _phrases_in(p, q)
                rows = len(p.n)
                hit = textkit.cover(int(p.base[-1]), begin, q.length[phrase])
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[p.base[1:] - MARGIN] - sums[p.base[:-1]]
                span = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).reshape(-1, 2)
                of = p.doc(span[:, 0])
                cuts = np.searchsorted(of, np.arange(rows + 1))
                span = (span - p.base[of][:, None]).astype(np.uint32)
                pairs = np.unique(np.stack([p.doc(begin), q.item[phrase]], axis=1), axis=0)
                icut = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
                items = [sorted({q.ids[j] for j in pairs[icut[i] : icut[i + 1], 1] if q.ids[j] is not None}) for i in range(rows)]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.asarray(batch.column("segment")[s : s + 1]), rows)), pa.array(np.arange(rows), pa.int32()), batch.column("ids")[s].values,
                        pa.array(_load(batch, s, "rows", np.int64)), pa.array(p.n, pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array([span[cuts[i] : cuts[i + 1]].tobytes() for i in range(rows)], pa.binary()), pa.array(items, pa.list_(pa.string())),
                    ],
                    names=MATCH_NAMES,
                )

    return index.mapInArrow(textkit.frugal(run), MATCHES.format(id=_ids_type(index)))


def _united(many: DataFrame) -> DataFrame:
    """Results of several test blocks as one: spans of a document are united."""
    def unite(t):
        runs = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32).reshape(-1, 2) for x in t["spans"]]).astype(np.int64)
        hit = textkit.cover(int(t["n_words"][0].as_py()), runs[:, 0], runs[:, 1] - runs[:, 0])
        span = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).reshape(-1, 2).astype(np.uint32)
        items = sorted({i for x in t["items"] for i in (x.as_py() or [])})
        return pa.table([*[t[c][:1] for c in MATCH_NAMES[:5]], pa.array([int(hit.sum())], pa.int64()), pa.array([span.tobytes()], pa.binary()), pa.array([items], pa.list_(pa.string()))], names=MATCH_NAMES)

    return many.groupBy("segment", "ord").applyInArrow(unite, many.schema)


def index_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus' index, stored in the shared folder."""
    return stored(build_index(docs, key, text), "index", GROUP_BYTES)


def phrase_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS, index: DataFrame | None = None) -> DataFrame:
    """One row for each document: n_words, n_hit, spans (packed 32-bit begin and end word) and items with occurrences.

    ``index``: of ``index_of`` over the same documents, where there is one already; ``window``: less than MARGIN.
    """
    if not 0 < window < MARGIN:
        raise ValueError(f"window must lie between 1 and {MARGIN - 1}")
    index = index_of(docs, key, text) if index is None else index
    out = []
    for q in item_blocks(items, item_key, item_text, window, block_words):
        q.order(term_counts(index, q.vocab))
        out.append(match(index, q))
    many = out[0]
    for more in out[1:]:
        many = many.unionByName(more)
    return _united(many) if len(out) > 1 else many


def contaminated(n_hit="n_hit", n_words="n_words", share: int = 20):
    """At least one word in ``share`` lies inside an occurrence of a test phrase."""
    return (F.col(n_hit) > 0) & (share * F.col(n_hit) >= F.col(n_words))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` (all columns) that are not contaminated."""
    found = phrase_matches(docs, items, key, text, window=window, block_words=block_words)
    # few documents are contaminated; the planner sees the true size of their table
    gone = stored(found.where(contaminated()).select(F.col("doc_id").alias("_k"), F.col("doc_row").alias("_r")).distinct(), "contaminated")
    row = F.xxhash64(key, text)
    docs, back = shield(docs, key, text)
    return docs.withColumn("_row", row).join(gone, (F.col("_row") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti").drop("_row").withColumnsRenamed(back)


def proximity_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", terms: int = 4, within: int = 30, block_words: int = BLOCK_WORDS, index: DataFrame | None = None) -> DataFrame:
    """(segment, ord, doc_id, item_id, position): a place of the item's rarest term with its next rarest ``terms`` - 1 within ``within`` words on either side.

    Of terms equally rare the one that the item has first counts as rarer.  An item with fewer different terms asks for all of them.
    """
    if not 0 < within < MARGIN:
        raise ValueError(f"within must lie between 1 and {MARGIN - 1}")
    index = index_of(docs, key, text) if index is None else index
    out = None
    for q in item_blocks(items, item_key, item_text, 1, block_words):
        df = term_counts(index, q.vocab)
        some = np.flatnonzero(q.n > 0)
        wanted = np.zeros((len(some), terms), dtype=np.int64)
        for row, i in enumerate(some):
            own, first = np.unique(q.term[q.first[i] : q.first[i + 1]], return_index=True)
            own = own[np.lexsort((first, df[own]))][:terms]
            wanted[row] = np.append(own, np.repeat(own[:1], terms - len(own)))
        shared = index.sparkSession.sparkContext.broadcast((q.vocab, [q.ids[i] for i in some], wanted))

        def run(batches, shared=shared):
            vocab, ids, wanted = shared.value
            for batch in batches:
                for s in range(batch.num_rows):
                    p = _Postings(batch, s, vocab)
                    lo, n = p.lists(wanted[:, 0])
                    item, near = np.repeat(np.arange(len(ids)), n), p.place[textkit.ranges(lo, n)]
                    for k in range(1, wanted.shape[1]):
                        if len(item):
                            ok = p.holds(wanted[item, k], near - within, near + within)
                            item, near = item[ok], near[ok]
                    d = p.doc(near)
                    yield pa.record_batch(
                        [pa.array(np.repeat(np.asarray(batch.column("segment")[s : s + 1]), len(d))), pa.array(d, pa.int32()), batch.column("ids")[s].values.take(pa.array(d, pa.int64())), pa.array([ids[i] for i in item], pa.string()), pa.array(near - p.base[d], pa.int64())],
                        names=["segment", "ord", "doc_id", "item_id", "position"],
                    )

        found = index.mapInArrow(run, f"segment long, ord int, doc_id {_ids_type(index)}, item_id string, position long")
        out = found if out is None else out.unionByName(found)
    return out
