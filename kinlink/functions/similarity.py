"""String similarities that Spark lacks, as Arrow-batched functions.

A batch's distinct pairs are compared at once: the longest common subsequence of all of them advances one character at a
time in 64-bit words (a bit for each character of the shorter text, several words for long texts), for all windows of the
longer text side by side.  Jaro's matching walks the first text in the same way, over the free places of the second.

``ratio`` = 2 LCS / (length sum); ``partial_ratio`` = best ratio of the shorter text with a window of the longer one;
the token forms compare sorted tokens and token sets; all between 0 and 1.  Defined by their public descriptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
_ROWS = 2000
#: Places compared at once, about: a bound of memory, not of texts.
_CELLS = 1 << 26


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of each text in a row, zero after its end (a NUL inside a text counts as another rare character)."""
    safe = [t.replace(chr(0), "\U0010ffff") for t in texts]
    return np.array(safe, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(texts), -1)


def _hits(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each character of the longer text the bits of its places in the shorter one: (pair, character, word)."""
    n, w = short.shape
    wide = np.zeros((n, -(-w // WORD) * WORD), dtype=np.uint32)
    wide[:, :w] = short
    out = np.empty((n, long.shape[1], wide.shape[1] // WORD), dtype=np.uint64)
    step = max(1, _CELLS // wide.size)
    for lo in range(0, long.shape[1], step):
        some = long[:, lo : lo + step, None]
        same = (wide[:, None, :] == some) & (some != 0)
        out[:, lo : lo + step] = np.packbits(same, axis=2, bitorder="little").view(np.uint64)
    return out


def _stretches(length: list[int]) -> Iterator[slice]:
    """Pairs that are compared at once, of ascending length: what they take grows as the square of it."""
    lo = 0
    while lo < len(length):
        hi = min(len(length), lo + _ROWS)
        while hi > lo + 1 and (hi - lo) * length[hi - 1] ** 2 > _CELLS:
            hi = (lo + hi) // 2
        yield slice(lo, hi)
        lo = hi


def _step(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(v + u) | (v - u) for u = v & m; the sum carries from word to word."""
    u = v & m
    total = v + u
    if v.shape[-1] > 1:
        carry = total[..., 0] < u[..., 0]
        for k in range(1, v.shape[-1]):
            more = total[..., k] + carry
            carry = (total[..., k] < u[..., k]) | (more < carry)
            total[..., k] = more
    return total | (v - u)


def _many(pairs: list[tuple[str, str]], partial: bool) -> np.ndarray:
    """ratio, or partial_ratio, of every pair."""
    out = np.zeros(len(pairs))
    wide: list[int] = []
    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            out[i] = 1.0 if a == b else 0.0
        elif a == b:
            out[i] = 1.0
        else:
            wide.append(i)
    # pairs of like length together, so that little is padded
    wide.sort(key=lambda i: max(len(pairs[i][0]), len(pairs[i][1])))
    for part in _stretches([max(map(len, pairs[i])) for i in wide]):
        at = np.array(wide[part])
        ab = [sorted(pairs[i], key=len) for i in at]
        short, long = [x[0] for x in ab], [x[1] for x in ab]
        s = _codes(short, max(map(len, short)))
        g = _codes(long, max(map(len, long)))
        ns, ng = np.array([len(x) for x in short]), np.array([len(x) for x in long])
        out[at] = _windows(s, g, ns, ng) if partial else _whole(s, g, ns, ng)
        if partial and (ns == ng).any():
            even = np.flatnonzero(ns == ng)
            out[at[even]] = np.maximum(out[at[even]], _windows(g[even][:, : s.shape[1]], s[even], ng[even], ns[even]))
    return out


def _common(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~v).sum(axis=-1, dtype=np.int64)


def _whole(s: np.ndarray, g: np.ndarray, ns: np.ndarray, ng: np.ndarray) -> np.ndarray:
    m = _hits(s, g)
    v = np.full((len(s), m.shape[2]), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(m.shape[1]):
        v = _step(v, m[:, k])
    return 2.0 * _common(v) / (ns + ng)


def _windows(s: np.ndarray, g: np.ndarray, ns: np.ndarray, ng: np.ndarray) -> np.ndarray:
    m, width, size = _hits(s, g), g.shape[1], s.shape[1]
    padded = np.concatenate([m, np.zeros((len(m), size, m.shape[2]), dtype=np.uint64)], axis=1)
    v = np.full((len(s), width, m.shape[2]), np.iinfo(np.uint64).max, dtype=np.uint64)
    best = np.zeros(len(s))
    for k in range(size):
        # windows of the shorter text's length at every start; beyond it they stand still
        v = np.where((k < ns)[:, None, None], _step(v, padded[:, k : k + width]), v)
        # so far the first window is a prefix of the longer text
        best = np.maximum(best, np.where(k < ns, 2.0 * _common(v[:, 0]) / (ns + np.minimum(k + 1, ng)), 0.0))
    start = np.arange(width)
    length = np.clip(ng[:, None] - start, 0, ns[:, None])
    ratio = np.where(length > 0, 2.0 * _common(v) / (ns[:, None] + length), 0.0)
    return np.maximum(best, ratio.max(axis=1))


def _distinct(a: Iterable[str], b: Iterable[str]) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The distinct pairs of two columns, and each row's place among them."""
    number: dict[tuple[str, str], int] = {}
    at = np.array([number.setdefault((x or "", y or ""), len(number)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    return list(number), at


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return _many(pairs, False)


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return _many(pairs, True)


def _sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_sort_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    return ratios([(_sorted(a), _sorted(b)) for a, b in pairs])


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Best of (shared, shared+a), (shared, shared+b), (shared+a, shared+b); 1 if one set holds the other, 0 if one is empty."""
    parts = [_sets(a, b) for a, b in pairs]
    rests = ratios([(p[1], p[2]) for p in parts])
    out = np.zeros(len(pairs))
    for i, ((a, b), (both, x, y)) in enumerate(zip(pairs, parts, strict=True)):
        if not a.split() or not b.split():
            continue
        if both and (not x or not y):
            out[i] = 1.0
            continue
        s, gap = len(both), bool(both)
        sx, sy = s + gap + len(x), s + gap + len(y)
        apart = (len(x) + len(y)) * (1 - rests[i])
        out[i] = 1 - apart / (sx + sy)
        if both:
            out[i] = max(out[i], 1 - (gap + len(x)) / (s + sx), 1 - (gap + len(y)) / (s + sy))
    return out


def weighted_ratios(pairs: list[tuple[str, str]], made: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Weighted best of the ratios: token forms count 0.95; from a length ratio of 1.5 on partial forms count 0.9, beyond 8 0.6.

    ``made``: other KERNELS' values of the same pairs.
    """
    made = made or {}
    whole, ordered, sets = (made[n] if n in made else KERNELS[n](pairs) for n in ("fuzz_ratio", "token_sort_ratio", "token_set_ratio"))
    tokens = np.maximum(ordered, sets)
    out = np.zeros(len(pairs))
    far: list[int] = []
    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        if max(len(a), len(b)) / min(len(a), len(b)) < 1.5:
            out[i] = max(whole[i], 0.95 * tokens[i])
        else:
            far.append(i)
    if far:
        some = [pairs[i] for i in far]
        part = made["partial_ratio"][far] if "partial_ratio" in made else partial_ratios(some)
        part_sorted = partial_ratios([(_sorted(a), _sorted(b)) for a, b in some])
        rests = [_sets(a, b) for a, b in some]
        part_set = np.where([bool(r[0]) for r in rests], 1.0, partial_ratios([(r[1], r[2]) for r in rests]))
        empty = np.array([not a.split() or not b.split() for a, b in some])
        part_set[empty] = 0.0
        for k, i in enumerate(far):
            a, b = some[k]
            scale = 0.9 if max(len(a), len(b)) / min(len(a), len(b)) <= 8.0 else 0.6
            out[i] = max(whole[i], part[k] * scale, max(part_sorted[k], part_set[k]) * 0.95 * scale)
    return out


def jaro_winklers(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Jaro similarity; above 0.7 a tenth of what is missing is added for each of up to four equal leading characters.

    Two empty texts: 1; one empty: 0.
    """
    out = np.array([1.0 if a == b else 0.0 for a, b in pairs])
    some = sorted((i for i, (a, b) in enumerate(pairs) if a and b and a != b), key=lambda i: max(map(len, pairs[i])))
    for part in _stretches([max(map(len, pairs[i])) for i in some]):
        at = some[part]
        left, right = [pairs[i][0] for i in at], [pairs[i][1] for i in at]
        out[at] = _jaro_winkler(_codes(left, max(map(len, left))), _codes(right, max(map(len, right))), np.array([len(x) for x in left]), np.array([len(x) for x in right]))
    return out


def _between(lo: np.ndarray, hi: np.ndarray, words: int) -> np.ndarray:
    """Bits lo to hi (exclusive) of each row, in words."""
    ones = np.uint64(np.iinfo(np.uint64).max)
    first = np.arange(words) * WORD

    def below(n: np.ndarray) -> np.ndarray:
        k = np.clip(n[:, None] - first, 0, WORD)
        return np.where(k == 0, np.uint64(0), ones >> (WORD - np.maximum(k, 1)).astype(np.uint64))

    return below(hi) & ~below(lo)


def _jaro_winkler(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    places = _hits(b, a)
    n, words = len(a), places.shape[2]
    reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
    free = _between(np.zeros(n, dtype=np.int64), nb, words)
    matched = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        can = places[:, i] & free & _between(np.clip(i - reach, 0, nb), np.clip(i + reach + 1, 0, nb), words)
        open_ = np.ones(n, dtype=bool)
        for k in range(words):  # the lowest free place, in the first word that has one
            low = np.where(open_, can[:, k] & (~can[:, k] + np.uint64(1)), np.uint64(0))
            free[:, k] ^= low
            open_ &= low == 0
        matched[:, i] = ~open_
    used = np.unpackbits((_between(np.zeros(n, dtype=np.int64), nb, words) ^ free).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, : b.shape[1]].astype(bool)
    m = matched.sum(axis=1)
    width = max(1, int(m.max()))
    # matched characters of both texts in order, to the left
    first = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), axis=1)[:, :width]
    second = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), axis=1)[:, :width]
    swapped = ((first != second) & (np.arange(first.shape[1]) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / na + m / nb + (m - swapped) / some) / 3, 0.0)
    size = min(4, a.shape[1], b.shape[1])
    same = (a[:, :size] == b[:, :size]) & (a[:, :size] != 0)
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


KERNELS: dict[str, Callable[[list[tuple[str, str]]], np.ndarray]] = {
    "fuzz_ratio": ratios,
    "partial_ratio": partial_ratios,
    "token_sort_ratio": token_sort_ratios,
    "token_set_ratio": token_set_ratios,
    "wratio": weighted_ratios,
    "jaro_winkler": jaro_winklers,
}


def several(names: list[str], pairs: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Several of KERNELS over the same pairs; the weighted ratio takes the others' values where they are asked for too."""
    made = {n: KERNELS[n](pairs) for n in names if n != "wratio"}
    if "wratio" in names:
        made["wratio"] = weighted_ratios(pairs, made)
    return made


def _udf(fn: Callable[[list[tuple[str, str]]], np.ndarray]):
    @F.arrow_udf(T.DoubleType())
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs, at = _distinct(a.to_pylist(), b.to_pylist())
        return pa.array(fn(pairs)[at] if pairs else np.zeros(0))

    return compare


def similarity(name: str, a: Column, b: Column) -> Column:
    """One of KERNELS over two text columns."""
    return _udf(KERNELS[name])(a, b)


def similarities(names: list[str], a: Column, b: Column) -> Column:
    """Several of KERNELS at once, as a struct: the texts cross to Python once."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.arrow_udf(schema)
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs, at = _distinct(a.to_pylist(), b.to_pylist())
        made = several(names, pairs) if pairs else dict.fromkeys(names, np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(made[n][at] if pairs else made[n]) for n in names], names=names)

    return compare(a, b)


def register(spark: SparkSession) -> None:
    """Make the similarities SQL functions of the session."""
    for name, fn in KERNELS.items():
        spark.udf.register(name, _udf(fn))


def soundex(x: Column) -> Column:
    """Soundex code of a word; a word that does not begin with a letter is its own code."""
    return F.soundex(x)
