"""Repeated passages, substring dedup, near duplicates and embeddings against brute force, with odd rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from kinlink.llm import components, cover_dedup, embed_dedup, exchange, minhash, suffix_dedup, textkit


def corpus(seed, n=60):
    """Texts that share passages, with copies, near copies, self-repeats, odd white space and odd rows."""
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passages = [[r.choice(words) for _ in range(r.randint(20, 90))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 3)
            w[at:at] = p[cut:]
        docs.append((i, r.choice([" ", "\n", "  ", "\t"]).join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "tail " * 200), (n + 4, docs[0][1]), (n + 5, docs[0][1]), (n + 5, docs[0][1]), (None, docs[1][1])]
    docs.append((n + 6, " ".join(r.choice(words) for _ in range(30000))))
    return docs


def frame(spark, docs):
    # clashing and extra columns must not matter
    return spark.createDataFrame([(a, b, "x", 7) for a, b in docs], "doc_id long, text string, slice string, n_words int")


def repeated(docs, size):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen = collections.Counter(tuple(w[i : i + size]) for _, w in words for i in range(len(w) - size + 1))
    for d, w in words:
        mask = bytearray(len(w))
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                mask[i : i + size] = b"\1" * size
        yield d, w, mask


@pytest.mark.parametrize("window", [35, 6, 1])
def test_substring_dedup(spark, window):
    docs = corpus(window)
    got = sorted(map(repr, (tuple(r) for r in cover_dedup.substring_dedup(frame(spark, docs), window=window).collect())))
    want = sorted(repr((d, len(w), sum(m), b" ".join(x for x, k in zip(w, m, strict=True) if not k).decode())) for d, w, m in repeated(docs, window))
    assert got == want


def test_covers_are_difference_covers():
    for v, cover in cover_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("size,gram", [(50, 10), (24, 4)])
def test_repeated_passages(spark, size, gram):
    docs = corpus(size)
    got = sorted(map(repr, (tuple(r) for r in suffix_dedup.repeated_passages(frame(spark, docs), min_words=size, gram=gram).collect())))
    want = []
    for d, w, m in repeated(docs, size):
        i = 0
        while i < len(m):
            j = i
            while j < len(m) and m[j]:
                j += 1
            if j > i:
                want.append(repr((d, len(w), i, j - i)))
            i = max(j, i + 1)
    assert got == sorted(want)


def spans_of(rows, size):
    out = []
    for d, w, m in repeated(rows, size):
        edge = [0, *m, 0]
        starts, ends = ([i for i in range(len(edge) - 1) if (edge[i], edge[i + 1]) == x] for x in ((0, 1), (1, 0)))
        out += [repr((d, len(w), a, b - a)) for a, b in zip(starts, ends, strict=True)]
    return sorted(out)


@pytest.mark.parametrize("many", [1, 3, 64])
def test_a_frequent_run_in_many_contexts(spark, monkeypatch, many):
    """A run of words in every text, with different words around, and passages that hold it; many small slices."""
    monkeypatch.setattr(exchange, "SLICE_BYTES", 2000)
    monkeypatch.setattr(exchange, "MOST_SLICE_BYTES", 2000)
    r = random.Random(8)
    run = [f"r{i}" for i in range(12)]
    long = [f"p{i}" for i in range(20)] + run + [f"q{i}" for i in range(20)]
    docs = []
    for i in range(120):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(30)]
        w[15:15] = long[r.randint(0, 9) :][: r.randint(35, 52)] if i % 3 == 0 else run
        docs.append((i, " ".join(w)))
    got = suffix_dedup.repeated_passages(frame(spark, docs), min_words=24, gram=6, many=many)
    assert sorted(repr(tuple(x)) for x in got.collect()) == spans_of(docs, 24)


def test_many_equal_rows(spark, monkeypatch):
    """More rows alike in id and text than go through as they are."""
    monkeypatch.setattr(exchange, "REPEATS", 3)
    text = [" ".join(f"{a}{i}" for i in range(60)) for a in "xyz"]
    docs = [(1, text[0])] * 50 + [(None, text[1])] * 9 + [(3, None)] * 7 + [(4, text[2] + " " + text[0]), (5, text[2][:100])] + [(6, text[2])] * 2
    got = sorted(map(repr, (tuple(x) for x in cover_dedup.substring_dedup(frame(spark, docs)).collect())))
    assert got == sorted(repr((d, len(w), sum(m), b" ".join(x for x, k in zip(w, m, strict=True) if not k).decode())) for d, w, m in repeated(docs, 35))
    assert sorted(repr(tuple(x)) for x in suffix_dedup.repeated_passages(frame(spark, docs)).collect()) == spans_of(docs, 50)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert cover_dedup.substring_dedup(none).count() == 0 and suffix_dedup.repeated_passages(none).count() == 0
    assert minhash.classes(none).count() == 0
    assert embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def near_corpus(seed):
    r = random.Random(seed)
    base = [[f"b{k}x{r.randint(0, 10**6)}" for _ in range(120)] for k in range(4)]
    docs = []
    for i in range(80):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(1, 60)))) for i in range(20)]
    return docs + [(200, None), (201, ""), (202, "?!"), (203, "One two"), (204, "one, TWO!"), (205, docs[3][1]), (205, docs[3][1]), (None, docs[4][1])]


def brute_classes(spark, docs):
    df = frame(spark, docs)
    idf = minhash.inverse_frequencies(df, "text")
    s = minhash.Shingles(*textkit.column_bytes(pa.array([t or "" for _, t in docs])), idf)
    bag = [dict(zip(s.hash[a:b].tolist(), s.weight[a:b].tolist(), strict=True)) for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            low = sum(min(v, bag[j].get(k, 0)) for k, v in bag[i].items())
            every = sum(bag[i].values()) + sum(bag[j].values()) - low
            if every and low / every >= 0.8:
                up[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(repr((d, min(ids[find(i)], default=None))) for i, (d, _) in enumerate(docs))


def test_near_duplicates(spark, monkeypatch):
    docs = near_corpus(3)
    want = brute_classes(spark, docs)
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in minhash.classes(frame(spark, docs)).collect()) == want
    # the same with buckets in many blocks
    monkeypatch.setattr(minhash, "BLOCK", 5)
    assert sorted(repr((r["doc_id"], r["class_id"])) for r in minhash.classes(frame(spark, docs)).collect()) == want


def test_keep_one_leaves_one_of_each_class(spark):
    docs = near_corpus(4)
    df = frame(spark, docs)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    rows = [r["doc_id"] for r in kept.collect()]
    classes = {r["class_id"] for r in minhash.classes(df).collect()}
    assert sorted(rows) == sorted(classes)


def test_keep_one_of_null_and_repeated_ids(spark):
    words = " ".join(f"x{i}" for i in range(60))
    near = words + " more"
    rows = [(None, words), (None, words), (None, near), (7, "alone here now"), (8, words.replace("x", "y")), (8, near.replace("x", "y")), (8, words.replace("x", "y")), (9, ""), (9, ""), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, rows)).collect()]
    assert len([1 for d, t in kept if t and t.startswith("x")]) == 1 and len([1 for d, t in kept if t and t.startswith("y")]) == 1
    assert sorted((d is None, d, t) for d, t in kept if not t or t.startswith("alone")) == [(False, 7, "alone here now"), (False, 9, ""), (False, 9, ""), (True, None, None)]


def test_ids_of_any_type(spark):
    docs = [(f"d{i}", t) for i, (_, t) in enumerate(near_corpus(5))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    numbers = {f"d{i}": i for i in range(len(docs))}
    ids = spark.createDataFrame([(numbers[d], t) for d, t in docs], "doc_id long, text string")
    kept = lambda f: {r["text"] for r in minhash.keep_one(f).collect()}
    assert len(kept(df)) == len(kept(ids))
    for run in (lambda f: cover_dedup.substring_dedup(f, window=20), lambda f: suffix_dedup.repeated_passages(f, min_words=20, gram=8)):
        assert sorted((numbers[r[0]], *r[1:]) for r in run(df).collect()) == sorted(map(tuple, run(ids).collect()))
    x = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), (None, None)], "vec_id string, embedding array<float>")
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.link(x).collect()} == {("b", 1, "a"), ("a", 1, "a"), (None, 0, None)}


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    idf = rng.uniform(1, 6, 1 << minhash.SLOT_BITS).astype(np.float32)
    error = []
    for _ in range(25):
        w = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        v = [x if rng.random() > 0.05 else f"e{rng.integers(1e9)}" for x in w]
        s = minhash.Shingles(*textkit.column_bytes(pa.array([" ".join(w), " ".join(v)])), idf)
        g = minhash.sample(s, 256)
        a, b = (dict(zip(s.hash[x:y].tolist(), s.weight[x:y].tolist(), strict=True)) for x, y in zip(s.first[:-1], s.first[1:], strict=True))
        low = sum(min(x, b.get(k, 0)) for k, x in a.items())
        error.append((g[0] == g[1]).mean() - low / (sum(a.values()) + sum(b.values()) - low))
    assert abs(np.mean(error)) < 0.02


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = [c + rng.normal(size=16) * s for c in centres for s in (0, 0.05, 0.05, 0.1, 0.2)]
    x += [x[0]] * 9 + [2 * x[0]]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [], 1), (504, [1.0], 1), (None, rows[0][1], 1), (505, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, table int")
    u = np.array([r[1] for r in rows + [odd[5]]], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = [r[0] for r in rows] + [None]
    want = {ids[i]: (int(near[i].sum()) - 1, min(j for j, k in zip(ids, reach[i], strict=True) if k and j is not None)) for i in range(len(ids))}
    want |= {k: (0, k) for k in (500, 501, 502, 503, 504, 505)}
    for block in (2048, 3):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.link(df).collect()}
        assert got == want


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 140), r.randint(100, 140)) for _ in range(30)] + [(7, 7), (3, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_word_hashes_do_not_depend_on_neighbours():
    texts = ["a bb", "", "bb", "ccc a", "é" * 200000 + " a"]
    w = textkit.Words(*textkit.column_bytes(pa.array(texts)), textkit.NON_BLANK)
    assert w.n.tolist() == [2, 0, 1, 2, 2]
    h = w.hash.tolist()
    assert h[0] == h[4] == h[6] and h[1] == h[2] and len(set(h)) == 4
    assert hashlib.sha256(b"").hexdigest() == textkit.sha256(b"")


def test_null_and_sliced_columns():
    col = pa.array(["zz", None, "a b", "c"]).slice(1, 2)
    w = textkit.Words(*textkit.column_bytes(col), textkit.ALNUM)
    assert w.n.tolist() == [0, 2]
    parts = list(textkit.pieces(pa.array(["x" * 10] * 5), budget=25))
    assert [(lo, hi) for lo, hi, _, _ in parts] == [(0, 2), (2, 4), (4, 5)]
