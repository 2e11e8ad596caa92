"""Learned scores, draws, near duplicates and pipeline stages against slow versions that share no code with the operators.

From the operators they take the trained numbers (weights, transitions, calibration) and the parameters.
"""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from kinlink.llm import labels, minhash, mixing, quality, queries, toxicity
from kinlink.llm.scratch import fresh_path

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def marginals(e, trans, first):
    """Probability of label 1 at each position of one chain: forward and backward sums in logarithms."""
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    pot = [(0.0, max(-30.0, min(30.0, x))) for x in e]
    n = len(e)
    fwd, bwd = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
    for i in range(n):
        for y in (0, 1):
            fwd[i][y] = pot[i][y] + (first[y] if i == 0 else add(fwd[i - 1][0] + trans[0][y], fwd[i - 1][1] + trans[1][y]))
    for i in range(n - 2, -1, -1):
        for y in (0, 1):
            bwd[i][y] = add(trans[y][0] + pot[i + 1][0] + bwd[i + 1][0], trans[y][1] + pot[i + 1][1] + bwd[i + 1][1])
    return [1 / (1 + math.exp(min(700, fwd[i][0] + bwd[i][0] - fwd[i][1] - bwd[i][1]))) for i in range(n)]


def logistic(b, *x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + sum(c * v for c, v in zip(b[1:], x, strict=True))))))


def line_bins(line):
    """Bin numbers of a line's measures, in the order of quality.EDGES."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", line)
    symbol = set(range(0x21, 0x7F)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") - set(quality.PROSE)
    n, letters = len(words), len(re.findall(rb"[A-Za-z]", line))
    values = {
        "words": n, "word_bytes": sum(map(len, words)) / n, "upper": len(re.findall(rb"[A-Z]", line)) / max(1, letters), "symbols": sum(b in symbol for b in line) / len(line),
        "digits": len(re.findall(rb"[0-9]", line)) / len(line), "marked_words": sum(w[-1] in symbol for w in words) / n, "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "other_repeats": (n - len(set(words))) / n, "non_ascii": sum(b >= 0x80 for b in line) / len(line),
    }
    return [k * quality.BINS + sum(e < values[name] for e in edges) for k, (name, edges) in enumerate(quality.EDGES.items())]


def quality_score(m, text):
    lines = [x for x in re.split(rb"[\n\r]", (text or "").encode()) if x.strip(b" \t\x0b\x0c")]
    bins, own = [line_bins(x) for x in lines], len(quality.EDGES) * quality.BINS
    e = [m.weights[-1] + sum(m.weights[b] for b in bins[i]) + sum(m.weights[own + b] for b in (bins[i - 1] if i else [])) + sum(m.weights[2 * own + b] for b in (bins[i + 1] if i + 1 < len(bins) else [])) for i in range(len(bins))]
    p = marginals(e, m.trans, m.first)
    good = sum(a * len(x) for a, x in zip(p, lines, strict=True)) / sum(map(len, lines)) if lines else 0.0
    s = min(1 - 1e-4, max(1e-4, good))
    return logistic(m.calibration, math.log(s / (1 - s)), good), len(lines), sum(x >= 0.5 for x in p)


def mixed64(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def byte_hash(w, extra=0):
    raw = sum(b * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w))
    return mixed64((raw + len(w) * 0xD6E8FEB86659FD93 + extra) & M64)


def toxic_score(m, text):
    lower = re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda x: x[0].lower(), text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    e = [float(m.weights[byte_hash(w) >> 46]) + sum(float(m.weights[byte_hash(w[:n], k + 1) >> 46]) for k, n in enumerate(toxicity.PREFIXES)) for w in words]
    p = marginals(e, m.trans, m.first)
    top = min(1 - 1e-6, max([1e-6, *p]))
    return logistic(m.calibration, math.log(top / (1 - top)), math.log1p(sum(x >= 0.5 for x in p)))


ODD = [None, "", " \n ", "x", "A\r\nB b b\n\n\tc!! d$ 12", "ÀÉ Ærø ÿ × ß Þing", "word " * 300, "é" * 999, "!!!", "UPPER CASE\nlower case\n%%%% ####\n" * 20]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_scores(tables):
    docs, known = tables
    m = quality.train(*labels.sample(docs, known, "quality"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.assess(docs, known).collect():
        score, n, good = quality_score(m, text[r["doc_id"]])
        assert abs(r["score"] - score) < 1e-6 and r["n_lines"] == n and r["good_lines"] == good and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_scores(tables):
    docs, known = tables
    m = toxicity.train(*labels.sample(docs, known, "toxic"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.detect(docs, known).collect():
        assert abs(r["score"] - toxic_score(m, text[r["doc_id"]])) < 1e-5 and r["predicted"] == (r["score"] >= 0.5)


def bags(texts):
    """Weighted shingles of each text: count times the mean inverse document frequency of the shingle's words."""
    words = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) for t in texts]
    df = collections.Counter(w for ws in words for w in set(ws))
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for ws in words:
        grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] * bool(ws)
        out.append({g: n * sum(idf[w] for w in g) / len(g) for g, n in collections.Counter(grams).items()})
    return out


def near_pairs(bag, threshold):
    """Pairs of texts of a weighted Jaccard similarity from the threshold on, and their similarities."""
    where = collections.defaultdict(list)
    for i, b in enumerate(bag):
        for g in b:
            where[g].append(i)
    total = [sum(b.values()) for b in bag]
    met = {(i, j) for ids in where.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    out = {}
    for i, j in met:
        low = sum(min(v, bag[j].get(g, 0.0)) for g, v in bag[i].items())
        if low / (total[i] + total[j] - low) >= threshold:
            out[i, j] = low / (total[i] + total[j] - low)
    return out


def test_recall_of_near_duplicates(spark):
    """Every row whose id is divisible by 50, and all others too, against all rows of a larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs = near_pairs(bags([t for _, t in rows]), 0.8)
    of = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    hit = [of[rows[i][0]] == of[rows[j][0]] for i, j in pairs]
    assert len(hit) > 100 and np.mean(hit) >= 0.99
    asked = [h for h, (i, j) in zip(hit, pairs, strict=True) if rows[i][0] % 50 == 0 or rows[j][0] % 50 == 0]
    assert asked and np.mean(asked) >= 0.9


def classes(pairs, n):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def hash60(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:15], 16)


def mixture(rows, r):
    """(words taken, copies) of each row (key, text, source), and the blocks of each source in their permuted order: (block, copies)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    h = [hash60(str(r.seed), "" if k is None else str(k), hashlib.md5((t or "").encode()).hexdigest()) for k, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in names}
    weight, goal, free = {s: r.weights[i % len(r.weights)] for i, s in enumerate(names)}, {}, set(names)
    left = r.share * sum(size)
    while free:
        over = {s for s in free if r.cap * total[s] <= left * weight[s] / sum(weight[x] for x in free)}
        if not over:
            goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        goal |= {s: r.cap * total[s] for s in over}
        left -= sum(goal[s] for s in over)
        free -= over
    taken, blocks = [0] * len(rows), {}
    for s in names:
        mine = [i for i, (*_, x) in enumerate(rows) if x == s]
        nb, words = max(r.least_blocks, -(-len(mine) // r.block_rows)), math.floor(goal[s] + 0.5)
        passes, rest = divmod(words, total[s]) if total[s] else (0, 0)
        order = sorted({h[i] % nb for i in mine}, key=lambda b: (hashlib.md5(f"{r.seed + 2}|{b}".encode()).hexdigest(), b))
        blocks[s] = []
        for b in order:
            part = sorted((i for i in mine if h[i] % nb == b), key=lambda i: (h[i], str(rows[i][0])))
            extra = min(rest, sum(size[i] for i in part))
            rest -= extra
            blocks[s].append((b, (passes + (extra > 0)) * (sum(size[i] for i in part) > 0)))
            for i in part:
                more = min(size[i], extra)
                extra -= more
                taken[i] = passes * size[i] + more
    return size, taken, goal, blocks


def test_draws_of_the_mix(spark):
    r = random.Random(3)
    recipe = mixing.Recipe(block_rows=6, least_blocks=3, shards=5)
    rows = [(i, " ".join("w" * r.randint(0, 25)), r.choice(["a", "a", "b", "é", None, "d"])) for i in range(400)] + [(None, "x y", "a"), (None, "x y", "a"), (1007, None, "z")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, taken int, _size string")
    got = mixing.assign(df, "text", "source", "doc_id", recipe).collect()
    size, taken, goal, blocks = mixture(rows, recipe)
    assert sorted(repr((x["doc_id"], x["source"], x["size"], x["taken"])) for x in got) == sorted(repr((k, s, n, t)) for (k, _, s), n, t in zip(rows, size, taken, strict=True))
    assert all(abs(x["target"] - goal[x["source"]]) < 1e-6 for x in got)
    # a source's copies, in the order of its blocks, fill the shards one after the other
    text = {k: t for k, t, _ in rows}
    per = collections.Counter()
    for s, order in blocks.items():
        nb = max(recipe.least_blocks, -(-sum(x == s for *_, x in rows) // recipe.block_rows))
        seen = []
        for b, copies in order:
            mine = [x["shards"] for x in got if x["source"] == s and hash60(str(recipe.seed), "" if x["doc_id"] is None else str(x["doc_id"]), hashlib.md5((text[x["doc_id"]] or "").encode()).hexdigest()) % nb == b]
            longest = max(mine, key=len)
            assert len(longest) == copies and all(list(x) == list(longest[: len(x)]) for x in mine)
            seen += longest
        assert seen == sorted(seen) and all(0 <= x < recipe.shards for x in seen)
        per.update(seen)
    assert max(per.values()) - min(per.values()) <= 3 * recipe.shards and len(per) == recipe.shards


def shard_of(rows, limit):
    """Shard names by extendible hashing over MD5 prefixes (key, bytes)."""
    h = [int(hashlib.md5((b"\\N" if k is None else str(k).encode())).hexdigest()[:15], 16) for k, _ in rows]
    out = [None] * len(rows)
    todo = [(0, list(range(len(rows))))]
    while todo:
        depth, ids = todo.pop()
        if sum(rows[i][1] for i in ids) <= limit or len(ids) <= 1:
            for i in ids:
                out[i] = f"{depth}:{h[i] >> (60 - depth) if depth else 0}"
            continue
        for bit in (0, 1):
            todo.append((depth + 1, [i for i in ids if h[i] >> (59 - depth) & 1 == bit]))
    return out


def test_every_stage_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(queries, "SHARD_BYTES", 60_000)
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        rows, kept = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], collections.Counter(r["doc_id"] for r in after.collect())
        if name == "quality":
            m = quality.train(*labels.sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality"))
            assert kept == collections.Counter(k for k, t, _ in rows if quality_score(m, t)[0] >= quality.THRESHOLD)
        elif name == "near_duplicates":
            root = classes(near_pairs(bags([t for _, t, _ in rows]), 0.8), len(rows))
            least = {c: min(k for (k, _, _), x in zip(rows, root, strict=True) if x == c) for c in root}
            assert kept == collections.Counter(least.values())
        elif name == "decontamination":
            from test_others import decontaminated  # the test folder is on the path

            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {d for d, n, hit, _ in map(eval, decontaminated([(k, t) for k, t, _ in rows], items)) if hit and 20 * hit >= n}
            assert kept == collections.Counter(k for k, _, _ in rows if k not in bad)
        elif name == "mixing":
            size, taken, _, _ = mixture(rows, mixing.Recipe())
            assert kept == +collections.Counter({k: -(-t // n) if n else 0 for (k, _, _), n, t in zip(rows, size, taken, strict=True)})
            words = collections.Counter()
            for r in after.collect():
                words[r["doc_id"]] += len(r["text"].split())
                assert r["n_chars"] == len(r["text"])
            assert words == +collections.Counter({k: t for (k, _, _), t in zip(rows, taken, strict=True)})
        else:
            want = shard_of([(k, len((t or "").encode())) for k, t, _ in rows], 60_000)
            assert collections.Counter((r["doc_id"], r["shard_id"]) for r in after.collect()) == collections.Counter((k, w) for (k, _, _), w in zip(rows, want, strict=True))
        seen[name] = sum(kept.values())
        docs = after
    assert list(seen) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"] and seen["quality"] > seen["near_duplicates"] > seen["decontamination"]
