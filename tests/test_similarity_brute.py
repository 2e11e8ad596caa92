"""All 33 features of every candidate pair, and the similarities, against slow definitions."""

import random

import numpy as np
import pytest

from kinlink.functions import similarity as S
from kinlink.operators import blocking as B
from kinlink.operators import features, prepare
from kinlink.plans import registry


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    out = 0.0
    for x, y in ((short, long), (long, short)) if len(a) == len(b) else ((short, long),):
        for i in range(1 - len(x), len(y)):
            part = y[max(0, i) : i + len(x)]
            if part:
                out = max(out, ratio(x, part))
    return out


def by_word(x):
    return " ".join(sorted(x.split()))


def rests(a, b):
    x, y = set(a.split()), set(b.split())
    return [" ".join(sorted(z)) for z in (x & y, x - y, y - x)]


def token_set(a, b):
    both, x, y = rests(a, b)
    if not a.split() or not b.split():
        return 0.0
    if both and not (x and y):
        return 1.0
    one, two = f"{both} {x}".strip(), f"{both} {y}".strip()
    # the differing words are compared alone; what both share counts as equal
    distance = len(x) + len(y) - 2 * lcs(x, y)
    out = 1 - distance / (len(one) + len(two))
    return max(out, ratio(both, one), ratio(both, two)) if both else out


def weighted(a, b):
    if not a or not b:
        return 0.0
    whole, gap = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if gap < 1.5:
        return max(whole, 0.95 * ratio(by_word(a), by_word(b)), 0.95 * token_set(a, b))
    scale = 0.9 if gap <= 8 else 0.6
    both, x, y = rests(a, b)
    shared = 0.0 if not a.split() or not b.split() else 1.0 if both else partial(x, y)
    return max(whole, scale * partial(a, b), 0.95 * scale * partial(by_word(a), by_word(b)), 0.95 * scale * shared)


def jaro_winkler(a, b):
    if not a or not b:
        return float(a == b)
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == x), None)
        if j is not None:
            used.add(j)
            left.append(x)
    if not left:
        return 0.0
    m, right = len(left), [b[j] for j in sorted(used)]
    out = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3
    prefix = next((k for k in range(5) if k == 4 or k >= min(len(a), len(b)) or a[k] != b[k]))
    return out + 0.1 * prefix * (1 - out) if out > 0.7 else out


SLOW = {"fuzz_ratio": ratio, "partial_ratio": partial, "token_sort_ratio": lambda a, b: ratio(by_word(a), by_word(b)), "token_set_ratio": token_set, "wratio": weighted, "jaro_winkler": jaro_winkler}


@pytest.mark.parametrize("name", list(SLOW))
def test_kernels(name):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("ab cdé") for _ in range(r.randint(0, n)))
    pairs = [(text(n), text(m)) for n, m in ((9, 9), (30, 30), (70, 20), (150, 8), (90, 160), (160, 160), (64, 64), (65, 130)) for _ in range(12)]
    pairs += [(a, a[5:] + "x") for a, _ in pairs[:40]] + [("", ""), ("", "a"), (" ", "a b"), ("a" * 200, "a" * 129)]
    assert np.allclose(S.KERNELS[name](pairs), [SLOW[name](a, b) for a, b in pairs])


def soundex(w):
    code = {c: d for d, cs in enumerate(("aeiouy", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in cs}
    if not w[:1].isascii() or not w[:1].isalpha():
        return w
    out, last = w[0].upper(), code.get(w[0])
    for c in w[1:]:
        if c in "hw":
            continue
        d = code.get(c, 0)
        if d and d != last:
            out += str(d)
        last = d
    return (out + "000")[:4]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def all_features(score, one, two):
    (n1, a1, c1, _), (n2, a2, c2, s2) = one, two
    w1, w2, x1, x2 = (set(t.split()) for t in (n1, n2, a1, a2))
    d1, d2 = ({w for w in x if w.isdigit()} for x in (x1, x2))
    p1, p2 = ({w for w in d if len(w) in (5, 6)} for d in (d1, d2))
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    f1, f2 = n1.split(" ")[0], n2.split(" ")[0]
    name, addr = ({k: f(a, b) for k, f in SLOW.items()} for a, b in ((n1, n2), (a1, a2)))
    lengths = lambda a, b: [abs(len(a) - len(b)), min(len(a), len(b)) / max(len(a), len(b), 1)]
    return [
        score, float(c1 == c2) if c1 and c2 else 1.0, float(s2 == "S2"), *lengths(n1, n2), *lengths(a1, a2),
        *[name[k] for k in ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "wratio", "jaro_winkler")],
        *[addr[k] for k in ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "jaro_winkler")],
        jaccard(w1, w2), share(w1, w2), jaccard(x1, x2), share(x1, x2), jaccard(grams(n1), grams(n2)),
        len(d1 & d2), float(bool(d1 and d2 and not d1 & d2)), jaccard(d1, d2), float(bool(p1 & p2)), float(bool(p1 and p2 and not p1 & p2)),
        float(f1 != "" and f1 == f2), jaro_winkler(f1, f2) if f1 and f2 else 0.0, float(f1 != "" and f2 != "" and soundex(f1) == soundex(f2)),
        name["token_set_ratio"] * addr["token_set_ratio"], name["jaro_winkler"] * addr["jaro_winkler"],
    ]


def test_all_features_of_all_candidates(spark):
    r = random.Random(9)
    words = ["Blue", "Café", "Mill", "tools", "Ltd", "S.A.", "Œuvre", "x", "Inc", "Harbour and Sons", "12"]
    rows = [(("S1", "S2", "S3")[i % 3], f"S{1 + i % 3}-{i}", " ".join(r.choices(words, k=r.randint(0, 5))), f"{r.randint(1, 30)} {r.choice(words)} Street {r.choice(words)} {r.choice(['', '12345', '560001', '9'])}" if i % 7 else None, r.choice(["", "US", None, "India"])) for i in range(150)]
    rows += [("S1", "S1-900", "Blue " * 40, "Mill " * 60, "US"), ("S2", "S2-901", "blue " * 39, "mill tools " * 30, "US")]
    records = prepare.spread(prepare.prepare(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")))
    of = {x["entity_id"]: (x["name_norm"], x["addr_norm"], x["country"], x["source"]) for x in records.collect()}
    pairs = B.block(records)
    score = {(x["s1_id"], x["target_id"]): x["score"] for x in pairs.collect()}
    got = features.features(pairs, records).collect()
    assert {(x["s1_id"], x["target_id"]) for x in got} == set(score) and len(got) > 500
    for x in got:
        want = all_features(score[x["s1_id"], x["target_id"]], of[x["s1_id"]], of[x["target_id"]])
        assert np.allclose([x[f] for f in features.FEATURES], want, atol=1e-5), (x, want)


def test_registered_similarities(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").orderBy("p_partkey").limit(30).write.parquet(str(tmp_path / "part.parquet"))
    of = {x["entity_id"]: (x["name_norm"], x["addr_norm"]) for x in registry._records(spark, str(tmp_path)).collect()}
    for x in registry.fuzz_ratios(spark, str(tmp_path)).collect():
        (n1, a1), (n2, a2) = of[x["s1_id"]], of[x["target_id"]]
        for k in ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"):
            assert abs(x[f"name_{k}"] - SLOW[k](n1, n2)) < 1e-5 and abs(x[f"addr_{k}"] - SLOW[k](a1, a2)) < 1e-5
    for x in registry.wratio(spark, str(tmp_path)).collect():
        assert abs(x["name_wratio"] - weighted(of[x["s1_id"]][0], of[x["target_id"]][0])) < 1e-5
