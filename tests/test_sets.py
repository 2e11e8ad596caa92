"""Sets of the pair features: once for a pair, without lambdas, equal to the slow definitions; and kernels that share their work."""

import numpy as np
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import text as X
from kinlink.operators import features

TEXTS = ["", "a", "abc", "abcd abcd", "12 x 12345 123456 a1 1234567 12", "  two  blanks ", "\U00020000\U00020001\U00020000\U00020001 \U00020000", "é日本語 é日本語", "7 7", "99999"]


def test_sets_are_those_of_the_text_functions(spark):
    rows = [(a, b, b, a, "", "US", "S2") for a in TEXTS for b in TEXTS]
    p = features.with_sets(spark.createDataFrame(rows, "name1 string, name2 string, addr1 string, addr2 string, country1 string, country2 string, source2 string"))
    words = lambda x: F.array_distinct(X.split_words(F.col(x)))
    digits = lambda x: F.filter(words(x), X.is_number)
    want = {
        "name_token_jaccard": X.jaccard(words("name1"), words("name2")),
        "name_token_overlap": X.overlap(words("name1"), words("name2")),
        "addr_token_jaccard": X.jaccard(words("addr1"), words("addr2")),
        "addr_token_overlap": X.overlap(words("addr1"), words("addr2")),
        "name_3gram_jaccard": X.jaccard(X.char_3gram_set(F.col("name1")), X.char_3gram_set(F.col("name2"))),
        "number_jaccard": X.jaccard(digits("addr1"), digits("addr2")),
        "num_shared_numbers": F.size(F.array_intersect(digits("addr1"), digits("addr2"))).cast("double"),
    }
    made = features.set_features()
    for r in p.select("name1", "name2", *[made[n].alias(n) for n in want], *[c.alias(f"want_{n}") for n, c in want.items()]).collect():
        for n in want:
            assert r[n] == r[f"want_{n}"], (n, r)
    postal = lambda x: F.filter(digits(x), lambda w: F.length(w).isin(5, 6))
    for r in p.select("_p1", postal("addr1").alias("p"), "_d1", digits("addr1").alias("d"), F.col("_g1"), X.char_3gram_set(F.col("name1")).alias("g")).collect():
        assert r["_p1"] == r["p"] and r["_d1"] == r["d"] and r["_g1"] == r["g"]


def test_sets_are_made_once_and_not_interpreted(spark):
    rows = spark.createDataFrame([("a",) * 7], "name1 string, name2 string, addr1 string, addr2 string, country1 string, country2 string, source2 string")
    plan = features.with_sets(rows).select(*features.set_features().values())._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("split(name1") == 1 and plan.count("array_intersect(") == 4


def test_weighted_ratio_takes_what_is_made(monkeypatch):
    pairs = [("red iron works", "iron works red"), ("ab", "ab cd ef gh"), ("", "x"), ("same", "same")]
    want = S.weighted_ratios(pairs)
    calls = []
    for n in ("fuzz_ratio", "token_sort_ratio", "token_set_ratio"):
        monkeypatch.setitem(S.KERNELS, n, lambda p, n=n, f=S.KERNELS[n]: calls.append(n) or f(p))
    made = S.several(list(S.KERNELS), pairs)
    assert np.array_equal(made["wratio"], want) and len(calls) == len(set(calls)) == 3
