"""String kernels against plain definitions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.functions import similarity as S

texts = st.text(alphabet="abc é", max_size=14)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    a, b = sorted((a, b), key=len)

    def best(a, b):
        return max([ratio(a, b[s : s + len(a)]) for s in range(len(b))] + [ratio(a, b[:k]) for k in range(1, len(a))])

    return max(best(a, b), best(b, a)) if len(a) == len(b) else best(a, b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=8))
def test_kernels_follow_their_definitions(pairs):
    assert np.allclose(S.ratios(pairs), [ratio(*p) for p in pairs])
    assert np.allclose(S.partial_ratios(pairs), [partial(*p) for p in pairs])


def test_long_texts_take_the_integer_path():
    pairs = [("ab c" * 25, "b ca" * 30), ("x" * 70, "x" * 71)]
    assert np.allclose(S.ratios(pairs), [ratio(*p) for p in pairs])
    assert np.allclose(S.partial_ratios(pairs), [partial(*p) for p in pairs])


def test_known_values():
    assert np.allclose(S.jaro_winklers([("martha", "marhta"), ("dwayne", "duane"), ("", ""), ("a", "")]), [0.961111, 0.84, 1.0, 0.0], atol=1e-6)
    assert np.allclose(S.token_set_ratios([("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("", "x")]), [1.0, 0.0])
    assert np.allclose(S.token_sort_ratios([("b a", "a b")]), [1.0])
    assert S.weighted_ratios([("", "x"), ("acme", "acme")]).tolist() == [0.0, 1.0]


def test_as_columns_and_in_sql(spark):
    S.register(spark)
    df = spark.createDataFrame([("acme", "acme corp"), (None, "x")], "a string, b string")
    got = df.select(S.similarity("fuzz_ratio", F.col("a"), F.col("b")).alias("r"), S.similarities(["partial_ratio", "wratio"], F.col("a"), F.col("b")).alias("s")).collect()
    assert round(got[0]["r"], 4) == 0.6154 and got[0]["s"]["partial_ratio"] == 1.0 and got[1]["r"] == 0.0
    df.createOrReplaceTempView("pairs")
    assert round(spark.sql("SELECT jaro_winkler(a, b) j FROM pairs WHERE a IS NOT NULL").first()["j"], 2) == 0.89


def test_soundex(spark):
    rows = spark.createDataFrame([("robert",), ("rupert",), ("7up",)], "w string").select(S.soundex(F.col("w")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["R163", "R163", "7up"]
