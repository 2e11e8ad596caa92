"""Hand-computed vectors of the normalization and token functions."""

import pytest
from pyspark.sql import functions as F

from kinlink.functions import alt_text as A
from kinlink.functions import text as X
from kinlink.functions import vocabulary as V
from kinlink.operators import keys


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (X.base_clean, "  ORELEE'S BARBERSHOP, Inc. ", "orelees barbershop inc"),
        (X.base_clean, None, ""),
        (X.base_clean, "\t .\n", ""),
        (X.base_clean, "łódź 7", "odz 7"),
        (X.base_clean, "日本　東京 x", "日本 東京 x"),
        (X.base_clean, "Straße Œuvre Æon", "strasse oeuvre aeon"),
        (X.normalize_name, "Marina Ecole France S.A.R.L.", "marina ecole france sarl"),
        (X.normalize_name, "Société Générale", "societe generale"),
        (X.normalize_name, "Foo Private Limited", "foo pvt ltd"),
        (X.normalize_name, "Foo Private Limited Bar", "foo pvt ltdbar"),
        (lambda c: X.normalize_name(c, strict=True), "Foo Private Limited Bar", "foo pvt ltd bar"),
        (X.normalize_name, "The Corporation of Acme", "inc acme"),
        (X.normalize_name_core, "Acme Corp", "acme corp"),
        (X.normalize_addr, "63 R. DE DIEPPE, LILLE", "63 rue dieppe lille"),
        (X.addr_tokens, "12 n main st", ["12", "main", "st"]),
        (X.name_tokens, "the acme inc", ["acme"]),
        (X.postal_codes, "a 12345 1234567", ["12345", "123456"]),
        (X.all_numbers, "a1 22b", ["1", "22"]),
        (X.char_ngrams, "abcd", ["abc", "bcd"]),
        (X.char_ngrams, "ab", ["ab"]),
        (X.char_ngrams, "", []),
        (X.char_3gram_set, "aaaa", ["aaa"]),
        (A.clean_text_basic, "Café & Co.", "cafe and co"),
        (A.clean_text_basic, "  ", ""),
        (A.normalize_business_name, "Acme Private Limited", "acme pvt ltd"),
        (lambda c: A.normalize_business_name(c, remove_legal=True), "Acme Private Limited", "acme private"),
        (A.normalize_address, "No 5, Oak Street", "# 5 oak st"),
        (A.extract_postal_code, "a 12345 560001 99999", "560001"),
        (A.extract_numbers, "7 7 x8 9", ["7", "9"]),
        (A.lexical_tokens, "ab c", ["ab", "c", "ab ", "b c"]),
    ],
)
def test_vectors(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_fnv_id_hash(spark):
    def want(x):
        h = 14695981039346656037
        for b in x.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    for x in ("S1-1", "S2-99999", "", "é"):
        assert one(spark, x, X.id_hash) == want(x)


def test_set_measures(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"]), (["a"], ["a", "b", "c"])], "a array<string>, b array<string>")
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(X.jaccard(F.col("a"), F.col("b")), X.overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.3333, 0.5), (0.0, 0.0), (0.3333, 1.0)]


def key_rows(spark, name, addr):
    df = spark.createDataFrame([("S1-1", "S1", name, addr)], "entity_id string, source string, name_norm string, addr_norm string")
    return [(r["family"], r["key"]) for r in keys.key_table(df).orderBy("ord").collect()]


def test_composite_keys(spark):
    assert key_rows(spark, "acme", "5 main st 12345") == [
        ("FULL_NAME", "acme"), ("SORTED_NAME", "acme"), ("NAME_ADDRNO", "acme|5"), ("NAME1_ADDRNO", "acme|5"), ("PREFIX4_ADDRNO", "acme|5"),
        ("NAME_POSTAL", "acme|12345"), ("POSTAL_NAME1", "12345|acme"), ("NAME1_POSTAL", "acme|12345"), ("PREFIX4_POSTAL", "acme|12345"),
        ("NAME1_STREET", "acme|main"), ("ADDRNO_POSTAL", "5|12345"), ("ADDRNO_STREET", "5|main"),
    ]
    rich = key_rows(spark, "alpha beta gamma", "5 maple grove hill 12345")
    assert len(rich) == V.MAX_KEYS and "ADDR_TOK_PAIR" not in {f for f, _ in rich}
    assert key_rows(spark, "", "") == [] and key_rows(spark, "inc", "") == []
