"""Benchmarks with repeated item ids."""

import pytest

from kinlink.llm import decontam


@pytest.mark.parametrize("block", [1, 100_000])
def test_a_repeated_item_id_is_listed_once(spark, block):
    text = [" ".join(f"{a}{i}" for i in range(13)) for a in "uvw"]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, text[1])], "doc_id long, text string")
    items = spark.createDataFrame([("b", text[0]), ("b", text[1]), ("a", text[2]), ("a", text[2]), (None, text[1])], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.phrase_matches(docs, items, block_words=block).collect()}
    assert got == {1: (39, ["a", "b"]), 2: (13, ["b"])}
