"""Training samples with texts that do not fit."""

import pytest
from pyspark.sql import functions as F

from kinlink.llm import labels


@pytest.fixture(scope="module")
def table(spark):
    """Twenty labelled rows that may be learned from, in hash order: the first is far over the bound."""
    ids = spark.range(100).where(~labels.held_out(F.col("id"))).orderBy(F.xxhash64(F.lit(29), "id")).limit(20)
    ids = [r["id"] for r in ids.collect()]
    docs = [(i, "x" * (5000 if k == 0 else 100)) for k, i in enumerate(ids)] + [(ids[1], "y" * 101)] * 500
    marks = [(i, k % 2) for k, i in enumerate(ids)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_a_long_text_is_passed_over(table):
    texts, y, prior = labels.sample(*table, "toxic", max_bytes=4000)
    # an id that stands in many rows counts once
    assert len(texts) == 19 and sum(y) == 10 and max(map(len, texts)) == 100 and prior == 0.5
    texts, y, _ = labels.sample(*table, "toxic", max_bytes=1000)
    assert (len(texts), sum(y)) == (10, 5)


def test_bytes_a_class_leaves_go_to_the_other():
    assert labels.fitting([(1, 70, 0), (2, 10, 1), (3, 20, 0)], 100) == [(1, 70, 0), (2, 10, 1), (3, 20, 0)]
    assert labels.fitting([(1, 70, 0), (2, 10, 1), (3, 20, 0), (4, 10, 0), (5, 90, 1)], 100) == [(2, 10, 1), (3, 20, 0), (4, 10, 0)]


def test_a_class_without_a_fitting_text_is_an_error(table):
    docs, marks = table
    long = docs.join(marks, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.lit("x" * 5000)).otherwise(F.col("text")).alias("text"))
    with pytest.raises(ValueError):
        labels.sample(long, marks, "toxic", max_bytes=4000)
    assert labels.sample(docs.limit(0), marks, "toxic")[0] == []
