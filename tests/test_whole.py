"""Queries cover all rows: against brute force on small tables."""

import numpy as np
import pytest

from kinlink.plans import registry

SF = "/root/testdata/sf0.001"


def test_queries_search_all_other_vectors(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(120, 4))
    x[119] = x[0]  # the nearest of 0 has the last id
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["s1_id"], r["rank"]): r["target_id"] for r in registry.embedding_topk(spark, str(tmp_path)).collect()}
    u = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    assert got["0", 1] == "119" and len(got) == 15
    for i in (0, 50, 100):
        best = sorted((j for j in range(120) if j != i), key=lambda j: (-u[i, j], str(j)))[:5]
        assert [got[str(i), k + 1] for k in range(5)] == [str(j) for j in best]


@pytest.fixture
def few(spark, tmp_path):
    """Parts that share words, so that queries have more than ten candidates."""
    spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").limit(60).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_every_candidate_is_scored(spark, few):
    pairs = {(r[0], r[1]): r["rank"] for r in registry.blocked_topk(spark, few).collect()}
    assert max(pairs.values()) > 10
    for name in ("pair_features", "fuzz_ratios", "wratio"):
        got = [(r[0], r[1]) for r in registry.queries()[name](spark, few).select("s1_id", "target_id").collect()]
        assert len(got) == len(pairs) and set(got) == set(pairs)


def test_every_candidate_gets_a_probability(spark, few):
    got = [(r[0], r[1]) for r in registry.gbt_scores(spark, few).collect()]
    pairs = {(r[0], r[1]) for r in registry.blocked_topk(spark, few).collect()}
    assert len(got) == len(pairs) and set(got) == pairs
