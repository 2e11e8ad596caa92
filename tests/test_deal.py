"""Slices are dealt one to a task, and rare tokens are found in one reading of the records' texts."""

import random

import pytest
from pyspark.sql import functions as F

from kinlink.operators import blocking as B
from kinlink.operators import prepare, slices


@pytest.mark.parametrize("n", [1, 2, 7, 12, 96])
def test_every_slice_has_a_task(spark, n):
    names = slices.names(n)
    rows = spark.createDataFrame([(x,) for x in names], "to int").repartition(n, "to").select(F.spark_partition_id().alias("p")).collect()
    assert len(set(names)) == n and {r["p"] for r in rows} == set(range(n))


def test_rare_tokens_by_both_joins(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(("S1", "S2", "S3")[i % 3], f"S{1 + i % 3}-{i}", " ".join(r.choices(words, k=4) + ["all"] * 2), f"{r.randint(1, 30)} {r.choice(words)} road", "") for i in range(150)]
    records = prepare.spread(prepare.prepare(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")))
    b = B.Blocking(name_cap=12, addr_cap=6, doc_tokens=2, query_tokens=3)
    tok = prepare.tokens(records).collect()
    df = {}
    for t in tok:
        if t["source"] != "S1":
            df[t["ns"], t["token"]] = df.get((t["ns"], t["token"]), 0) + 1
    kept = {}
    for t in tok:
        key = t["ns"], t["token"]
        if df.get(key, 10**9) <= (12 if t["ns"] == "name" else 6):
            kept.setdefault((t["entity_id"], t["ns"]), []).append((df[key], t["pos"], t["token"]))
    posts, probes = {}, {}
    for (e, ns), found in kept.items():
        if e.startswith("S1"):
            probes[e, ns] = [x[2] for x in sorted(found)[:3]]
        else:
            posts[e, ns] = sorted({x[2]: x for x in sorted(found, reverse=True)}.values())[:2]
    want = sorted((q, t, ns) for (q, ns), xs in probes.items() for x in xs for (t, m), ys in posts.items() if m == ns for y in ys if y[2] == x)
    for few in (0, 10**6):
        monkeypatch.setattr(B, "FEW_TOKENS", few)
        assert sorted((h["s1_id"], h["target_id"], h["channel"]) for h in B.rare_hits(records, b).collect()) == want and want
