"""The best k by weighted keys against brute force, and frequent keys that must not be paired out."""

import random
import threading
from collections import defaultdict

import pytest

from kinlink.operators import blocking as B
from kinlink.operators import keys, lexical, prepare, slices
from kinlink.plans import registry


def within(spark, seconds, run):
    """``run()``, its jobs ended after so many seconds."""
    spark.sparkContext.setJobGroup("within", "a bounded run", True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()


@pytest.mark.parametrize(("digits", "least"), [(None, 0.5), (9, 0.5), (9, -1.0)])
@pytest.mark.parametrize(("rows", "wide"), [(7, 100), (10**6, 3), (10**6, 10**6)])
def test_best_of_slices(spark, monkeypatch, digits, least, rows, wide):
    for name, value in (("TARGETS", rows), ("QUERIES", 2 * rows), ("FEW", rows), ("WIDE", wide)):
        monkeypatch.setattr(slices, name, value)
    r = random.Random(rows + wide)
    made = lambda name, n: [(f"{name}{i}", r.choice([1, 1, 2, 3, 3, *range(4, 30)]), r.choice([least, 1.0, 1.5, 2.25])) for i in range(n) for _ in range(r.randint(1, 6))]
    asked, pool = made("q", 40), made("t", 60)
    sums = defaultdict(float)
    for q, h, w in asked:
        for t, g, v in pool:
            if g == h:
                sums[q, t] += w * v
    want = set()
    for q in {x[0] for x in asked}:
        best = sorted((-s, t) for (p, t), s in sums.items() if p == q and s > 0)[:4]
        want |= {(q, t, i + 1, -s) for i, (s, t) in enumerate(best)}
    got = slices.best(spark.createDataFrame(asked, "q string, h long, weight double"), spark.createDataFrame(pool, "t string, h long, weight double"), 4, digits).collect()
    assert {(x["q"], x["t"], x["rank"], x["score"]) for x in got} == want and len(got) == len(want)


def test_no_queries_or_no_targets(spark):
    none, one = spark.createDataFrame([], "q long, h long, weight double"), spark.createDataFrame([(1, 1, 1.0)], "q long, h long, weight double")
    for a, b in ((none, one), (one, none), (one, one.withColumn("h", one["h"] + 1))):
        assert slices.best(a, b.toDF("t", "h", "weight"), 3).collect() == []


@pytest.mark.parametrize("k", [3, 30])
def test_blocking_by_slices_is_blocking_by_joins(spark, k):
    r = random.Random(5)
    words = ["red", "blue", "iron", "steel", "mill", "works"]
    rows = [(("S1", "S2", "S3")[i % 3], f"S{1 + i % 3}-{i}", " ".join(r.choices(words, k=r.randint(1, 4))), f"{r.randint(1, 9)} {r.choice(words)} {r.choice(words)} 1234{r.randint(0, 2)}", "") for i in range(240)]
    records = prepare.spread(prepare.prepare(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")))
    joined, sliced = (sorted(map(tuple, B.block(records, B.Blocking(top_k=k, wide=10**9, dense=d)).collect())) for d in (10**9, 0))
    assert joined == sliced and joined


def _few(spark):
    r = random.Random(7)
    words = ["red", "blue", "iron", "mill", "mill", "works"]
    rows = [(("S1", "S2", "S3")[i % 3], f"S{1 + i % 3}-{i}", " ".join(r.choices(words, k=r.randint(0, 4))), f"{r.randint(1, 9)} {' '.join(r.choices(words, k=r.randint(0, 4)))} 1234{r.randint(0, 2)}", "") for i in range(60)]
    return prepare.spread(prepare.prepare(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")))


def test_packed_keys_are_the_keys(spark):
    records = _few(spark)
    keyed = keys.key_table(records).selectExpr("entity_id", "xxhash64(family, key)", "if(source = 'S1', cast(weight as double), 1D)")
    packed = keys.packed_keys(records).selectExpr("entity_id", "inline(x)")
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, packed.collect())) and packed.count()


def test_an_id_may_have_several_packed_rows(spark):
    one = [(1, "a", [(5, 1.0), (6, 2.0)]), (2, "b", [(7, 1.0)]), (1, "a", [(7, 4.0)])]
    two = [(9, "y", [(7, 1.0)]), (8, "x", [(5, 1.0)]), (9, "y", [(6, 1.0)])]
    form = lambda rows, key, name: spark.createDataFrame(rows, f"{key} long, {name} string, x array<struct<h: long, weight: double>>")
    got = slices.best_of_packed(form(one, "q", "s1_id"), form(two, "t", "target_id"), 2)
    assert sorted(map(tuple, got.select("s1_id", "target_id", "score", "rank").collect())) == [("a", "x", 1.0, 2), ("a", "y", 6.0, 1), ("b", "y", 1.0, 1)]


def test_candidates_of_slices_are_dealt_once(spark):
    """Keys go to their slices as the lists they were made as, and candidates are not dealt again to be ranked or named."""
    plan = B.block(_few(spark), B.Blocking(dense=0))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and not [x for x in ("Join", "Window", "Aggregate") if x in plan]


ALIKE = "entity_id string, source string, business_name string, business_address string, country string"


def _alike(spark, n):
    """Records of one name and street."""
    return spark.createDataFrame([(f"S{1 + i % 2}-{i}", f"S{1 + i % 2}", "red iron", f"{i} mill works road", "US") for i in range(n)], ALIKE)


def test_keys_of_all_records_block_in_time(spark):
    records = prepare.prepare(_alike(spark, 30000))
    got = within(spark, 90, lambda: B.block(records, rare=False).collect())
    assert len(got) == 15000 * 30 and {r["target_id"] for r in got} == {f"S2-{2 * i + 1}" for i in range(30)}


def test_tokens_of_all_records_are_searched_in_time(spark):
    e = _alike(spark, 30000).selectExpr("entity_id", "source", "concat(business_name, ' x', substr(entity_id, 4)) AS business_name", "business_address", "country")
    got = within(spark, 90, lambda: lexical.retrieve(e.where("source = 'S1'"), lexical.fit(e.where("source <> 'S1'")), k=2).collect())
    assert len(got) == 15000 * 2


def test_recall_of_a_key_of_all_records_in_time(spark, monkeypatch):
    n = 60000
    monkeypatch.setattr(registry, "part_entities", lambda *_: _alike(spark, n))
    truth = spark.range(n // 2).selectExpr("concat('S1-', 2 * id) AS s1_id", "concat('S2-', 2 * id + 1) AS target_id")
    monkeypatch.setattr(registry, "part_truth", lambda *_: truth)
    got = {r["family"]: r["recall"] for r in within(spark, 60, lambda: registry.key_recall(spark, "").collect())}
    assert got["FULL_NAME"] == 1.0 and "NAME_ADDRNO" not in got


def test_queries_alike_are_dealt_together(spark, monkeypatch):
    """Their wide keys are summed once; more of them than a slice holds go to several."""
    monkeypatch.setattr(slices, "QUERIES", 40)
    monkeypatch.setattr(slices, "FEW", 10)
    r = random.Random(12)
    rows = lambda n, many: [(i, min(i % 30, 9), r.randrange(many), float(r.randint(1, 4))) for i in range(n) for _ in range(4)]
    asked = spark.createDataFrame(rows(300, 20), "q long, alike long, h long, weight double")
    pool = spark.createDataFrame(rows(200, 20), "t long, alike long, h long, weight double").drop("alike")
    part = {(min(x["q"] % 30, 9), x["part"]) for x in slices._together(asked, "alike", 8).collect()}
    assert [len({p for a, p in part if a == i}) for i in range(9)] == [1] * 9 and 1 < len({p for a, p in part if a == 9}) <= 8
    plain = sorted(map(tuple, slices.best(asked.drop("alike"), pool, 5, 9).collect()))
    assert plain == sorted(map(tuple, slices.best(asked, pool, 5, 9, alike="alike").collect())) and plain


def test_retrieval_deals_queries_by_their_names(spark, monkeypatch):
    e = _alike(spark, 40).selectExpr("entity_id", "source", "concat('red iron mill x', substr(entity_id, 4)) AS business_name", "business_address", "country")
    seen = []
    deal = slices._together
    monkeypatch.setattr(slices, "_together", lambda a, alike, sets: seen.append(a.select(alike).distinct().count()) or deal(a, alike, sets))
    got = lexical.retrieve(e.where("source = 'S1'"), lexical.fit(e.where("source <> 'S1'")), k=2)
    assert got.columns == ["s1_id", "target_id", "score", "rank"] and got.count() == 40 and seen == [1]
