"""Blocking, metrics, decisions, files and validation on small hand-made tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.operators import blocking as B
from kinlink.operators import decision, dense, features, labels, lexical, metrics, prepare, ranker, validate
from kinlink.plans import pipeline
from kinlink.sources import tsv

ENTITIES = [
    ("S1", "S1-1", "Acme Tools Inc", "5 Main Street 12345", "US"),
    ("S1", "S1-2", "Blue Café", "7 Rue de Lille", ""),
    ("S1", "S1-3", "Nothing Else", "", "US"),
    ("S2", "S2-1", "ACME TOOLS", "5 main st 12345", "US"),
    ("S2", "S2-2", "Acme Other", "9 Oak Road", "US"),
    ("S3", "S3-1", "Blue Cafe SARL", "7 rue Lille", "France"),
    ("S3", "S3-2", None, None, None),
]
TRUTH = [("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-2", "S3-9")]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "source string, entity_id string, business_name string, business_address string, country string")


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTH, "s1_id string, target_id string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")


def test_block_finds_the_pairs(entities):
    records = prepare.prepare(entities)
    found = {(r["s1_id"], r["target_id"]): r["rank"] for r in B.block(records).collect()}
    assert found["S1-1", "S2-1"] == 1 and found["S1-2", "S3-1"] == 1
    assert not any(q == "S1-3" for q, _ in found)
    assert len(B.block(records, B.Blocking(top_k=1)).collect()) == 2


def test_query_repeats_count_and_document_repeats_do_not(spark):
    rows = [("S1-1", "S1", "zeta zeta", ""), ("S2-1", "S2", "zeta zeta", "")]
    records = spark.createDataFrame(rows, "entity_id string, source string, name_norm string, addr_norm string").withColumn("country", F.lit(""))
    hits = B.rare_hits(records).collect()
    assert len(hits) == 2 and abs(hits[0]["weight"] - np.log1p(2)) < 1e-9


def test_key_cap(entities):
    records = prepare.prepare(entities)
    assert B.block(records, B.Blocking(key_cap=0), rare=False).count() == 0


@pytest.mark.parametrize("k", [3, 30])
def test_wide_keys_do_not_change_the_result(spark, k):
    """Few words, so that keys have many targets: expanded, looked up for finalists, or both."""
    r = random.Random(2)
    words = ["red", "blue", "iron", "steel", "mill", "works"]
    rows = [(("S1", "S2", "S3")[i % 3], f"S{1 + i % 3}-{i}", " ".join(r.choices(words, k=r.randint(1, 4))), f"{r.randint(1, 9)} {r.choice(words)} {r.choice(words)} 1234{r.randint(0, 2)}", "") for i in range(240)]
    records = prepare.spread(prepare.prepare(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")))
    got = [sorted(map(tuple, B.block(records, B.Blocking(top_k=k, wide=w)).select("s1_id", "target_id", "rank", "score").collect())) for w in (10**9, 20, 0)]
    assert got[0] == got[1] == got[2] and len({x[0] for x in got[0]}) > 70


def test_ties_follow_the_target_order(spark):
    pairs = spark.createDataFrame([("S1-1", t, 1.0) for t in ("S3-1", "S2-10", "S2-9")], "s1_id string, target_id string, score float")
    assert [r["target_id"] for r in B.top_k(pairs, 3).orderBy("rank").collect()] == ["S2-9", "S2-10", "S3-1"]


def test_f_beta_and_macro(spark, queries, truth):
    found = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-1"), ("S1-3", "S2-7")], "s1_id string, target_id string")
    s = {r["s1_id"]: round(r["f_beta"], 4) for r in metrics.entity_scores(queries, truth, found).collect()}
    assert s == {"S1-1": 1.0, "S1-2": 0.8333, "S1-3": 0.0}
    m = metrics.macro(queries, truth, found.limit(0)).first()
    assert m["macro_f"] == round(1 / 3, 6) and m["singleton_accuracy"] == 1.0


def test_blocking_quality(spark, queries, truth):
    found = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, target_id string")
    n = spark.createDataFrame([(4,)], "n_targets long")
    q = metrics.blocking_quality(queries, truth, found, n).first()
    assert (q["pair_completeness"], q["candidate_pairs"]) == (round(1 / 3, 6), 2) and abs(q["reduction_ratio"] - (1 - 2 / 12)) < 1e-6
    assert metrics.blocking_quality(queries, truth.limit(0), found, n).first()["pair_completeness"] == 1.0
    assert [tuple(r) for r in metrics.missed_pairs(truth, found).collect()] == [("S1-2", "S3-1"), ("S1-2", "S3-9")]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.875


def test_decision_and_grid(spark, queries, truth):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.5), ("S1-2", "S3-1", 0.4), ("S1-3", "S2-2", 0.3)], "s1_id string, target_id string, prob double")
    assert {(r[0], r[1]) for r in decision.decide(scored, 0.45, 0.6).select("s1_id", "target_id").collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    points = decision.grid(spark, [0.0, 0.6], [0.35, 0.6])
    for r in decision.sweep(scored, queries, truth, points).collect():
        again = metrics.macro(queries, truth, decision.decide(scored, r["t_match"], r["t_singleton"])).first()
        assert r["macro_f"] == again["macro_f"]
    assert decision.best_point(decision.sweep(scored, queries, truth, points)).count() == 1


def test_policy_precedence(tmp_path):
    path = str(tmp_path / "policy.json")
    decision.write_policy(path, 0.1, 0.4, 0.9)
    assert decision.read_policy(path, 0.7)["t_match"] == 0.4 and decision.read_policy(None, 0.7, 0.6)["t_match"] == 0.7
    assert decision.read_policy(None, None, 0.6)["t_match"] == 0.6 and decision.read_policy(None)["t_match"] == 0.65
    assert json.load(open(path))["val_f05"] == 0.9


def test_features(entities):
    records = prepare.prepare(entities)
    rows = {(r["s1_id"], r["target_id"]): r for r in features.features(B.block(records), records).collect()}
    r = rows["S1-1", "S2-1"]
    assert len(features.FEATURES) == 33 and set(features.FEATURES) <= set(r.asDict())
    assert (r["is_same_country"], r["is_source2"], r["addr_fuzz_ratio"], r["postal_match"], r["first_word_match"]) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert rows["S1-2", "S3-1"]["is_same_country"] == 1.0 and rows["S1-2", "S3-1"]["is_source2"] == 0.0


def test_tsv_dialect(spark, tmp_path):
    path = tmp_path / "test_source2.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"quoted\tname"\taddr\tUS\nS2-2\tmid"quote\t\t\nS2-3\tshort', encoding="utf-8")
    rows = {r["entity_id"]: r for r in tsv.read_entities(spark, str(path)).collect()}
    assert rows["S2-1"]["business_name"] == "quoted\tname" and rows["S2-2"]["business_name"] == 'mid"quote'
    assert rows["S2-3"]["country"] == "" and rows["S2-3"]["source"] == "S2" and tsv.count_rows(spark, str(path)) == 3


def test_truth_file_and_resolution(spark, tmp_path, entities):
    path = tmp_path / "truth.tsv"
    path.write_text("source1_entity_id\tids\nS1-1\tS2-1, S2-1,,S2-404\nS1-2\t\nS1-3", encoding="utf-8")
    t = tsv.read_truth(spark, str(path))
    assert {tuple(r) for r in t.collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-404")}
    assert [tuple(r) for r in labels.resolve_truth(t, entities).collect()] == [("S1-1", "S2-1")]
    assert tuple(labels.resolution_stats(t, entities).first()) == (1, 1, 2)


def test_lists_and_validator(spark, tmp_path, queries):
    pairs = spark.createDataFrame([("S1-1", "S2-2", 2), ("S1-1", "S2-1", 1)], "s1_id string, target_id string, rank int")
    matches, cands = str(tmp_path / "m"), str(tmp_path / "c")
    tsv.write_lists(tsv.id_lists(queries, pairs, "matched_entity_ids"), matches, single_file=True)
    tsv.write_lists(tsv.id_lists(queries, pairs.where("rank = 1"), "candidate_entity_ids"), cands)
    errors, warnings = validate.validate(spark, matches, cands, queries)
    assert errors == [] and any("not among their candidates" in w for w in warnings) and validate.exit_code(errors) == 0
    errors, _ = validate.validate(spark, matches, None, queries, spark.createDataFrame([("S2-1",)], "target_id string"), check_ids=True)
    assert len(errors) == 1 and "S2-2" in errors[0] and validate.exit_code(errors) == 1
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id,matched_entity_ids\n", encoding="utf-8")
    assert "tab-separated" in validate.validate(spark, str(bad), None, queries)[0][0]
    assert "not readable" in validate.validate(spark, str(tmp_path / "none.tsv"), None, queries)[0][0]


def test_cached_tables_depend_on_parameters(spark, tmp_path):
    a = tsv.cached(spark, spark.range(3), str(tmp_path / "t"), {"cap": 1})
    b = tsv.cached(spark, spark.range(5), str(tmp_path / "t"), {"cap": 2})
    c = tsv.cached(spark, spark.range(9), str(tmp_path / "t"), {"cap": 1})
    assert (a.count(), b.count(), c.count()) == (3, 5, 3)


def test_retrieval(spark, entities):
    one, two = entities.where("source = 'S1'"), entities.where("source <> 'S1'")
    lex = lexical.retrieve(one, lexical.fit(two), k=2)
    assert {(r["s1_id"], r["target_id"]) for r in lex.where("rank = 1").collect()} >= {("S1-1", "S2-1")}
    both = lexical.interleave(lex, lex.withColumn("target_id", F.lit("S3-9")).where("rank = 1"), limit=2)
    assert [r["target_id"] for r in both.where("s1_id = 'S1-1'").orderBy("rank").collect()] == ["S2-1", "S3-9"]


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)] + [("n", None)], "id string, v array<double>")
    got = {(r["s1_id"], r["rank"]): r["target_id"] for r in dense.top_cosine(df.where("id < '2'"), df.where("id >= '2'"), "id", "v", k=3, block=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = [i for i in range(40) if str(i) >= "2"]
    for i in (j for j in range(40) if str(j) < "2"):
        best = sorted(right, key=lambda j: -(u[i] @ u[j]))[:3]
        assert [got[str(i), k + 1] for k in range(3)] == [str(j) for j in best]


def test_cross_encoder_interface(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "text_a string, text_b string")
    load = lambda: lambda a, b: np.array([[0.0, 5.0 if x == y else -5.0] for x, y in zip(a, b, strict=True)])
    assert [round(r["prob"]) for r in dense.cross_encode(df, load).collect()] == [1, 0]


def test_training_and_inference(spark, tmp_path):
    rows, truth = [], []
    for i in range(40):
        name = f"{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 4] * 3} works"
        rows += [("S1", f"S1-{i}", name + " inc", f"{i} oak street 1{i:04d}", "US"), ("S2", f"S2-{i}", name, f"{i} oak st 1{i:04d}", "US"), ("S3", f"S3-{i}", f"{name} annex", f"{i + 1} elm road", "US")]
        truth.append((f"S1-{i}", f"S2-{i}"))
    e = spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")
    t = spark.createDataFrame(truth, "s1_id string, target_id string")
    model, policy = pipeline.train(e, t, trees=ranker.Trees(rounds=3, depth=3, rate=0.3))
    path = str(tmp_path / "model")
    ranker.save(model, path)
    out = pipeline.infer(e, ranker.load(path), policy)
    assert out.match_lists.count() == 40 and policy["val_f05"] > 0.8
    assert len(ranker.importances(model)) == 15
    with pytest.raises(FileNotFoundError):
        ranker.load(str(tmp_path / "no-model"))


def test_slices_go_by_rows_not_by_numbers(spark):
    q = spark.createDataFrame([(f"S1-{i}",) for i in (3, 900, 5, 7, 10**6, 8, 11)], "s1_id string")
    first = [r["s1_id"] for r in labels.query_slice(q, 0.0, 0.5).collect()]
    assert sorted(first) == ["S1-3", "S1-5", "S1-7"] and labels.query_slice(q, 0.5, 1.0).count() == 4


def test_command_line_validator(spark, tmp_path, capsys):
    write = lambda name, body: (tmp_path / name).write_text("a\tb\tc\td\n".replace("a", "entity_id") + body)
    write("test_source1.tsv", "S1-1\tx\ty\tUS\nS1-2\tx\ty\tUS\n")
    write("test_source2.tsv", "S2-1\tx\ty\tUS\n")
    write("test_source3.tsv", "")
    good, bad = tmp_path / "good.tsv", tmp_path / "bad.tsv"
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-7\nsource1_entity_id\tS2-1\n")
    args = lambda m: ["-m", str(m), "-c", str(tmp_path / "none.tsv"), "-t", str(tmp_path), "--check-ids"]
    assert validate.main(args(good)) == 0 and "PASS" in capsys.readouterr().out
    assert validate.main(args(bad)) == 1
    said = capsys.readouterr().out
    assert "S2-7" in said and "S1-2" in said and "source1_entity_id" in said.split("not required")[-1]
    assert validate.main(["-t", str(tmp_path / "nowhere")]) == 1
