"""What a query moves and makes, read off its plan, and odd inputs of the ways taken instead."""

import random

import pyarrow as pa
import pytest

from kinlink.operators import decision, keys, metrics, prepare, slices, validate
from kinlink.plans import fixtures

SF = "/root/testdata/sf0.001"
PAIRS = "s1_id string, target_id string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_normalized_in_one_place(spark):
    made = prepare.prepare(fixtures.part_entities(spark, SF))
    assert sum("name_norm" in line and "Project" in line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1


def test_targets_without_keys(spark):
    x = "array<struct<h: bigint, weight: double>>"
    asked, none = (spark.createDataFrame([(1, keys)], f"{name} long, x {x}") for name, keys in (("q", [(5, 2.0)]), ("t", [])))
    assert slices.best_of_packed(asked, none, 3).collect() == []
    assert slices.best_of_packed(none.toDF("q", "x"), asked.toDF("t", "x"), 3).collect() == []


@pytest.mark.parametrize("weight", [1.0, 0.5])
def test_rows_travel_as_one_of_each_part(weight):
    r = random.Random(3)
    rows = [(i % 3, f"t{i // 2}", [{"h": r.randrange(9), "weight": weight} for _ in range(i % 5)]) for i in range(50)]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("weight", pa.float64())]))
    batch = pa.record_batch([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows], kind)], names=["part", "t", "x"])
    (got,) = slices._bundles([batch])
    assert got.column("part").to_pylist() == [0, 1, 2]
    for i in range(3):
        ids, per, h, w = slices._opened(pa.Table.from_batches([got.slice(i, 1)]), "t")
        want = {}
        for part, t, x in rows:
            if part == i:
                want.setdefault(t, []).extend(k["h"] for k in x)
        assert ids.column("t").to_pylist() == sorted(want) and per.tolist() == [len(want[t]) for t in sorted(want)]
        assert h.tolist() == [k for t in sorted(want) for k in want[t]] and w.tolist() == [weight] * len(h)


def test_repeated_street_words_make_a_key_once(spark):
    for street in (["oak", "oak", "oak"], ["oak", "oak", "elm"], ["oak", "elm", "oak"], ["oak", "elm", "ash"], ["oak"]):
        df = spark.createDataFrame([("S2-1", "S2", 0, "abc", " ".join(street))], "entity_id string, source string, row long, name_norm string, addr_norm string")
        got = [(r["family"], r["key"]) for r in keys.key_table(df).orderBy("ord").collect()]
        assert len(got) == len(set(got)) == len(keys.packed_keys(df).first()["x"])
        assert {k for f, k in got if f == "ADDR_TOK_PAIR"} == {f"{a}|{b}" for a, b in zip(street[:3], street[1:3], strict=False)}
        assert {k for f, k in got if f == "NAME1_STREET"} == {f"abc|{x}" for x in street[:2]}


def _pairs(r, n):
    return [(f"S1-{r.randrange(6)}" if r.random() < 0.9 else None, f"S2-{r.randrange(6)}" if r.random() < 0.9 else None) for _ in range(n)]


def test_quality_moves_candidates_once(spark):
    r = random.Random(8)
    truth, found = _pairs(r, 30), _pairs(r, 40)
    queries = [f"S1-{i}" for i in range(8)]
    made = metrics.entity_scores(spark.createDataFrame([(q,) for q in queries], "s1_id string"), spark.createDataFrame(truth, PAIRS), spark.createDataFrame(found, PAIRS))
    want = {(q, len({t for s, t in truth if s == q}), len({t for s, t in found if s == q}), len({t for s, t in truth if s == q and t} & {t for s, t in found if s == q})) for q in queries}
    # null ids are counted with the others, but equal nothing
    assert {(x["s1_id"], x["n_true"], x["n_found"], x["n_hit"]) for x in made.collect()} == want
    assert plan(made).count("hashpartitioning(s1_id") == plan(made).count("hashpartitioning(") and "target_id" not in "".join(x for x in plan(made).splitlines() if "Exchange" in x)



def test_missed_pairs_are_found_without_a_join(spark):
    r = random.Random(9)
    truth, found = _pairs(r, 60), _pairs(r, 20)
    made = metrics.missed_pairs(spark.createDataFrame(truth, PAIRS), spark.createDataFrame(found, PAIRS), 2, None)
    moves = plan(made)
    left = sorted({x for x in truth if None in x or x not in found}, key=lambda x: (x[0] or "", x[1] or ""))
    want = {x for i, x in enumerate(left) if sum(y[0] == x[0] for y in left[:i]) < 2}
    assert set(map(tuple, made.collect())) == want and want
    assert "Join" not in moves and moves.count("hashpartitioning(") == 1


def test_weak_candidates_are_not_dealt(spark):
    nan = float("nan")
    rows = [("a", "1", 0.9), ("a", "2", 0.6), ("a", "3", 0.5), ("b", "1", 0.65), ("b", "2", 0.1), ("c", "1", None), ("c", "2", 0.8), ("d", "1", nan), ("d", "2", 0.7), ("e", "1", 0.3)]
    scored = spark.createDataFrame(rows, "s1_id string, target_id string, prob double")
    made = decision.decide(scored, t_match=0.6, t_singleton=0.7)
    moves = plan(made)
    assert {(x["s1_id"], x["target_id"]) for x in made.collect()} == {("a", "1"), ("a", "2"), ("c", "2"), ("d", "1"), ("d", "2")}
    assert moves.rindex("prob#") > moves.index("Exchange") and any("Filter" in x and "0.6)" in x for x in moves[moves.index("Exchange") :].splitlines())
    # a threshold for matches above that of the best
    assert {(x["s1_id"], x["target_id"]) for x in decision.decide(scored, 0.85, 0.2).collect()} == {("a", "1"), ("d", "1")}


def test_candidate_lists_are_not_exploded(spark):
    r = random.Random(4)
    line = lambda: (f"S1-{r.randrange(12)}\t" + ",".join(f"S2-{r.randrange(9)}" for _ in range(r.randrange(4))))
    one, two = [line() for _ in range(20)] + ["no tab"], [line() for _ in range(25)] + ["S1-3"]
    lines = lambda xs: validate.parse(spark.createDataFrame([(x,) for x in xs], "value string"))
    made = validate.outside_candidates(lines(one), lines(two))
    moves = plan(made)
    ids = lambda xs: {(x.split("\t")[0], y) for x in xs if "\t" in x for y in x.split("\t")[1].split(",") if y}
    assert {x["s1_id"] for x in made.collect()} == {q for q, _ in ids(one) - ids(two)} and made.count() == len({q for q, _ in ids(one) - ids(two)})
    assert "Generate" not in moves
