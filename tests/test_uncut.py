"""Queries that take whole texts and all tokens and keys: records that meet only beyond the bounds of the others."""

from types import SimpleNamespace

import duckdb
import pytest

from kinlink.functions import similarity as S
from kinlink.plans import oracle, registry

ENTITY = "source string, entity_id string, business_name string, business_address string, country string"
#: Alike in the 31st word alone, beyond character 88; and in keys, most of them after the 14th.
NUT, BOLT = "nut " * 30 + "zeta", "bolt " * 30 + "zeta"
ROWS = [
    ("S1", "S1-1", NUT, "", ""), ("S2", "S2-1", BOLT, "", ""),
    ("S1", "S1-2", "alpha beta gamma", "5 maple grove hill 12345", ""), ("S2", "S2-2", "alpha epsilon theta", "5 maple grove hill 54321", ""),
]
TRUTH = [("S1-1", "S2-1"), ("S1-2", "S2-2")]


@pytest.fixture
def asked(spark, monkeypatch):
    """Rows of a query as dicts, the same by its SQL."""
    values = lambda rows, names: f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) v ({names})"
    ents = values(ROWS, "source, entity_id, business_name, business_address, country")

    def rows(name, truth=TRUTH):
        monkeypatch.setattr(registry, "part_entities", lambda *_: spark.createDataFrame(ROWS, ENTITY))
        monkeypatch.setattr(registry, "part_truth", lambda *_: spark.createDataFrame(truth, "s1_id string, target_id string"))
        made = oracle.sql(SimpleNamespace(PART_ENTITIES=ents, DOCUMENT_ENTITIES=ents, PART_TRUTH=values(truth, "s1_id, target_id")))
        got = [r.asDict() for r in registry.queries()[name](spark, "").collect()]
        rel = duckdb.connect().sql(made[name])
        key = lambda r: repr(sorted(r.items()))
        assert sorted(got, key=key) == sorted((dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()), key=key)
        return sorted(got, key=key)

    return rows


def test_blocked_topk(asked):
    assert {(r["s1_id"], r["target_id"], r["rank"], r["score"]) for r in asked("blocked_topk")} == {("S1-1", "S2-1", 1, 0.6931), ("S1-2", "S2-2", 1, 98.4112)}


def test_best_threshold(asked):
    # the second query has no match, but a candidate that no threshold of the grid shuts out
    (got,) = asked("best_threshold", TRUTH[:1])
    assert got["macro_f"] == 0.0


def test_blocking_report(asked):
    (got,) = asked("blocking_report")
    assert (got["mean_recall"], got["zero_recall"], got["full_recall"], got["without_candidates"]) == (1.0, 0, 2, 0)


def test_candidate_rows(asked):
    assert {(r["source1_entity_id"], r["candidate_entity_ids"]) for r in asked("candidate_rows")} == {("S1-1", "S2-1"), ("S1-2", "S2-2")}


def test_entity_scores(asked):
    assert {(r["s1_id"], r["n_found"], r["n_hit"], r["f_beta"]) for r in asked("entity_scores")} == {("S1-1", 0, 0, 0.0), ("S1-2", 1, 1, 1.0)}


def test_fuzz_ratios(asked):
    got = {r["s1_id"]: r for r in asked("fuzz_ratios")}
    for name in ("fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio"):
        assert got["S1-1"][f"name_{name}"] == round(float(S.KERNELS[name]([(NUT, BOLT)])[0]), 6)


def test_long_texts_are_compared_in_bounded_memory(monkeypatch):
    pairs = [(f"{'ab ' * i}x{i}", f"{'ba ' * i}y{i}") for i in range(0, 120, 7)] + [("", "a" * 300), ("b", "ab" * 200)]
    want = {n: S.KERNELS[n](pairs).tolist() for n in S.KERNELS}
    monkeypatch.setattr(S, "_CELLS", 500)
    made = []
    pack = S.np.packbits
    monkeypatch.setattr(S.np, "packbits", lambda x, **k: made.append(x.size) or pack(x, **k))
    assert {n: S.KERNELS[n](pairs).tolist() for n in S.KERNELS} == want
    assert max(made) <= max(500, 2 * 448)


def test_jaro_winkler(asked):
    got = {r["s1_id"]: r["name_jw"] for r in asked("jaro_winkler")}
    assert got["S1-1"] == round(float(S.jaro_winklers([(NUT, BOLT)])[0]), 6)


def test_key_recall(asked):
    got = {r["family"]: (r["hit"], r["recall"]) for r in asked("key_recall")}
    assert got == dict.fromkeys(("NAME1_ADDRNO", "PREFIX4_ADDRNO", "NAME1_STREET", "ADDRNO_STREET", "ADDR_TOK_PAIR"), (1, 0.5))


def test_macro_f05(asked):
    (got,) = asked("macro_f05")
    assert (got["macro_f"], got["micro_precision"], got["micro_recall"], got["predicted_singletons"]) == (0.5, 1.0, 0.5, 1)


def test_outside_candidates(asked):
    assert asked("outside_candidates") == []


def test_pair_completeness(asked):
    (got,) = asked("pair_completeness")
    assert (got["pair_completeness"], got["candidate_pairs"], got["recalled_pairs"]) == (1.0, 2, 2)


def test_pair_features(asked):
    got = {r["s1_id"]: r for r in asked("pair_features")}
    assert got["S1-1"]["name_len_diff"] == len(BOLT) - len(NUT) and got["S1-1"]["name_token_jaccard"] == 0.333333 and got["S1-2"]["blocking_score"] == 98.411217


def test_probability_profile(asked):
    (got,) = asked("probability_profile")
    assert got["below_05"] == 0.5 and got["below_40"] == 0.5 and got["p05"] == round(0.006931 + 0.05 * (0.984112 - 0.006931), 6)
