"""The 33 features of a candidate pair: built-in expressions, and one Arrow call each for names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import similarity as S

#: Names and order of the features, as a trained model expects them.
FEATURES = [
    "blocking_score", "is_same_country", "is_source2", "name_len_diff", "name_len_ratio", "addr_len_diff", "addr_len_ratio", "name_fuzz_ratio",
    "name_partial_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_wratio", "name_jaro_winkler", "addr_fuzz_ratio",
    "addr_partial_ratio", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_jaro_winkler", "name_token_jaccard", "name_token_overlap",
    "addr_token_jaccard", "addr_token_overlap", "name_3gram_jaccard", "num_shared_numbers", "has_conflicting_numbers", "number_jaccard",
    "postal_match", "postal_mismatch", "first_word_match", "first_word_jw", "first_word_soundex", "name_addr_fuzz_prod", "name_addr_jw_prod",
]


def with_attributes(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Names, addresses and countries of both sides (1: the query, 2: the target)."""
    side = lambda i, key: records.select(F.col("entity_id").alias(key), F.col("name_norm").alias(f"name{i}"), F.col("addr_norm").alias(f"addr{i}"), F.col("country").alias(f"country{i}"), *([F.col("source").alias("source2")] if i == 2 else []))
    return pairs.join(side(1, "s1_id"), "s1_id").join(side(2, "target_id"), "target_id")


def _grams(x: str) -> Column:
    """Distinct character 3-grams, as ``text.char_3gram_set`` has them."""
    every = F.regexp_extract_all(F.col(x), F.lit(r"(?s)(?=(...))."), F.lit(1))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= 3, F.array(x)).otherwise(F.array_distinct(every))


def with_sets(pairs: DataFrame) -> DataFrame:
    """Words (``_n``, ``_a``), 3-grams, numbers, postal codes and first words of both sides, and how many both have.

    Columns of their own, because the features use each several times; no lambdas, which Spark would interpret.
    """
    words = lambda x: F.array_remove(F.array_distinct(F.split(x, " ")), "")
    digits = lambda x, n: F.array_distinct(F.regexp_extract_all(x, F.lit(rf"(?<![^ ])[0-9]{n}(?![^ ])"), F.lit(0)))
    made: dict[str, Column] = {}
    for i in "12":
        name, addr = f"name{i}", f"addr{i}"
        made |= {f"_n{i}": words(name), f"_g{i}": _grams(name), f"_a{i}": words(addr), f"_d{i}": digits(addr, "+"), f"_p{i}": digits(addr, "{5,6}"), f"_w{i}": F.split_part(name, F.lit(" "), F.lit(1))}
    return pairs.withColumns(made).withColumns({f"_{x}": F.size(F.array_intersect(f"_{x}1", f"_{x}2")) for x in "ngad"})


def _lengths(a: str, b: str) -> tuple[Column, Column]:
    x, y = F.length(a), F.length(b)
    return F.abs(x - y).cast("double"), F.least(x, y) / F.greatest(x, y, F.lit(1))


def set_features() -> dict[str, Column]:
    """Features 2 to 7 and 19 to 29 and 31, from the columns of ``with_attributes`` and ``with_sets``: no Python."""
    known = (F.col("country1") != "") & (F.col("country2") != "")
    posted = (F.size("_p1") > 0) & (F.size("_p2") > 0)
    numbered = (F.size("_d1") > 0) & (F.size("_d2") > 0)
    shared = F.arrays_overlap("_p1", "_p2")
    w1, w2 = F.col("_w1"), F.col("_w2")
    worded = (w1 != "") & (w2 != "")
    some = lambda x: (F.size(f"_{x}1") > 0) & (F.size(f"_{x}2") > 0)
    jaccard = lambda x: F.when(some(x), F.col(f"_{x}") / (F.size(f"_{x}1") + F.size(f"_{x}2") - F.col(f"_{x}"))).otherwise(0.0)
    overlap = lambda x: F.when(some(x), F.col(f"_{x}") / F.least(F.size(f"_{x}1"), F.size(f"_{x}2"))).otherwise(0.0)
    flag = lambda c: c.cast("double")
    out = {
        "is_same_country": F.when(known, flag(F.col("country1") == F.col("country2"))).otherwise(1.0),
        "is_source2": flag(F.col("source2") == "S2"),
        "name_token_jaccard": jaccard("n"),
        "name_token_overlap": overlap("n"),
        "addr_token_jaccard": jaccard("a"),
        "addr_token_overlap": overlap("a"),
        "name_3gram_jaccard": jaccard("g"),
        "num_shared_numbers": F.col("_d").cast("double"),
        "has_conflicting_numbers": flag(numbered & (F.col("_d") == 0)),
        "number_jaccard": jaccard("d"),
        "postal_match": flag(posted & shared),
        "postal_mismatch": flag(posted & ~shared),
        "first_word_match": flag(worded & (w1 == w2)),
        "first_word_soundex": flag(worded & (S.soundex(w1) == S.soundex(w2))),
    }
    out["name_len_diff"], out["name_len_ratio"] = _lengths("name1", "name2")
    out["addr_len_diff"], out["addr_len_ratio"] = _lengths("addr1", "addr2")
    return out


_NAME = {"name_fuzz_ratio": "fuzz_ratio", "name_partial_ratio": "partial_ratio", "name_token_sort_ratio": "token_sort_ratio", "name_token_set_ratio": "token_set_ratio", "name_wratio": "wratio", "name_jaro_winkler": "jaro_winkler"}
_ADDR = {"addr_fuzz_ratio": "fuzz_ratio", "addr_partial_ratio": "partial_ratio", "addr_token_sort_ratio": "token_sort_ratio", "addr_token_set_ratio": "token_set_ratio", "addr_jaro_winkler": "jaro_winkler"}


def features(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """s1_id, target_id and FEATURES (single precision) of every candidate (s1_id, target_id, score)."""
    p = with_attributes(candidates.select("s1_id", "target_id", F.col("score").alias("blocking_score")), records)
    first = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    p = p.withColumns(
        {
            "_name": S.similarities(list(_NAME.values()), F.col("name1"), F.col("name2")),
            "_addr": S.similarities(list(_ADDR.values()), F.col("addr1"), F.col("addr2")),
            "_j": S.similarity("jaro_winkler", first("name1"), first("name2")),
        }
    )
    p = with_sets(p)
    made = set_features() | {k: F.col("_name")[v] for k, v in _NAME.items()} | {k: F.col("_addr")[v] for k, v in _ADDR.items()}
    made["blocking_score"] = F.col("blocking_score")
    made["first_word_jw"] = F.when((F.col("_w1") != "") & (F.col("_w2") != ""), F.col("_j")).otherwise(0.0)
    made["name_addr_fuzz_prod"] = made["name_token_set_ratio"] * made["addr_token_set_ratio"]
    made["name_addr_jw_prod"] = made["name_jaro_winkler"] * made["addr_jaro_winkler"]
    return p.select("s1_id", "target_id", *[made[f].cast("float").alias(f) for f in FEATURES])
