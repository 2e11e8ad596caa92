"""Composite blocking keys: one array expression, the same for queries and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text as X
from kinlink.functions import vocabulary as V


def _parts(df: DataFrame) -> DataFrame:
    """What the families are made of."""
    words = X.split_words(F.col("addr_norm"))
    df = df.withColumns({"_core": X.without(X.split_words(F.col("name_norm")), V.LEGAL_WORDS), "_addr": words, "_nums": F.filter(words, X.is_number)})
    short = F.get(F.filter("_nums", lambda w: F.length(w) <= 5), F.lit(0))
    return df.withColumns(
        {
            "_no": F.coalesce(short, F.get("_nums", F.lit(0)), F.lit("")),
            "_postal": F.coalesce(F.try_element_at(F.filter("_nums", lambda w: F.length(w).isin(5, 6)), F.lit(-1)), F.lit("")),
            "_street": F.filter("_addr", lambda w: ~X.is_number(w) & (F.length(w) >= 3) & ~w.isin(sorted(V.STREET_WORDS))),
            "_full": F.array_join("_core", " "),
            "_one": F.coalesce(F.get("_core", F.lit(0)), F.lit("")),
        }
    )


def _key(family: str, text: Column, when: Column) -> Column:
    """A list with the key, or an empty one."""
    made = F.array(F.struct(F.lit(family).alias("family"), text.alias("key"), F.lit(V.KEY_WEIGHTS[family]).alias("weight")))
    return F.when(when, made).otherwise(F.slice(made, 1, 0))


def _hashed(family: str, text: Column, when: Column) -> Column:
    """The key's hash and weight (a target's: 1), or null."""
    weight = F.when(F.col("source") == "S1", F.lit(V.KEY_WEIGHTS[family])).otherwise(1.0)
    return F.when(when, F.struct(F.xxhash64(F.lit(family), text).alias("h"), weight.alias("weight")))


def _bar(*parts: Column | str) -> Column:
    return F.concat_ws("|", *parts)


def _emitted() -> list[tuple[str, Column, Column]]:
    """Family, key and condition of every key of a record (of ``_parts``), in emission order, without repeats."""
    core, street, full, one, no, postal = (F.col(c) for c in ("_core", "_street", "_full", "_one", "_no", "_postal"))
    named, numbered, posted = F.size(core) > 0, no != "", postal != ""
    prefix, long = F.substring(one, 1, 4), F.length(one) >= 4
    at = lambda xs, i: F.get(xs, F.lit(i))
    # a street word (a pair of them) that came before makes the same key again
    new = lambda i: (F.size(street) > i) & ~F.array_contains(F.slice(street, 1, i), at(street, i)) if i else F.size(street) > 0
    again = (at(street, 0) == at(street, 1)) & (at(street, 1) == at(street, 2))
    return [
        ("FULL_NAME", full, named),
        ("SORTED_NAME", F.array_join(F.array_sort(core), " "), named),
        ("NAME_FIRST2", F.concat_ws(" ", at(core, 0), at(core, 1)), F.size(core) >= 2),
        ("PARTIAL_NAME", F.array_join(F.slice(F.array_sort(core), 1, 3), " "), F.size(core) >= 3),
        ("NAME_ADDRNO", _bar(full, no), named & numbered),
        ("NAME1_ADDRNO", _bar(one, no), named & numbered),
        ("PREFIX4_ADDRNO", _bar(prefix, no), named & numbered & long),
        ("NAME_POSTAL", _bar(full, postal), named & posted),
        ("POSTAL_NAME1", _bar(postal, one), named & posted),
        ("NAME1_POSTAL", _bar(one, postal), named & posted),
        ("PREFIX4_POSTAL", _bar(prefix, postal), named & posted & long),
        *[("NAME1_STREET", _bar(one, at(street, i)), named & new(i)) for i in range(2)],
        ("ADDRNO_POSTAL", _bar(no, postal), numbered & posted),
        *[("ADDRNO_STREET", _bar(no, at(street, i)), numbered & new(i)) for i in range(3)],
        ("ADDR_TOK_PAIR", _bar(at(street, 0), at(street, 1)), F.size(street) > 1),
        ("ADDR_TOK_PAIR", _bar(at(street, 1), at(street, 2)), (F.size(street) > 2) & ~again),
    ]


def _first(made: Column, most: int | None) -> Column:
    return made if most is None else F.slice(made, 1, most)


def composite_keys(most: int | None = V.MAX_KEYS) -> Column:
    """Keys of a record (of ``_parts``) in emission order, at most ``most`` (None: all)."""
    return _first(F.concat(*[_key(*x) for x in _emitted()]), most)


def packed_keys(records: DataFrame, most: int | None = V.MAX_KEYS) -> DataFrame:
    """(entity_id, source, row, x): the keys of every record as one list of hashes and weights (of targets: 1)."""
    made = F.array_compact(F.array(*[_hashed(*x) for x in _emitted()]))
    return _parts(records).select("entity_id", "source", "row", _first(made, most).alias("x"))


def key_table(records: DataFrame, most: int | None = V.MAX_KEYS) -> DataFrame:
    """(entity_id, source, ord, family, key, weight, and row if there is one): the exploded keys of every record."""
    own = [c for c in ("entity_id", "source", "row") if c in records.columns]
    keyed = _parts(records).select(*own, composite_keys(most).alias("_k"))
    # an outer explode: before an inner one Spark would test the list for emptiness and so build it twice
    return keyed.select(*own, F.posexplode_outer("_k").alias("ord", "k")).where("k is not null").select(*own, "ord", "k.family", "k.key", "k.weight")


def posting_stats(keys: DataFrame) -> DataFrame:
    """Per family: distinct keys, mean and largest number of records of a key."""
    per = keys.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("family").agg(F.count(F.lit(1)).alias("distinct_keys"), F.round(F.avg("n"), 6).alias("mean_postings"), F.max("n").alias("max_postings"))
