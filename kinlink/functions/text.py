"""Normalization and token functions (Column -> Column), all built in: no Python runs on the rows.

Missing text counts as the empty text throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_FROM, _TO = V.folded()


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def fold_accents(x: Column) -> Column:
    """Accented Latin letters (lower case) to plain ones; a few letters are spelled out."""
    for letter, spelled in V.SPELLED.items():
        x = F.replace(x, F.lit(letter), F.lit(spelled))
    return F.translate(x, _FROM, _TO)


def base_clean(x: Column) -> Column:
    """Lower case, no accents, some punctuation deleted and the rest turned into single spaces.

    Code points from 0x2FFF on (CJK and others) are kept.
    """
    x = F.translate(fold_accents(F.lower(_or_empty(x))), V.VANISHING, "")
    return F.trim(F.regexp_replace(x, rf"[^a-z0-9\x{{{V.KEPT_FROM:X}}}\x{{3001}}-\x{{10FFFF}}]+", " "))


def map_words(words: Column, table: dict[str, str]) -> Column:
    """Replace the words that the table knows; drop those whose form is empty."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), lambda w: w != "")


def replace_phrases(x: Column, strict: bool = False) -> Column:
    """Legal phrases inside a name.  The white space after a phrase goes with it; ``strict`` keeps it and also takes phrases at the end."""
    for phrase, form in V.LEGAL_PHRASES:
        x = F.regexp_replace(x, rf"(?<![^ ]){phrase}(?![^ ])" if strict else rf"{phrase}\s+", form)
    return x


def split_words(x: Column) -> Column:
    return F.filter(F.split(_or_empty(x), " "), lambda w: w != "")


def normalize_name(x: Column, strict: bool = False) -> Column:
    """Cleaned name with canonical legal forms."""
    return F.array_join(map_words(split_words(replace_phrases(base_clean(x), strict)), V.LEGAL_FORMS), " ")


def normalize_name_core(x: Column, strict: bool = False) -> Column:
    """Cleaned name without legal words; words are not canonicalized."""
    return F.array_join(without(split_words(replace_phrases(base_clean(x), strict)), V.LEGAL_WORDS), " ")


def normalize_addr(x: Column) -> Column:
    """Cleaned address with canonical street words."""
    return F.array_join(map_words(split_words(base_clean(x)), V.ADDRESS_FORMS), " ")


def composite(name: Column, addr: Column) -> Column:
    return F.trim(F.concat_ws(" ", _or_empty(name), _or_empty(addr)))


def without(words: Column, drop: set[str]) -> Column:
    # a set, looked up; a list would be compared word by word
    return F.filter(words, lambda w: ~w.isin(sorted(drop)))


def name_tokens(name_norm: Column) -> Column:
    """Words of a normalized name without legal words."""
    return without(split_words(name_norm), V.LEGAL_WORDS)


def addr_tokens(addr_norm: Column) -> Column:
    """Words of a normalized address without compass words."""
    return without(split_words(addr_norm), V.ADDRESS_STOP)


def first_tokens(words: Column, n: int | None = V.MAX_TOKENS) -> Column:
    return words if n is None else F.slice(words, 1, n)


def all_numbers(x: Column) -> Column:
    """Runs of digits in order."""
    return F.regexp_extract_all(_or_empty(x), F.lit(r"\d+"), F.lit(0))


def postal_codes(x: Column) -> Column:
    """Five or six digits wherever they stand, also inside longer runs."""
    return F.regexp_extract_all(_or_empty(x), F.lit(r"\d{5}(?:\d{1})?"), F.lit(0))


def char_ngrams(x: Column, n: int = 3) -> Column:
    """All character n-grams; the whole text if it is no longer than n; nothing for the empty text."""
    x = _or_empty(x)
    long = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substr(x, i, F.lit(n)))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(F.length(x) <= n, F.array(x)).otherwise(long)


def char_3gram_set(x: Column) -> Column:
    """Distinct character 3-grams, ``{text}`` below three characters."""
    return F.array_distinct(char_ngrams(x, 3))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared members by the size of the smaller set; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def is_number(w: Column) -> Column:
    return w.rlike("^[0-9]+$")


def token_hash(words: Column, seed: int) -> Column:
    """64-bit hash of each token under a seed: a narrow join key in place of the text."""
    return F.transform(words, lambda w: F.xxhash64(F.lit(seed), w))


def id_hash(x: Column) -> Column:
    """64-bit FNV-1a hash of an id's bytes (offset basis and prime are fixed values)."""
    # the product is taken modulo 2**64 in decimal arithmetic and brought back to the signed range
    prime, basis, full, half = "1099511628211", "14695981039346656037", "18446744073709551616", "9223372036854775808"
    code = lambda i: F.conv(F.substr(F.hex(F.encode(x, "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
    signed = lambda d: F.when(d >= F.lit(half).cast("decimal(20,0)"), d - F.lit(full).cast("decimal(20,0)")).otherwise(d).cast("bigint")
    unsigned = lambda h: F.when(h < 0, h.cast("decimal(20,0)") + F.lit(full).cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")
    start = signed(F.lit(basis).cast("decimal(20,0)"))
    n = F.octet_length(_or_empty(x))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda h, i: signed((unsigned(h.bitwiseXOR(code(i))) * F.lit(prime).cast("decimal(13,0)") % F.lit(full).cast("decimal(20,0)")).cast("decimal(20,0)")))
