"""The alternative normalizer: ordered regular expressions between word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import char_ngrams

_FROM, _TO = V.folded(0x24F)


def strip_accents(x: Column) -> Column:
    """Without combining marks: precomposed Latin letters to plain ones, stand-alone marks deleted."""
    upper = "".join(c.upper() for c in _FROM if len(c.upper()) == 1), "".join(t.upper() for c, t in zip(_FROM, _TO, strict=True) if len(c.upper()) == 1)
    plain = F.translate(F.coalesce(x, F.lit("")), _FROM + upper[0], _TO + upper[1])
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_text_basic(x: Column) -> Column:
    """Lower case, no accents, ``&`` spelled, all but letters, digits, underscore, ``#`` and ``-`` to single spaces."""
    x = F.replace(strip_accents(F.lower(x)), F.lit("&"), F.lit(" and "))
    return _squeezed(F.regexp_replace(x, r"(?U)[^\w\s#\-]", " "))


def _replaced(x: Column, rules: list[tuple[tuple[str, ...], str]], delete: bool = False) -> Column:
    for words, form in rules:
        x = F.regexp_replace(x, rf"(?U)\b({'|'.join(words)})\b", "" if delete else form)
    return _squeezed(x)


def normalize_business_name(x: Column, remove_legal: bool = False) -> Column:
    return _replaced(clean_text_basic(x), V.ALT_LEGAL, remove_legal)


def normalize_address(x: Column) -> Column:
    return _replaced(clean_text_basic(x), V.ALT_ADDRESS)


def extract_numbers(x: Column) -> Column:
    """Distinct numbers between word boundaries."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\b\d+\b"), F.lit(0)))


def extract_postal_code(x: Column) -> Column:
    """Last number of six digits, else last of five, else empty."""
    last = lambda n: F.try_element_at(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"(?U)\b\d{{{n}}}\b"), F.lit(0)), F.lit(-1))
    return F.coalesce(last(6), last(5), F.lit(""))


def composite_representation(name: Column, addr: Column, country: Column) -> Column:
    return F.concat_ws(" [SEP] ", normalize_business_name(name), normalize_address(addr), F.lower(F.trim(F.coalesce(country, F.lit("")))))


def lexical_tokens(x: Column) -> Column:
    """Words, then character 3-grams of the whole text (spaces included; none below three characters)."""
    x = F.coalesce(x, F.lit(""))
    grams = F.when(F.length(x) >= 3, char_ngrams(x, 3)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w+\b"), F.lit(0)), grams)
