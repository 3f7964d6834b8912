"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Every lower-case letter of the Latin blocks that decomposes, and its base; and đ."""
    pairs = {"đ": "d"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1 and ch == ch.lower():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column) -> Column:
    """Lower-case, without diacritics."""
    return F.regexp_replace(F.translate(F.lower(c), *fold_table()), r"\p{M}", "")


def fold_text(text: str) -> str:
    """``fold`` of a Python string."""
    flat = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in flat if not unicodedata.combining(c)).replace("đ", "d")


def tokens(c: Column) -> Column:
    """Folded words between white space."""
    return F.filter(F.split(F.trim(fold(c)), r"\s+"), lambda x: x != "")


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))


def has_marks(c: Column) -> Column:
    return fold(c) != F.lower(c)


def clean_cell(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def split_list(c: Column, separator: str) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def is_synthetic(poi_id: Column) -> Column:
    return poi_id.startswith("G")


def document(*parts: Column) -> Column:
    """Non-empty parts, one space between."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def contains_word(query: Column, name: Column) -> Column:
    """Does the folded name occur in the folded query, between spaces?"""
    n = fold(F.trim(name))
    return (n != "") & F.concat(F.lit(" "), fold(query), F.lit(" ")).contains(F.concat(F.lit(" "), n, F.lit(" ")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def address_line(address: Column, city: Column) -> Column:
    """The address with its city behind it, unless it ends in it."""
    return F.when(address == "", city).when((city == "") | address.endswith(city), address).otherwise(F.concat(address, F.lit(", "), city))


def place_id(poi_id: Column) -> Column:
    return F.concat(F.lit("poi:"), poi_id)


def bare_id(c: Column) -> Column:
    return F.regexp_replace(c, "^poi:", "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; within a lambda, Spark would compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return once(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))
