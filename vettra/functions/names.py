"""Canonical names, their parts, and blocking keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vettra.functions.translit import transliterate

# Characters a Unicode-aware strip removes; Spark's trim() alone removes only the space.
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(STRIP_CHARS))


def canonical_name(raw: Column, extra: dict[str, str] | None = None) -> Column:
    """Romanised, lower case, one space between tokens, tokens free of hyphens and apostrophes at their ends."""
    lowered = F.lower(transliterate(F.coalesce(raw, F.lit("")), extra))
    spaced = F.regexp_replace(lowered, r"[^a-z0-9_'-]+", " ")
    bare = F.regexp_replace(spaced, r"(?<![^ ])[-']+|[-']+(?![^ ])", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def name_parts(canonical: Column) -> Column:
    """struct<first,last,middle>; a single token is a surname, inner tokens form the middle name."""
    tokens = F.filter(F.split(canonical, " "), lambda t: t != "")
    count = F.size(tokens)
    return F.struct(
        F.when(count >= 2, F.get(tokens, F.lit(0))).otherwise("").alias("first"),
        F.coalesce(F.get(tokens, count - 1), F.lit("")).alias("last"),
        F.when(count > 2, F.array_join(F.slice(tokens, 2, F.greatest(count - 2, F.lit(0))), " ")).alias("middle"),
    )


def token_sorted(canonical: Column) -> Column:
    """The same tokens in alphabetical order, so that name order does not matter."""
    return F.array_join(F.array_sort(F.split(canonical, " ")), " ")


def _block_tokens(name: Column, extra: dict[str, str] | None) -> Column:
    words = F.split(F.lower(transliterate(F.coalesce(name, F.lit("")), extra)), r"[\s\x1c-\x1f]+")
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit("-'"))), lambda w: w != "")


def block_keys(name: Column, extra: dict[str, str] | None = None) -> Column:
    """Every token's three-letter prefix and first letter, sorted and distinct."""
    tokens = _block_tokens(name, extra)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(tokens, lambda t: F.substring(t, 1, 3)), F.transform(tokens, lambda t: F.substring(t, 1, 1))
            )
        )
    )


def block_letters(name: Column, extra: dict[str, str] | None = None) -> Column:
    """First letters only.

    Each block key is a prefix of a token, so two names share a key exactly when they share a first letter: this set
    decides candidacy as well as :func:`block_keys` does, with half the keys.
    """
    tokens = _block_tokens(name, extra)
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 1, 1))))


def canonical_letters(canonical: Column) -> Column:
    """:func:`block_letters` of a name that is canonical already, so needs no romanising."""
    firsts = F.transform(F.split(canonical, " "), lambda t: F.substring(t, 1, 1))
    return F.array_sort(F.array_distinct(F.filter(firsts, lambda c: c != "")))
