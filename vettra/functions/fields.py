"""Dates, countries, versions and hashed identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vettra.constants import COUNTRY_BY_NAME, COUNTRY_CODES
from vettra.functions.names import stripped
from vettra.functions.translit import literal_map, transliterate

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DAY_FIRST_DATE = r"^([0-9]{1,2})([/.])([0-9]{1,2})\2([0-9]{4})$"
ISO_COUNTRY = r"^[A-Z]{2}$"


def _calendar_date(iso_text: Column) -> Column:
    day = iso_text.try_cast("date")
    return F.when(F.year(day) >= 1, day)


def parse_dob(raw: Column) -> Column:
    """``yyyy-mm-dd``, ``d/m/yyyy`` or ``d.m.yyyy`` to a date; anything else, or no such day, is null."""
    text = stripped(raw)
    day_first = F.concat_ws(
        "-",
        F.regexp_extract(text, DAY_FIRST_DATE, 4),
        F.lpad(F.regexp_extract(text, DAY_FIRST_DATE, 3), 2, "0"),
        F.lpad(F.regexp_extract(text, DAY_FIRST_DATE, 1), 2, "0"),
    )
    return _calendar_date(F.when(text.rlike(ISO_DATE), text).when(text.rlike(DAY_FIRST_DATE), day_first))


def is_iso_date(text: Column) -> Column:
    """True for a real calendar day written ``yyyy-mm-dd``."""
    return F.coalesce(text.rlike(ISO_DATE) & _calendar_date(text).isNotNull(), F.lit(False))


def country_iso2(raw: Column, extra: dict[str, str] | None = None) -> Column:
    """A known two-letter code, or the code of a known country name; else null."""
    text = stripped(raw)
    # 74 names, fixed: a literal map, so no join and no shuffle.
    table = literal_map(COUNTRY_BY_NAME)
    spaced = F.trim(F.regexp_replace(F.lower(transliterate(text, extra)), r"[\s\x1c-\x1f]+", " "))
    code = F.upper(text)
    return F.when((F.length(text) == 2) & F.array_contains(F.split(F.lit(" ".join(COUNTRY_CODES)), " "), code), code).otherwise(
        F.try_element_at(table, F.btrim(spaced, F.lit(".")))
    )


def profile_hash(canonical: Column, dob: Column, nationality: Column) -> Column:
    """sha256 over name, birth date and nationality. Residence and documents do not change who is screened."""
    empty = F.lit("")
    return F.sha2(
        F.concat_ws("|", canonical, F.coalesce(dob.cast("string"), empty), F.coalesce(nationality, empty)), 256
    )


def name_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def message_key(trace_id: Column, topic: Column, partition: Column, offset: Column) -> Column:
    """Identity of one delivered message."""
    return F.concat_ws(":", trace_id, topic, partition.cast("string"), offset.cast("string"))


def version_key(version: Column) -> Column:
    """``v3`` -> 3; missing or odd text sorts first, as 0."""
    digits = F.regexp_replace(version, "^[vV]+", "")
    return F.coalesce(F.when(digits.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(digits).try_cast("bigint")), F.lit(0))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id that a rerun reproduces, so that a replayed batch overwrites instead of adding."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))
