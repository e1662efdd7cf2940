"""Raw KYC rows to canonical profiles, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fields, names, translit


def normalize(raw: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Canonicalise columns full_name, dob, nationality, residence_country, document_ids; other columns are kept.

    Adds canonical_name, name_parts, dob_iso, nationality_iso2, residence_iso2, profile_hash, transliterated,
    dropped_letters and fields_defaulted; document_ids becomes an empty array where it is null.
    """
    kept = [c for c in raw.columns if c not in ("full_name", "dob", "nationality", "residence_country", "document_ids")]
    full_name = F.coalesce("full_name", F.lit(""))
    stage = raw.select(
        *kept,
        names.canonical_name(full_name, extra).alias("canonical_name"),
        fields.parse_dob(F.col("dob")).alias("dob_iso"),
        fields.country_iso2(F.col("nationality"), extra).alias("nationality_iso2"),
        fields.country_iso2(F.col("residence_country"), extra).alias("residence_iso2"),
        F.coalesce("document_ids", F.array().cast(raw.schema["document_ids"].dataType)).alias("document_ids"),
        translit.was_transliterated(full_name).alias("transliterated"),
        translit.dropped_letters(full_name, extra).alias("dropped_letters"),
    )
    return stage.select(
        "*",
        names.name_parts(F.col("canonical_name")).alias("name_parts"),
        fields.profile_hash(F.col("canonical_name"), F.col("dob_iso"), F.col("nationality_iso2")).alias("profile_hash"),
        fields_defaulted().alias("fields_defaulted"),
    )


def is_unreadable(full_name: Column, extra: dict[str, str] | None = None) -> Column:
    """A name that lost letters and of which nothing is left: it can match no list, so it must not pass as clear."""
    name = F.coalesce(full_name, F.lit(""))
    return (translit.dropped_letters(name, extra) > 0) & (names.canonical_name(name, extra) == "")


def fields_defaulted() -> Column:
    """Names of the fields that could not be read, in fixed order."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("dob_iso", "nationality_iso2", "residence_iso2")]
    return F.filter(F.array(*missing), lambda c: c.isNotNull())


def normalized_payload() -> Column:
    """What ``profile.normalized`` carries."""
    return F.struct(
        "profile_hash",
        "canonical_name",
        "name_parts",
        F.col("dob_iso").cast("string").alias("dob_iso"),
        "nationality_iso2",
        "residence_iso2",
        "document_ids",
    )


def golden_expected() -> Column:
    """What a golden normalization row expects."""
    return F.struct(
        "canonical_name",
        "name_parts",
        F.col("dob_iso").cast("string").alias("dob_iso"),
        "nationality_iso2",
        "residence_iso2",
        "profile_hash",
    )
