"""The served watchlists: one row per scoreable name, and what each provider currently serves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.constants import LIST_ORDER, PROVIDER_OF_LIST
from vettra.functions import names
from vettra.functions.binding import bind

MAX_PROVIDERS = 64


@dataclass(frozen=True)
class ProviderState:
    """What one provider answers right now. A degraded provider returns no candidates, and screening goes on."""

    list_type: str
    provider_id: str
    list_version: str = "v1"
    degraded: bool = False


def default_state(version: str = "v1") -> list[ProviderState]:
    return [ProviderState(lt, provider, version) for lt, provider in PROVIDER_OF_LIST.items()]


def state_from(table: DataFrame) -> list[ProviderState]:
    """Read (list_type, provider_id, list_version, status) once, so that a whole batch sees one version.

    One row per provider; more than ``MAX_PROVIDERS`` is an error, not a silent cut.
    """
    rows = table.select("list_type", "provider_id", "list_version", "status").limit(MAX_PROVIDERS + 1).collect()
    if len(rows) > MAX_PROVIDERS:
        raise ValueError(f"more than {MAX_PROVIDERS} providers")
    order = {lt: i for i, lt in enumerate(LIST_ORDER)}
    states = [ProviderState(r[0], r[1], r[2] or "unknown", r[3] == "degraded") for r in rows]
    return sorted(states, key=lambda s: (order.get(s.list_type, len(order)), s.provider_id))


def list_order(list_type: Column) -> Column:
    """Position of a list in query order."""
    return F.coalesce(F.array_position(F.array(*[F.lit(lt) for lt in LIST_ORDER]), list_type), F.lit(0)).cast("int")


def available(entries: DataFrame, state: list[ProviderState]) -> DataFrame:
    """Entries of the providers that answer."""
    return entries.where(F.col("provider_id").isin([s.provider_id for s in state if not s.degraded]))


def entry_letters(entries: DataFrame) -> Column:
    """First letters over the entity name and every alias."""
    every = F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda n: names.block_letters(n)))))


def entry_names(entries: DataFrame) -> DataFrame:
    """One row per entry and distinct canonical name, computed once per list version.

    ``pos`` 0 is the entity name. An alias with the canonical form of an earlier name can never win, so it is dropped.
    """
    every = F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    canonical = F.transform(
        every, lambda n, i: F.struct(i.alias("pos"), n.alias("name"), names.canonical_name(n).alias("cname"))
    )
    first = bind(
        canonical,
        lambda all_names: F.filter(
            all_names, lambda x, i: F.array_position(F.transform(all_names, lambda y: y.cname), x.cname) == i + 1
        ),
    )
    rows = entries.select(
        "entry_id",
        F.col("dob_iso").cast("date").alias("entry_dob"),
        entry_letters(entries).alias("entry_letters"),
        F.explode(first).alias("n"),
    )
    cname = F.col("n.cname")
    return rows.select(
        "entry_id",
        "entry_dob",
        "entry_letters",
        F.col("n.pos").alias("pos"),
        F.col("n.name").alias("entry_name"),
        cname.alias("entry_cname"),
    )
