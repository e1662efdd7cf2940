"""The stored tables of one screening run over a data folder.

Each table is written once per session and folder, as the reference keeps it in its database; later steps read it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.operators import decide, lists, normalize, reconcile, screen
from vettra.plans import fixtures
from vettra.session import stored

BASELINE_AT = "2024-02-01 00:00:00"
RESCREEN_AT = "2024-02-02 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


class Run:
    """Tables of one run, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, limit: int | None = None):
        self.spark, self.sf_dir, self.limit = spark, sf_dir, limit
        self.state = lists.default_state()

    @cached_property
    def raw(self) -> DataFrame:
        """One file a shuffle partition: small files of many rows would be one task in all that follows."""
        return stored(fixtures.submissions(self.spark, self.sf_dir), "raw_profile")

    @cached_property
    def profiles(self) -> DataFrame:
        """Normalized profiles with the screening their message leads to."""
        return stored(
            screen.with_screening_id(normalize.normalize(self.raw), "client_id", "profile_hash"), "normalized_profile"
        )

    @cached_property
    def entries(self) -> DataFrame:
        return stored(fixtures.entries(self.spark, self.sf_dir), "watchlist_entry")

    @cached_property
    def names(self) -> DataFrame:
        return stored(lists.entry_names(self.entries), "watchlist_name")

    @cached_property
    def rules(self) -> DataFrame:
        return decide.rules_table(self.spark)

    @cached_property
    def screened(self) -> screen.Screened:
        return screen.screen(
            self.profiles, self.entries, self.state, self.limit, "k", at(BASELINE_AT), names=self.names
        )

    @cached_property
    def lookup(self) -> DataFrame:
        return self.screened.lookup

    @property
    def match(self) -> DataFrame:
        return self.screened.match

    @cached_property
    def screening(self) -> DataFrame:
        return stored(self.screened.screening, "screening")

    @cached_property
    def decision(self) -> DataFrame:
        return stored(decide.decide(self.screening, self.match, self.rules, at(BASELINE_AT)), "decision")

    @cached_property
    def audit(self) -> DataFrame:
        return stored(decide.audit(self.screening, self.match, self.decision, self.rules), "audit")

    @cached_property
    def updates(self) -> DataFrame:
        return stored(fixtures.updates(self.spark, self.sf_dir), "watchlist_update")

    @cached_property
    def reconciled(self) -> reconcile.Reconciled:
        """The list updates applied and the affected clients screened and decided again."""
        return reconcile.reconcile(
            profiles=self.profiles,
            entries=self.entries,
            screening=self.screening,
            decision=self.decision,
            updates=self.updates,
            state=self.state,
            rules=self.rules,
            limit=self.limit,
            clock=at(RESCREEN_AT),
            match=self.match,
        )


_RUNS: dict[tuple, Run] = {}


def run_for(spark: SparkSession, sf_dir: str, limit: int | None = None) -> Run:
    """The run of this session over ``sf_dir``; started afresh when its files are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, limit)
    run = _RUNS.get(key)
    if run is not None and "raw" in vars(run):
        try:
            for table in [t for t in vars(run).values() if isinstance(t, DataFrame)]:
                if table.inputFiles():
                    spark.read.parquet(table.inputFiles()[0]).schema  # noqa: B018
        except AnalysisException:
            run = None
    if run is None:
        run = _RUNS[key] = Run(spark, sf_dir, limit)
    return run
