"""Registry of queries and the frames they share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanweave.operators import features as feat
from loanweave.operators import silver
from loanweave.plans import derived
from loanweave.plans.oracle import decimals, statement
from loanweave.storage import WIDE_PROJECTIONS

CUTOFF = dt.date(2001, 12, 1)
# Vintages of the derived panel: 1994 to 2001.
TRAIN_END, VALIDATION_END = 1997, 1999


@dataclass
class Context:
    """The data directory a query runs on, and the frames derived from it."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        # Frames are run after they are built, so this setting stays with the session.
        for key, value in WIDE_PROJECTIONS.items():
            self.spark.conf.set(key, value)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stored(self) -> silver.StoredPanel:
        return derived.panel(self.spark, self.sf_dir)

    @property
    def panel(self) -> DataFrame:
        return self.stored.table

    def panel_of(self, columns: Sequence[str]) -> silver.StoredPanel:
        """The panel for a use that needs no other ``columns``."""
        return derived.panel(self.spark, self.sf_dir, tuple(columns))

    @property
    def history(self) -> int:
        return self.stored.history

    @cached_property
    def latest(self) -> DataFrame:
        """Active loans of the last period."""
        return silver.panel_as_of(self.panel)

    @cached_property
    def origination(self) -> DataFrame:
        return derived.silver_origination(self.spark, self.sf_dir)

    @cached_property
    def performance(self) -> DataFrame:
        return derived.silver_performance(self.spark, self.sf_dir)

    @cached_property
    def snapshots(self) -> DataFrame:
        stored = self.panel_of(feat.SNAPSHOT_COLUMNS)
        return feat.model_snapshots(stored.table, stored.history)


Build = Callable[[Context], DataFrame]


def published(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Doubles rounded to the digits that summation order cannot change; no negative zero."""
    digits = digits or {}
    return df.select(
        *[
            (F.round(f.name, digits.get(f.name, decimals(f.name))) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


@dataclass
class Catalog:
    builds: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(
        self,
        name: str,
        build: Build,
        sql: str | None = None,
        floats: str = "",
        ctes: str = "",
        digits: dict[str, int] | None = None,
        recursive: bool = False,
    ) -> None:
        if name in self.builds:
            raise ValueError(f"query {name} registered twice")
        self.builds[name] = lambda spark, sf_dir: published(build(Context(spark, sf_dir)), digits)
        if sql is not None:
            self.sql[name] = statement(sql, floats, ctes, digits, recursive)
