"""Domain tables: derived from the test parquet or loaded from real extracts."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from churnlab.sources import fixtures
from churnlab.sources.extracts import SchemaDrift, load_extracts
from churnlab.sources.warehouse import Warehouse

DOMAIN_TABLES = ("sales", "tickets", "service_orders", "discounts", "retention_tickets")


class DomainTables:
    """Lazily built domain DataFrames (a plan is only built when a query asks)."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._plans: dict[object, DataFrame] = {}
        # names of the bucketed tables written for these
        self.tables: list[str] = []
        # memo key of an anchor set -> its earliest and latest day, where measured
        self.reach: dict[object, tuple[datetime.date | None, datetime.date | None]] = {}

    def memo(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived plan built once per key (e.g. an anchor set under one rule
        set).  Plans are lazy and immutable, so queries can share them; only
        the Python-side construction is saved, no data is held."""
        if key not in self._plans:
            self._plans[key] = build()
        return self._plans[key]

    def _get(self, name: str) -> DataFrame:
        return self._builders[name]()

    @cached_property
    def sales(self) -> DataFrame:
        return self._get("sales")

    @cached_property
    def tickets(self) -> DataFrame:
        return self._get("tickets")

    @cached_property
    def service_orders(self) -> DataFrame:
        return self._get("service_orders")

    @cached_property
    def discounts(self) -> DataFrame:
        return self._get("discounts")

    @cached_property
    def retention_tickets(self) -> DataFrame:
        return self._get("retention_tickets")

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "DomainTables":
        return cls({name: (lambda f=getattr(fixtures, name): f(spark, sf_dir)) for name in DOMAIN_TABLES})

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> "DomainTables":
        return cls({name: (lambda df=df: df) for name, df in frames.items()})

    @classmethod
    def from_extracts(cls, spark: SparkSession, paths: Mapping[str, str], **kw) -> "DomainTables":
        return cls.from_frames(load_extracts(spark, paths, **kw))


    @classmethod
    def from_warehouse(cls, spark: SparkSession, names: Iterable[str] | Mapping[str, str], root: str | None = None, **kw) -> "DomainTables":
        """Tables from extracts named as the warehouse names them (:class:`Warehouse`)."""
        return cls.from_frames(Warehouse(spark, root, **kw).tables(names))


__all__ = ["DOMAIN_TABLES", "DomainTables", "SchemaDrift", "Warehouse"]
