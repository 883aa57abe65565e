"""Registry of checked queries: a Spark query and, where SQL can say it, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.catalog.domain import Domain

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Domain], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = sql


def us(name: str, alias: str | None = None) -> Column:
    """A timestamp as epoch microseconds: equal in both engines, whatever the time zone."""
    return F.unix_micros(F.col(name).cast("timestamp")).alias(alias or f"{name}_us")


def r(name: str, digits: int = 6, alias: str | None = None) -> Column:
    """A double rounded for comparison: half up, decided on ten digits; -0.0 becomes 0.0."""
    return (F.round(F.round(F.col(name), 10), digits) + F.lit(0.0)).alias(alias or name)


def catalogue() -> Registry:
    """All registered queries."""
    import importlib
    import pkgutil

    import devicelens.catalog as package

    reg = Registry()
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        register = getattr(importlib.import_module(f"devicelens.catalog.{module}"), "register", None)
        if register is not None:
            register(reg)
    return reg
