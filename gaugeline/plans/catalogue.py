"""Every query of the engine with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when imported.
MODULES = ("analytics", "corpus", "review", "ingest", "partition", "scoring")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with the SQL that must give the same rows."""

    def keep(build: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return keep


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"gaugeline.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
