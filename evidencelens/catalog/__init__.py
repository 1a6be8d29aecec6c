"""Named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``ids`` are the inventory rows it demonstrates."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql:
            SQL[name] = sql
        return fn

    return wrap


MODULES = (
    "history", "keypoints", "scores", "folds", "contracts", "records", "cohorts", "instances", "clusters", "files", "models",
    "streams",
)


def load() -> None:
    for module in MODULES:
        try:
            importlib.import_module(f"evidencelens.catalog.{module}")
        except ModuleNotFoundError as exc:
            if exc.name != f"evidencelens.catalog.{module}":
                raise
