"""Query registry: each entry is a Spark query and, where SQL can say the same, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Tables`` object as a query."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from doctables.workload.fixtures import Tables
            return fn(Tables(spark, sf_dir))
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(run, sql)
        return fn
    return wrap


def load_all() -> dict[str, Entry]:
    from doctables.workload import (  # noqa: F401
        cleaning, export, intake, jobs, matching, pages, quality, schemas, text)
    return REGISTRY
