"""Registry of runnable queries: each couples a Spark builder with an optional check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    inventory: tuple[str, ...]
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, *inventory: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under `name` for the given inventory ids."""

    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, inventory, build, sql.strip() if sql else None)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
