"""Registry of runnable queries, their fixtures and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The given tables of one scale factor, read lazily, plus fixtures over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            text = SPARK_TEXT.get(name, FIXTURES[name])
            used = {t: getattr(self, t) for t in [*TABLES, *FIXTURES] if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        raise AttributeError(name)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


FIXTURES: dict[str, str] = {}
SPARK_TEXT: dict[str, str] = {}  # only where the two dialects differ
QUERIES: dict[str, Query] = {}


def fixture(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A plain projection, written once in SQL that both engines accept if possible."""
    FIXTURES[name] = sql
    if spark_sql:
        SPARK_TEXT[name] = spark_sql


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in FIXTURES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(FIXTURES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def check_sql(name: str) -> str | None:
    """The DuckDB text of a query, with the fixtures it mentions as CTEs."""
    body = QUERIES[name].sql
    if body is None:
        return None
    used = _needed(body, [])
    if not used:
        return body.strip()
    plain = {t: t for t in [*TABLES, *FIXTURES]}
    ctes = ",\n".join(f"{f} AS ({FIXTURES[f].format(**plain).strip()})" for f in used)
    return f"WITH {ctes}\nSELECT * FROM (\n{body.strip()}\n)"


def load() -> dict[str, Query]:
    from corpuslens.plans import (  # noqa: F401
        fixtures, q_evaluation, q_experiments, q_manifests, q_sampling, q_sequences, q_sources, q_splits,
    )

    return QUERIES
