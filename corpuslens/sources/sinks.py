"""Manifest, feature, result and key-list sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import AUXILIARY_SCHEMA, PRIMARY_SCHEMA


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def write_manifest(df: DataFrame, path: str, schema: str = PRIMARY_SCHEMA) -> None:
    """CSV with fixed columns, totally ordered by key over its part files."""
    df.select(*_columns(schema)).orderBy("key").write.mode("overwrite").csv(path, header=True)


def write_auxiliary_manifest(df: DataFrame, path: str) -> None:
    write_manifest(df, path, AUXILIARY_SCHEMA)


def write_features(df: DataFrame, path: str, partition: str = "corpus") -> None:
    """Feature records, one row per key, in columnar files per corpus."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def write_results(df: DataFrame, path: str, raw: Sequence[str] = ("y_true", "y_score")) -> None:
    """JSON results without raw scores."""
    df.drop(*raw).write.mode("overwrite").json(path)


def append_results(df: DataFrame, path: str, fields: Sequence[str], arm: str = "arm") -> None:
    """Store the rows of one or more arms, each in a folder of its own, so that an arm stored again replaces itself.

    Columns outside ``fields`` are ignored, missing ones are NULL.
    """
    have = set(df.columns)
    row = [F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]
    out = df.select(*row).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(arm).csv(path, header=True)


def write_keys(df: DataFrame, path: str, key: str = "key") -> None:
    df.select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """(split, position, key) in one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
