"""Gapless positions in a global order, without one ordered task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.session import cut_lineage


def numbered(
    df: DataFrame, order: Sequence[Column], name: str = "position", sums: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """Add the 0-based ``name`` of each row in ``order``, ``<c>_before`` for each of ``sums``, and the row count ``total``.

    Rows are dealt into ranges, sorted there and written once, so that later
    passes see the same ranges.  A row's place is its place in its range plus
    what lies in earlier ranges; the table of ranges has one row per task and
    is broadcast.  Rows equal in ``order`` meet in one task, so ``order`` must
    end with a key.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_range"), local.alias("_local")), "ordered")
    totals = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(W.partitionBy()).alias("_all"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in sums],
    )
    out = rows.join(F.broadcast(starts), "_range")
    within = W.partitionBy("_range").orderBy("_local").rowsBetween(W.unboundedPreceding, -1)
    return out.select(
        *[F.col(c) for c in df.columns],
        (F.col("_start") + F.col("_local")).alias(name),
        *[(F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums],
        *([F.col("_all").alias(total)] if total else []),
    )
