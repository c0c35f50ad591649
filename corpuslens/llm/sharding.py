"""Shards of a corpus in Hilbert-curve order of its metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.order import numbered

BITS = 8  # cells per dimension: 2 ** BITS


def quantised(value: Column, low: float, high: float, bits: int = BITS) -> Column:
    """The cell of a number between ``low`` and ``high``; null and lower values are in the first, higher ones in the last."""
    cell = F.floor((value.cast("double") - low) / (high - low) * (1 << bits))
    return F.least(F.greatest(F.coalesce(cell, F.lit(0)), F.lit(0)), F.lit((1 << bits) - 1)).cast("bigint")


def named_cell(value: Column, bits: int = BITS) -> Column:
    """The cell of a name, by its crc32; null is in the first."""
    return F.coalesce(F.pmod(F.crc32(value), F.lit(1 << bits)), F.lit(0)).cast("bigint")


def hilbert_index(df: DataFrame, dims: Sequence[str], name: str, bits: int = BITS) -> DataFrame:
    """Add the position of each row's cell on the Hilbert curve through ``dims`` (integers below 2 ** bits).

    The coordinates are turned into the curve's transposed form one bit plane
    at a time, each plane in its own projection so that expressions stay
    short, and the planes are then interleaved.
    """
    n = len(dims)
    axes = [f"_axis{i}" for i in range(n)]
    out = df.select("*", *[F.col(d).cast("bigint").alias(a) for d, a in zip(dims, axes, strict=True)])
    for plane in range(bits - 1, 0, -1):
        low = F.lit((1 << plane) - 1)
        for i in range(n):
            here, head = F.col(axes[i]), F.col(axes[0])
            is_set = here.bitwiseAND(F.lit(1 << plane)) != 0
            swap = head.bitwiseXOR(here).bitwiseAND(low)
            # A set bit turns the first axis over; a clear one exchanges it with this axis.
            turned = {axes[0]: F.when(is_set, head.bitwiseXOR(low)).otherwise(head.bitwiseXOR(swap))}
            if i:
                turned[axes[i]] = F.when(is_set, here).otherwise(here.bitwiseXOR(swap))
            out = out.withColumns(turned)
    for i in range(1, n):
        out = out.withColumn(axes[i], F.col(axes[i]).bitwiseXOR(F.col(axes[i - 1])))
    flip: Column = F.lit(0).cast("bigint")
    for plane in range(bits - 1, 0, -1):
        is_set = F.col(axes[-1]).bitwiseAND(F.lit(1 << plane)) != 0
        flip = flip.bitwiseXOR(F.when(is_set, F.lit((1 << plane) - 1)).otherwise(F.lit(0)))
    out = out.withColumn("_flip", flip)
    index: Column = F.lit(0).cast("bigint")
    for plane in range(bits):
        for i, a in enumerate(axes):
            bit = F.shiftright(F.col(a).bitwiseXOR(F.col("_flip")), plane).bitwiseAND(F.lit(1))
            index = index.bitwiseOR(F.shiftleft(bit, plane * n + n - 1 - i))
    return out.withColumn(name, index).drop(*axes, "_flip")


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, source_cell, lang_cell, size_cell).

    Source, language and size are quantised and laid on one Hilbert curve; the
    curve is cut into ``shards`` runs whose row counts differ by one at most
    (law ``rows``), so that a filter on any of the three skips most shards.
    ``slot`` counts from 0 in each shard.  Ties on the curve go by the text's
    crc32, size and doc_id; a null doc_id comes first.  A null text has size 1
    and crc32 0; nulls in other columns are in the first cell; repeated rows
    each have a slot; extra columns aren't read; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    slim = docs.select(
        F.col("doc_id"), size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
        named_cell(F.col("source")).alias("source_cell"), named_cell(F.col("lang")).alias("lang_cell"),
        quantised(F.log2(size), 0, 24).alias("size_cell"),
    )
    placed = hilbert_index(slim, ["source_cell", "lang_cell", "size_cell"], "curve")
    order = [F.col(c).asc_nulls_first() for c in ("curve", "text_crc32", "size", "doc_id")]
    ranked = numbered(placed, order, total="_total")
    return (
        ranked.withColumn("shard", F.expr(f"cast(position * {shards} div _total as int)"))
        .withColumn("slot", F.expr(f"position - (shard * _total + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                F.lit(None).cast("int").alias("grown_shard"), "curve", "source_cell", "lang_cell", "size_cell")
    )
