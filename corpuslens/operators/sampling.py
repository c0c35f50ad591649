"""Seeded, order-independent sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.hashing import tag_hash, uniform
from corpuslens.plans.prefix import bucketed_rank, seeded_rank, with_group_stats


def seeded_shuffle(df: DataFrame, key: Sequence[str], tag: str, seed: int = 42, position: str = "position") -> DataFrame:
    """``df`` with its 1-based place in the shuffle."""
    return seeded_rank(df, key, tag, seed, rank=position)


def seeded_top(df: DataFrame, key: Sequence[str], n: int, tag: str, seed: int = 42) -> DataFrame:
    """The first n rows of the shuffle (a distributed top-n, no full sort)."""
    return df.orderBy(tag_hash(tag, seed, *key), *key).limit(n)


def category_cap(
    df: DataFrame, key: Sequence[str], category: str, caps: dict[str, int], tag: str, seed: int = 42
) -> DataFrame:
    """At most ``caps[c]`` rows of each capped category; the others are kept whole."""
    cap = F.col("n_total")
    for name, k in caps.items():
        cap = F.when(F.col(category) == name, F.lit(k)).otherwise(cap)
    return seeded_rank(df, key, tag, seed, by=[category], rank="_r", keep_below=cap).drop("_r")


def class_quota(
    df: DataFrame, key: Sequence[str], label: str, quota: int, ok: Column, tag: str, seed: int = 42
) -> DataFrame:
    """``quota`` rows per class, counted after the success filter."""
    return seeded_rank(df.filter(ok), key, tag, seed, by=[label], rank="_r", keep_below=F.lit(quota)).drop("_r")


def exact_fraction(df: DataFrame, key: Sequence[str], frac: float, tag: str, seed: int = 42) -> DataFrame:
    """Exactly round(n * frac) rows (half to even)."""
    cut = F.bround(F.col("n_total") * frac, 0)
    return seeded_rank(df, key, tag, seed, rank="_r", keep_below=cut).drop("_r")


def k_per_group(
    df: DataFrame, key: Sequence[str], by: Sequence[str], k: int, ok: Column, tag: str, seed: int = 42
) -> DataFrame:
    """k rows per group without replacement; groups with fewer are dropped."""
    good = df.filter(ok)
    picked = seeded_rank(
        good,
        key,
        tag,
        seed,
        by=by,
        rank="_r",
        keep_below=F.when(F.col("n_total") >= k, F.lit(k)).otherwise(F.lit(0)),
    )
    return picked.drop("_r")


def middle_of_group(df: DataFrame, by: Sequence[str], order: str, bucket: Column) -> DataFrame:
    """The element at 0-based position n // 2 of each group in ``order``.

    ``bucket`` is a monotone coarsening of ``order`` such as ``order / 4096``.
    """
    target = F.floor(F.col("n_total") / 2) + 1
    ranked = bucketed_rank(df, lambda _: bucket, [F.col(order)], by, rank="_r", total="_n", keep_below=target)
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")


def bernoulli_relabel(df: DataFrame, key: Sequence[str], label: str, p: float, ok: Column, seed: int = 42) -> DataFrame:
    """Turn eligible real rows into fakes with probability p."""
    hit = (F.col(label) == 0) & ok & (uniform("relabel", seed, *key) < p)
    return df.withColumn("relabelled", hit.cast("int")).withColumn(label, F.when(hit, 1).otherwise(F.col(label)))


def frame_dropout(df: DataFrame, clip: str, frame: str, valid: str, p: float = 0.1, seed: int = 42) -> DataFrame:
    """Invalidate a share of valid frames, unless that would leave none.

    A clip with no valid frame at all gets its first frame forced valid.
    """
    drawn = df.withColumn("_drop", F.col(valid) & (uniform("drop", seed, clip, frame) < p))
    stats = with_group_stats(
        drawn,
        [clip],
        _left=F.max((F.col(valid) & ~F.col("_drop")).cast("int")),
        _any=F.max(F.col(valid).cast("int")),
        _first=F.min(frame),
    )
    kept = F.col(valid) & ~(F.col("_drop") & (F.col("_left") == 1))
    forced = (F.col("_any") == 0) & (F.col(frame) == F.col("_first"))
    return stats.withColumn(valid, kept | forced).drop("_drop", "_left", "_any", "_first")
