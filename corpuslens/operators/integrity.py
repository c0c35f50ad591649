"""Manifest assembly, counts and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numeric import feature_ok
from corpuslens.operators.sampling import exact_fraction


def merge_manifests(
    primary: DataFrame, auxiliary: DataFrame, primary_dir: str, auxiliary_dir: str, aux_frac: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """One manifest over both corpora.

    Auxiliary rows carry no audio, are pinned to train and get their own
    identity namespace, so no component can span the corpora.
    """
    a = primary.withColumns(
        {
            "crop_dir": F.lit(primary_dir),
            "has_audio": F.lit(1),
            "identity_group": F.concat(F.lit("fav::"), "identity_group"),
            "corpus": F.lit("primary"),
        }
    )
    picked = exact_fraction(auxiliary, ["key"], aux_frac, "mixture", seed) if aux_frac < 1.0 else auxiliary
    b = picked.select(
        "key",
        "path",
        F.lit(auxiliary_dir).alias("crop_dir"),
        F.concat(F.lit("FFPP-"), "method").alias("category"),
        F.concat(F.lit("ffpp::"), "identity_group").alias("identity_group"),
        F.col("label").cast("int").alias("video_label"),
        F.lit(0).alias("audio_label"),
        F.lit(0).alias("has_audio"),
        F.lit("auxiliary").alias("corpus"),
        F.lit(1).alias("train_only"),
        F.lit(0).alias("n_valid_faces"),
        F.lit(25.0).alias("fps"),
    )
    return a.unionByName(b, allowMissingColumns=True)


def extraction_status(
    cached: Column, visual_error: Column, n_valid: Column, audio_error: Column, samples: Column, sample_rate: int
) -> Column:
    """First failing rule of a clip's extraction, or ok / cached."""
    return (
        F.when(cached, "cached")
        .when(visual_error, "visual_error")
        .when(F.coalesce(n_valid, F.lit(0)) == 0, "no_faces")
        .when(audio_error, "audio_error")
        .when(F.coalesce(samples, F.lit(0)) < sample_rate // 10, "audio_too_short")
        .otherwise("ok")
    )


def usable(status: Column) -> Column:
    return status.isin("ok", "cached")


def min_valid(df: DataFrame, clip: str, valid: str, k: int) -> DataFrame:
    """(clip, n_valid) of clips with at least k valid frames."""
    n = df.groupBy(clip).agg(F.sum(F.col(valid).cast("bigint")).alias("n_valid"))
    return n.filter(F.col("n_valid") >= k)


def usable_features(df: DataFrame, features: str) -> DataFrame:
    return df.filter(feature_ok(features))


def orphans(manifest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Manifest rows without a stored payload."""
    return manifest.join(stored.select(key).distinct(), key, "left_anti")


def existing(entries: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Entries whose file is listed."""
    return entries.join(listing.select(key), key, "left_semi")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    bad = duplicate_keys(df, key).limit(1).collect()
    if bad:
        raise ValueError(f"duplicate key {bad[0][0]!r}: attach one copy only")
    return df


def missing_families(found: DataFrame, required: DataFrame, family: str) -> DataFrame:
    return required.select(family).subtract(found.select(family))


def require_families(found: DataFrame, required: DataFrame, family: str) -> DataFrame:
    bad = [r[0] for r in missing_families(found, required, family).limit(20).collect()]
    if bad:
        raise ValueError(f"families not found: {sorted(bad)}")
    return found


def corpus_summary(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Row counts over several groupings in one pass, with the set's id."""
    cols = list(dict.fromkeys(x for s in sets for x in s))
    return df.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in cols]).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("n")
    )


def storage_estimate(df: DataFrame, by: Sequence[str], n_bytes: Column, frames: int, size: int) -> DataFrame:
    """Clips, estimated crop bytes (frames * size^2 * 3) and actual bytes."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) * (frames * size * size * 3)).alias("estimated_bytes"),
        F.sum(n_bytes).alias("actual_bytes"),
    )


def tiered_lookup(
    index: DataFrame, tiers: Sequence[tuple[str, DataFrame]], keys: Sequence[str], value: str, fallback: Column,
    fallback_tier: str,
) -> DataFrame:
    """``index`` with ``value`` from the first tier that has it, and its ``tier``."""
    out = index
    for i, (_, table) in enumerate(tiers):
        out = out.join(table.select(*keys, F.col(value).alias(f"_v{i}")), list(keys), "left")
    found = [F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(tiers)]
    return (
        out.withColumn("tier", F.coalesce(*found, F.lit(fallback_tier)))
        .withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tiers))], fallback))
        .drop(*[f"_v{i}" for i in range(len(tiers))])
    )


def tier_share(df: DataFrame, alarm_tier: str, limit: float = 0.05) -> DataFrame:
    """(tier, n, share, alarm): alarm when the weakest tier exceeds the limit."""
    total = df.agg(F.count(F.lit(1))).scalar()
    n = df.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", total)
    share = F.col("n") / F.col("_all")
    return n.select("tier", "n", share.alias("share"), ((F.col("tier") == alarm_tier) & (share > limit)).cast("int").alias("alarm"))


def feature_lookup(
    manifest: DataFrame, features: DataFrame, key: str, trimmed: bool, width: int, n_frames: str, has_audio: str
) -> DataFrame:
    """Cached features per row, the variant chosen when the plan is built.

    Rows without audio read zeros, all frames valid and 25 fps.
    """
    column = "mfcc_trim" if trimmed else "mfcc_full"
    quiet = F.col(has_audio) == 0
    zeros = F.array_repeat(F.lit(0.0), width)
    joined = manifest.join(features.select(key, F.col(column).alias("_f"), F.col("fps").alias("_fps")), key, "left")
    return (
        joined.withColumn("feature", F.when(quiet, zeros).otherwise(F.coalesce("_f", zeros)))
        .withColumn("n_valid", F.when(quiet, F.col(n_frames)).otherwise(F.col("n_valid")))
        .withColumn("fps", F.when(quiet | F.col("_fps").isNull(), F.lit(25.0)).otherwise(F.col("_fps")))
        .drop("_f", "_fps")
    )
