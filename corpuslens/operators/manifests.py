"""From a file listing to extraction jobs and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.operators.identity import identity_groups
from corpuslens.operators.sampling import category_cap
from corpuslens.session import cut_lineage
from corpuslens.sources.listing import FAMILIES, exclude_tokens


def primary_jobs(
    listed: DataFrame, caps: dict[str, int], exclude: Sequence[str], seed: int = 42
) -> DataFrame:
    """(key, path, category, identity_group, labels) of the clips to extract.

    ``exclude`` lists tokens of other corpora's paths.  Exclusion and caps come before anything expensive downstream; identity
    groups see every candidate, capped or not.
    """
    pool = exclude_tokens(listed.select("path"), exclude).withColumn("category", P.category("path"))
    pool = identity_groups(pool.withColumn("tokens", P.identity_tokens("path"))).drop("tokens")
    pool = cut_lineage(pool, "pool")  # the caps count it before they take from it
    real = P.clip_label("path") == 0
    fakes = category_cap(pool.filter(~real), ["path"], "category", caps, "category_sample", seed)
    picked = pool.filter(real).unionByName(fakes.select(*pool.columns))
    return picked.select(
        P.sample_key("category", "identity_group", "path").alias("key"),
        "path",
        "category",
        "identity_group",
        P.video_label("category").alias("video_label"),
        P.audio_label("category").alias("audio_label"),
    )


def auxiliary_manifest(found: DataFrame, cap_per_family: int | None = None, seed: int = 42) -> DataFrame:
    """Manifest of (family, path) rows; capped families leave originals whole.

    Keys carry the family name, because families share file names; check them
    with ``require_unique`` before writing.
    """
    rows = found
    if cap_per_family:
        rows = category_cap(found, ["path"], "family", {f: cap_per_family for f in FAMILIES[1:]}, "families", seed)
    rows = rows.select(
        F.concat_ws("_", "family", P.stem("path")).alias("key"),
        "path",
        F.col("family").alias("method"),
        (F.col("family") != FAMILIES[0]).cast("int").alias("label"),
        P.target_id("path").alias("target_id"),
        P.source_id("path").alias("source_id"),
        P.pair_tokens("path").alias("tokens"),
    )
    return identity_groups(rows).drop("tokens")
