"""Train/val/test splits, leak checks and split files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.hashing import hash_bucket, tag_hash
from corpuslens.plans.prefix import salted_join, bucket_starts, hash_rank, seeded_rank
from corpuslens.session import cut_lineage

NAMES = ("train", "val", "test")
HEAVY_PIECES = 1000  # a group above 1 / pieces of the rows is packed by deficit; there are fewer than pieces


def _share_to_split(share: Column, fracs: Sequence[float]) -> Column:
    return F.when(share < fracs[0], NAMES[0]).when(share < fracs[0] + fracs[1], NAMES[1]).otherwise(NAMES[2])


def assign_groups(
    sizes: DataFrame, group: str = "identity_group", fracs: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    """(group, n, split) so that row shares come close to ``fracs``.

    Groups lie end to end in seeded order on a line as long as the row count,
    and a group goes to the split that holds its midpoint.  Groups larger than
    half the smallest share come first (there are at most a few), so a giant
    component lands in train rather than swallowing val or test.
    """
    small = min(f for f in fracs if f > 0) / 2
    total = sizes.agg(F.sum("n")).scalar()
    h = tag_hash("split", seed, group)
    tagged = (
        sizes.withColumn("_all", total)
        .withColumn("_big", (F.col("n") > F.col("_all") * small).cast("int"))
        .withColumn("_h", F.concat(F.when(F.col("_big") == 1, "0").otherwise("1"), h))
        .withColumn("_bucket", hash_bucket(F.col("_h"), 4))
    )
    starts = bucket_starts(tagged, [], "_bucket", {"n": F.sum("n")})
    inside = W.partitionBy("_bucket").orderBy("_h", group).rowsBetween(W.unboundedPreceding, -1)
    placed = tagged.join(F.broadcast(starts), "_bucket", "left").withColumn(
        "_before", F.col("_n_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    mid = (F.col("_before") + F.col("n") / 2.0) / F.col("n_total")
    return placed.select(group, "n", _share_to_split(mid, fracs).alias("split"))


def _largest_deficit(groups: Column, fracs: Sequence[float], total: Column) -> Column:
    """(counts, place) after a walk over sorted (hash, group, n): each goes to the split furthest below its target.

    ``place`` numbers the split of each group from 1; the first of equal splits is taken.
    """
    targets = F.array(*[F.lit(f) * total for f in fracs])

    def step(state: Column, item: Column) -> Column:
        room = F.zip_with(targets, state["counts"], lambda t, c: t - c)
        k = F.array_position(room, F.array_max(room)).cast("int")
        counts = F.transform(state["counts"], lambda c, i: c + F.when(i + 1 == k, item["n"]).otherwise(0))
        return F.struct(counts.alias("counts"), F.concat(state["place"], F.array(k)).alias("place"))

    none = F.array(*[F.lit(0).cast("bigint") for _ in fracs]).alias("counts")
    return F.aggregate(groups, F.struct(none, F.array().cast("array<int>").alias("place")), step)


def pack_groups(
    sizes: DataFrame, group: str = "identity_group", fracs: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    """(group, n, split): heavy groups by largest deficit, the others by midpoint in the room that is left.

    Groups above 1 / ``HEAVY_PIECES`` of the rows are walked in seeded order,
    each to the split furthest below its target; there are fewer than
    ``HEAVY_PIECES``, so one array holds them.  The other groups lie end to end
    in seeded order on a line that is shared by what the splits still miss; a
    split that the heavy groups overfill gets none of them.
    """
    # Sums, the heavy and the other groups all read it.
    stored = cut_lineage(sizes.select(group, F.col("n").cast("bigint").alias("n")), "groups")
    tagged = stored.withColumn("_all", stored.agg(F.sum("n")).scalar()).withColumn("_h", tag_hash("split", seed, group))
    heavy = F.col("n") * HEAVY_PIECES > F.col("_all")
    listed = tagged.filter(heavy).agg(
        F.sort_array(F.collect_list(F.struct("_h", group, "n"))).alias("_groups"), F.max("_all").alias("_all")
    )
    walked = listed.withColumn("_end", _largest_deficit(F.col("_groups"), fracs, F.coalesce("_all", F.lit(0))))
    placed = walked.select(F.inline(F.arrays_zip(F.col("_groups").alias("g"), F.col("_end.place").alias("k")))).select(
        f"g.{group}", "g.n", F.element_at(F.array(*map(F.lit, NAMES)), F.col("k")).alias("split")
    )
    # One row of counts; without heavy groups all are 0.
    counts = walked.select("_end.counts")
    room = [F.greatest(F.lit(0.0), F.lit(f) * F.col("_all") - F.get("counts", F.lit(i))) for i, f in enumerate(fracs)]
    light = tagged.filter(~heavy).withColumn("_bucket", hash_bucket(F.col("_h"), 4))
    starts = bucket_starts(light, [], "_bucket", {"n": F.sum("n")})
    inside = W.partitionBy("_bucket").orderBy("_h", group).rowsBetween(W.unboundedPreceding, -1)
    lined = (
        light.join(F.broadcast(starts), "_bucket", "left")
        .withColumn("counts", counts.scalar())
        .withColumn("_before", F.col("_n_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("_mid", (F.col("_before") + F.col("n") / 2.0) / F.col("n_total"))
        .withColumn("_room", F.array(*room))
    )
    share = F.col("_mid") * (F.get("_room", F.lit(0)) + F.get("_room", F.lit(1)) + F.get("_room", F.lit(2)))
    train, val = F.get("_room", F.lit(0)), F.get("_room", F.lit(0)) + F.get("_room", F.lit(1))
    split = F.when(share < train, NAMES[0]).when(share < val, NAMES[1]).otherwise(NAMES[2])
    return placed.unionByName(lined.select(group, "n", split.alias("split")))


def group_split(
    df: DataFrame,
    group: str = "identity_group",
    fracs: Sequence[float] = (0.6, 0.2, 0.2),
    seed: int = 42,
    train_only: str | None = None,
    greedy: bool = False,
) -> DataFrame:
    """``df`` with ``split``; no group of the packed rows spans two splits.

    Rows whose ``train_only`` flag is 1 are pinned to train and take no part
    in the packing, so val and test are the same with or without them.
    ``greedy`` packs by :func:`pack_groups`, whose shares come closer where
    groups are heavy.
    """
    pinned = F.coalesce(F.col(train_only).cast("int"), F.lit(0)) == 1 if train_only else F.lit(False)
    packed = df.filter(~pinned) if train_only else df
    sizes = packed.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = (pack_groups if greedy else assign_groups)(sizes, group, fracs, seed).select(group, F.col("split").alias("_split"))
    joined = df.join(placed, group, "left")
    return joined.withColumn("split", F.when(pinned, F.lit("train")).otherwise(F.col("_split"))).drop("_split")


def split_leaks(df: DataFrame, group: str = "identity_group") -> DataFrame:
    """Groups present in more than one split; empty for a sound split."""
    per = df.groupBy(group).agg(
        *[F.sum((F.col("split") == s).cast("bigint")).alias(f"n_{s}") for s in NAMES]
    )
    spread = sum(((F.col(f"n_{s}") > 0).cast("int") for s in NAMES), F.lit(0))
    return per.filter(spread > 1)


def assert_no_leaks(df: DataFrame, group: str = "identity_group") -> DataFrame:
    """``df`` itself; raises when a group (pinned rows included) leaks."""
    bad = split_leaks(df, group).limit(5).select(group).collect()
    if bad:
        raise ValueError(f"groups in more than one split: {[r[0] for r in bad]}")
    return df


def row_split(
    df: DataFrame, key: Sequence[str], fracs: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    """Per-row random split with floor cuts: the leaky control."""
    ranked = seeded_rank(df, key, "rows", seed, rank="_r", total="_n")
    a = F.floor(F.col("_n") * fracs[0])
    b = F.floor(F.col("_n") * (fracs[0] + fracs[1]))
    split = F.when(F.col("_r") <= a, NAMES[0]).when(F.col("_r") <= b, NAMES[1]).otherwise(NAMES[2])
    return ranked.withColumn("split", split).drop("_r", "_n")


def official_split(df: DataFrame, ids: DataFrame, target: str = "target_id", source: str = "source_id") -> DataFrame:
    """``df`` with ``split`` (train / val, held-out = val and test) and ``violation``.

    ``ids`` is (split, id).  A violation is a target the file does not list or
    a source outside its target's side.
    """
    side = ids.groupBy("id").agg(
        F.max((F.col("split") == "train").cast("int")).alias("_in_train"),
        F.max((F.col("split") != "train").cast("int")).alias("_in_held"),
    )
    side = side.select("id", F.when(F.col("_in_train") == 1, "train").otherwise("val").alias("_side"),
                       (F.col("_in_train") + F.col("_in_held") > 1).alias("_both"))
    t = side.select(F.col("id").alias(target), F.col("_side").alias("_t"), "_both")
    s = side.select(F.col("id").alias(source), F.col("_side").alias("_s"))
    joined = salted_join(salted_join(df, t, [target], "left"), s, [source], "left")
    has_source = F.col(source).isNotNull() & (F.col(source).cast("string") != "")
    problem = (
        F.when(F.col("_t").isNull(), "unknown_target")
        .when(F.col("_both"), "listed_twice")
        .when(has_source & ~F.col("_s").eqNullSafe(F.col("_t")), "crosses_splits")
    )
    return joined.withColumn("split", F.col("_t")).withColumn("violation", problem).drop("_t", "_s", "_both")


def require_official(df: DataFrame) -> DataFrame:
    """Fail on the first violation of :func:`official_split`."""
    bad = df.filter(F.col("violation").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"official split violated: {bad[0].asDict()}")
    return df.drop("violation")


def target_split(
    df: DataFrame, target: str = "target_id", train_frac: float = 0.85, seed: int = 42
) -> DataFrame:
    """Fallback split on target ids: train / val without crossing targets."""
    ids = df.select(target).distinct()
    ranked = seeded_rank(ids, [target], "targets", seed, rank="_r", total="_n")
    cut = F.greatest(F.lit(1), F.bround(F.col("_n") * train_frac, 0).cast("bigint"))
    side = ranked.select(target, F.when(F.col("_r") <= cut, "train").otherwise("val").alias("split"))
    return df.join(side, target)


def source_leakage(df: DataFrame, target: str = "target_id", source: str = "source_id") -> DataFrame:
    """Val rows whose source id occurs in train as a target or a source."""
    train = df.filter(F.col("split") == "train")
    known = train.select(F.explode(F.array(F.col(target).cast("string"), F.col(source).cast("string"))).alias("_id"))
    known = known.filter("_id is not null and _id != ''").distinct()
    val = df.filter(F.col("split") == "val").withColumn("_id", F.col(source).cast("string"))
    return salted_join(val, known, ["_id"], "left_semi").drop("_id")


def parent_holdout(df: DataFrame, parent: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Hold out a share of parents; all rows of a parent stay together."""
    parents = df.select(parent).distinct()
    ranked = seeded_rank(parents, [parent], "holdout", seed, rank="_r", total="_n")
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * frac))
    side = ranked.select(parent, F.when(F.col("_r") <= cut, "val").otherwise("train").alias("split"))
    return df.join(side, parent)


def split_summary(df: DataFrame, group: str = "identity_group") -> DataFrame:
    """Rows, distinct groups, label sums and fake share per split."""
    per_group = df.groupBy("split", group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("video_label").alias("v"),
        F.sum("audio_label").alias("a"),
    )
    return per_group.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("v").alias("video_fake"),
        F.sum("a").alias("audio_fake"),
        (F.sum("v") / F.sum("n")).alias("frac_fake"),
    )


def split_manifest(df: DataFrame, key: str) -> DataFrame:
    """(split, position, key): membership in key-hash order, one row per clip."""
    h = F.md5(F.col(key).cast("string"))
    ranked = hash_rank(df.withColumn("_h", h), "_h", [key], by=["split"], rank="position")
    return ranked.select("split", "position", F.col(key).alias("key"))


def split_difference(rebuilt: DataFrame, saved: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """Positions where two split manifests disagree; empty when reproduced."""
    a = rebuilt.filter(F.col("split").isin(list(splits))).select("split", "position", F.col("key").alias("rebuilt_key"))
    b = saved.filter(F.col("split").isin(list(splits))).select("split", "position", F.col("key").alias("saved_key"))
    return a.join(b, ["split", "position"], "full").filter(~F.col("rebuilt_key").eqNullSafe(F.col("saved_key")))


def split_overlap(df: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """Identities that occur in both splits; NULL counts as one.

    One grouping, which combines rows before the shuffle: a hot identity, such
    as the NULL of rows without a source, stays one row a task.
    """
    inside = [F.bool_or(F.col("split") == s).alias(f"_{i}") for i, s in enumerate((a, b))]
    return df.filter(F.col("split").isin(a, b)).groupBy(ident).agg(*inside).filter("_0 and _1").select(ident)
