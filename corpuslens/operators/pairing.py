"""Real/fake pairs, batch plans and contrastive partners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.hashing import hash_int, tag_hash
from corpuslens.plans.prefix import big_groups, deal, pieces_wanted, salted_join, seeded_rank
from corpuslens.session import cut_lineage, discard


def pair_by_target(df: DataFrame, key: str, target: str = "target_id", label: str = "label") -> DataFrame:
    """(real_key, fake_key): each fake with the real it was built on.

    One real may serve many fakes; a missing side is NULL.  Duplicate reals of
    a target resolve to the largest key.
    """
    base = df.filter(F.col(label) == 0)
    fakes = df.filter(F.col(label) == 1).select(F.col(key).alias("fake_key"), target)
    real = base.groupBy(target).agg(F.max(key).alias("real_key"))
    paired = salted_join(fakes, real, [target], "left").select("real_key", "fake_key")
    used = fakes.select(target).distinct().join(real, target).select(F.col("real_key").alias(key))
    lone = base.join(used, key, "left_anti").select(F.col(key).alias("real_key"), F.lit(None).cast("string").alias("fake_key"))
    return paired.unionByName(lone)


def pair_by_rank(
    df: DataFrame, key: str, group: str = "identity_group", label: str = "video_label", seed: int = 42, carry: Sequence[str] = ()
) -> DataFrame:
    """(group, k, real_key, fake_key): k-th real with k-th fake of a group.

    Columns named in ``carry`` come along as structs ``real`` and ``fake``.
    A group is ranked and paired in one task, so its rows shuffle once; only
    those above 1 / pieces of the rows, fewer than pieces, are cut up.
    """
    rows = df.select(*dict.fromkeys([key, group, label, *carry]))
    n = rows.count()
    big = big_groups(rows, [group], pieces_wanted(df.sparkSession, n)).select(F.col(group).alias("_big"))
    is_big = F.col(group).eqNullSafe(F.col("_big"))
    whole = deal(rows.join(F.broadcast(big), is_big, "left_anti"), n, group)
    inside = W.partitionBy(group, label).orderBy(tag_hash("zip", seed, key), key)
    whole = whole.withColumn("k", F.row_number().over(inside).cast("bigint"))
    cut = seeded_rank(rows.join(F.broadcast(big), is_big, "left_semi"), [key], "zip", seed, by=[group, label], rank="k", rows=n)

    def side(value: int) -> Column:
        return F.max(F.when(F.col(label) == value, F.struct(F.col(key).alias("_key"), *carry)))

    def zipped(ranked: DataFrame) -> DataFrame:
        # (group, k, label) is unique, so both sides meet in one small group.
        met = ranked.groupBy(group, "k").agg(side(0).alias("real"), side(1).alias("fake"))
        kept = [F.when(F.col(name).isNotNull(), F.struct(*[f"{name}.{c}" for c in carry])).alias(name) for name in ("real", "fake") if carry]
        return met.select(group, "k", F.col("real._key").alias("real_key"), F.col("fake._key").alias("fake_key"), *kept)

    return zipped(whole).unionByName(zipped(cut))


def batch_plan(pairs: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """(batch, slot, key) for (real_key, fake_key) rows with NULL for singles.

    Pairs come first and take two neighbouring slots, so an even batch size
    never separates them; full batches are then shuffled as wholes and a
    partial last batch stays last or is dropped.  The fields of structs
    ``real`` and ``fake``, if there are any, stay with their key; ``formed``
    then numbers the batches before they are shuffled, as rows are dealt.
    """
    if batch_size < 2 or batch_size % 2:
        raise ValueError("paired batching needs an even batch size of at least 2")
    carried = [c for c in ("real", "fake") if c in pairs.columns]
    fields = pairs.schema["real"].dataType.names if carried else []
    tagged = pairs.select(
        "real_key",
        "fake_key",
        *carried,
        (F.col("real_key").isNotNull() & F.col("fake_key").isNotNull()).cast("int").alias("_pair"),
    )
    order = ["real_key", "fake_key"]
    # Positions need the pair count first, so the pairs are stored once.
    tagged = cut_lineage(tagged.na.fill("", order), "pairs", "zstd", free=True)
    n_pairs, total = tagged.agg(F.coalesce(F.sum("_pair"), F.lit(0)), F.coalesce(F.sum(F.col("_pair") + 1), F.lit(0))).first()
    full = total // batch_size
    shuffled = seeded_rank(tagged, order, f"epoch{epoch}", seed, by=["_pair"], rank="_r", rows=total)
    pos = F.when(F.col("_pair") == 1, 2 * (F.col("_r") - 1)).otherwise(2 * n_pairs + F.col("_r") - 1)
    placed = shuffled.select(*tagged.columns, F.floor(pos / batch_size).alias("_raw"), (pos % batch_size).cast("int").alias("_slot"))
    if drop_last:
        placed = placed.filter(F.col("_raw") < full)
    # Stored again, which frees what both ranks shuffled before batches are dealt.
    placed = cut_lineage(placed, "placed", "zstd", free=True)
    discard(tagged)
    ids = pairs.sparkSession.range(full).withColumnRenamed("id", "_raw")
    moved = seeded_rank(ids, ["_raw"], f"batches{epoch}", seed, rank="_to").select("_raw", (F.col("_to") - 1).alias("_to"))
    if carried:  # the rows of a batch meet again, so both sides are dealt as that needs, a pair as one row
        placed, moved = deal(placed, total, "_raw"), deal(moved, total, "_raw")
    # A batch id covers batch_size rows, so this join has no hot key.
    dealt = placed.join(moved, "_raw", "left")

    def item(name: Column, slot: Column, held: Column) -> Column:
        return F.struct(name.alias("key"), slot.alias("slot"), *[held[c].alias(c) for c in fields])

    real, fake, slot = F.col("real_key"), F.col("fake_key"), F.col("_slot")
    of_real, of_fake = (F.col("real"), F.col("fake")) if carried else (None, None)
    of_lone = F.when(fake.isNull() | (real >= fake), of_real).otherwise(of_fake) if carried else None
    both = F.array(item(real, slot, of_real), item(fake, slot + 1, of_fake))
    one = F.array(item(F.greatest(real, fake), slot, of_lone))
    flat = dealt.select("_raw", "_to", F.inline(F.when(F.col("_pair") == 1, both).otherwise(one)))
    formed = [F.col("_raw").alias("formed")] if carried else []
    return flat.select(F.coalesce("_to", "_raw").cast("bigint").alias("batch"), "slot", "key", *fields, *formed)


def negative_partners(
    df: DataFrame, key: str, group: str, has_audio: str, batch_size: int, seed: int = 42
) -> DataFrame:
    """Contrastive partner per row: the next row of its seeded batch.

    A partner from another group that has audio is used; otherwise the row's
    own time-shifted window is, and ``source`` says which.
    """
    placed = seeded_rank(df.select(key, group, has_audio), [key], "negatives", seed, rank="_r")
    placed = placed.withColumn("_batch", F.floor((F.col("_r") - 1) / batch_size))
    # A batch holds at most batch_size rows, so neither window can run hot.
    batch = W.partitionBy("_batch").orderBy("_r")
    partner = F.struct(F.col(key).alias("k"), F.col(group).alias("g"), F.col(has_audio).alias("a"))
    both = placed.withColumn("_p", F.coalesce(F.lead(partner).over(batch), F.first(partner).over(batch)))
    ok = (F.col("_p.g") != F.col(group)) & (F.col("_p.a") == 1)
    return both.select(
        key,
        F.when(ok, F.col("_p.k")).otherwise(F.col(key)).alias("negative_key"),
        F.when(ok, "cross_identity").otherwise("same_clip_shift").alias("source"),
    )


def batch_negatives(
    plan: DataFrame, rows: DataFrame, key: str, group: str, has_audio: str, seed: int = 42
) -> DataFrame:
    """(batch, slot, key, negative_key, source): a contrastive partner inside the batches of :func:`batch_plan`.

    Every batch is turned by a seeded number of slots, so each row meets
    another one of its batch, and each is met once.  A partner of another group
    that has audio is used; otherwise, and in a batch of one row, the row's own
    time-shifted window is (``sequences.shifted_windows``), as ``source`` says.
    A plan of ``rows`` that carries ``group`` and ``has_audio`` is joined with
    them on repeated keys only.  A batch is bounded and is gathered once, and
    the join is on the key, so no key is hot unless it repeats.
    """
    if {group, has_audio} <= {*plan.columns}:
        known = _known(plan, rows, key, group, has_audio)
    else:
        known = plan.join(rows.select(key, group, has_audio, F.lit(True).alias("_in")), key, "left")
    item = F.struct(F.col("slot").alias("s"), F.col(key).alias("k"), F.col(group).alias("g"), F.col(has_audio).alias("a"))
    gathered = known.groupBy("formed" if "formed" in plan.columns else "batch").agg(
        F.max("batch").alias("_batch"),
        (F.max("slot") + 1).cast("bigint").alias("_size"),
        F.sort_array(F.collect_list(F.when(F.col("_in"), item))).alias("_items"),
    )
    size, items = F.col("_size"), F.col("_items")
    turn = F.when(size > 1, 1 + hash_int("turn", seed, F.greatest(size - 1, F.lit(1)), "_batch")).otherwise(F.lit(0))
    # With one row in each slot, a batch's list has slot s at s; else there is a list per slot.
    single = (F.size(items) == size) & (F.size(F.array_distinct(items["s"])) == size)
    lists = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda s: F.filter(items, lambda y: y["s"] == s))
    gathered = gathered.select(
        F.col("_batch").alias("batch"), "_size", "_items", turn.alias("_turn"), F.when(~single, lists).alias("_lists")
    )

    def other(x: Column) -> Column:
        return F.pmod(x["s"] + F.col("_turn"), size).cast("int")

    def met(x: Column, y: Column) -> Column:
        ok = (y["g"] != x["g"]) & (y["a"] == 1)
        return F.struct(
            x["s"].alias("slot"), x["k"].alias(key),
            F.when(ok, y["k"]).otherwise(x["k"]).alias("negative_key"),
            F.when(ok, "cross_identity").otherwise("same_clip_shift").alias("source"),
        )

    def all_met(x: Column) -> Column:
        found = F.get(F.col("_lists"), other(x))
        return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(x)), lambda y: met(x, y))

    one_each = F.transform(items, lambda x: met(x, F.get(items, other(x))))
    several = F.flatten(F.transform(items, all_met))
    return gathered.select("batch", F.inline(F.when(F.col("_lists").isNull(), one_each).otherwise(several)))


def _known(plan: DataFrame, rows: DataFrame, key: str, group: str, has_audio: str) -> DataFrame:
    """The plan with group and audio of each row of its keys, and ``_in``: whether there is one.

    A key that stands once in ``rows`` has what the plan carries.  Keys are
    counted by 64-bit hashes; those of a hash that repeats are joined, so a
    hash that two keys share costs time only.  The plan has an empty key for
    each null one, which is no row unless ``rows`` has empty keys.
    """
    hashed, empty = F.xxhash64(F.col(key).cast("string")).alias("_hash"), F.xxhash64(F.lit(""))
    hashes = deal(rows.filter(F.col(key).isNotNull()).select(hashed), rows.count(), "_hash")
    # Sorted and not counted in a map, which would take several times the memory.
    nth = hashes.withColumn("_nth", F.row_number().over(W.partitionBy("_hash").orderBy("_hash")))
    again = nth.filter((F.col("_nth") == 2) | ((F.col("_nth") == 1) & (F.col("_hash") == empty))).select("_hash").distinct()
    again = cut_lineage(again, "repeated", free=True)
    known = plan.withColumn("_in", F.col(key).cast("string") != "")
    if again.isEmpty():
        return known
    marked = known.select("*", hashed).join(again.withColumn("_again", F.lit(True)), "_hash", "left")
    once = marked.filter(F.col("_again").isNull()).drop("_hash", "_again")
    more = marked.filter(F.col("_again")).drop("_hash", "_again", "_in", group, has_audio)
    side = rows.select(key, group, has_audio, hashed, F.lit(True).alias("_in")).join(again, "_hash", "left_semi").drop("_hash")
    return once.unionByName(more.join(side, key, "left"))


def negative_sources(partners: DataFrame) -> DataFrame:
    return partners.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def group_codes(df: DataFrame, group: str) -> DataFrame:
    """(group, code): 0-based code in sorted name order, over distinct names."""
    names = df.select(group).distinct().repartitionByRange(F.col(group))
    # Range partition ids depend on sampled bounds; writing them once keeps the
    # counts and the ranks in agreement.
    placed = cut_lineage(names.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_part").orderBy(group)
    return placed.join(F.broadcast(starts), "_part").select(
        group, (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint").alias("code")
    )
