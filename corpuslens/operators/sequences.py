"""Per-clip frame and time sequences.

Clip-level facts (length, last timestamp) come from combined aggregates joined
back, and anything that needs order runs inside (clip, chunk) with a carry per
chunk, so one enormous clip still spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.geometry import frame_rate, square_box
from corpuslens.functions.hashing import hash_int, uniform
from corpuslens.plans.prefix import bucketed_rank, with_group_stats

CHUNK = 65536  # frames per ordered chunk


def expand_frames(clips: DataFrame, n: str, frame: str = "frame_idx") -> DataFrame:
    """One row per frame index 0 .. n - 1; clips without frames vanish."""
    return clips.filter(F.col(n) > 0).withColumn(frame, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))


def window_of(df: DataFrame, clip: str, frame: str, width: int, train_seed: int | None = None) -> DataFrame:
    """A window of ``width`` frames per clip: centred, or at a seeded start."""
    stats = with_group_stats(df, [clip], _t=F.count(F.lit(1)))
    room = F.greatest(F.lit(0), F.col("_t") - F.least(F.lit(width), F.col("_t")))
    start = F.floor(room / 2) if train_seed is None else hash_int("window", train_seed, room + 1, clip)
    out = stats.withColumn("start", start.cast("int"))
    inside = (F.col(frame) >= F.col("start")) & (F.col(frame) < F.col("start") + width)
    return out.filter(inside).drop("_t")


def contiguous_run(df: DataFrame, clip: str, frame: str, n: int, seed: int = 42) -> DataFrame:
    """n consecutive frames from a clip-seeded start; short clips whole."""
    stats = with_group_stats(df, [clip], _t=F.count(F.lit(1)))
    room = F.greatest(F.lit(0), F.col("_t") - n)
    start = F.when(room > 0, hash_int("run", seed, room + 1, clip)).otherwise(F.lit(0))
    out = stats.withColumn("start_frame", start.cast("int"))
    inside = (F.col(frame) >= F.col("start_frame")) & (F.col(frame) < F.col("start_frame") + n)
    return out.filter(inside).drop("_t")


def pad_frames(df: DataFrame, clip: str, frame: str, ts: str, valid: str, fps: Column, n: int) -> DataFrame:
    """(clip, frame, ts, valid) with exactly n frames per clip.

    The tail is invalid and continues the clock at 1 / fps.  Padding rows are
    generated from the clip table, so the frames themselves are not joined.
    """
    real = df.filter(F.col(frame) < n).select(clip, frame, F.col(ts).cast("double").alias(ts), valid)
    # The last real frame per clip, with its time.
    last = df.filter(F.col(frame) < n).groupBy(clip).agg(
        (F.max(frame) + 1).cast("int").alias("_t"), F.max_by(F.col(ts).cast("double"), frame).alias("_last"), F.max(fps).alias("_fps")
    )
    tail = last.filter(F.col("_t") < n).withColumn(frame, F.explode(F.sequence(F.col("_t"), F.lit(n - 1))))
    pad = tail.select(
        clip,
        frame,
        (F.col("_last") + (F.col(frame) - F.col("_t") + 1) / F.col("_fps")).alias(ts),
        F.lit(False).alias(valid),
    )
    return real.unionByName(pad)


def forward_fill(df: DataFrame, clip: str, frame: str, value: str, out: str) -> DataFrame:
    """Carry the last non-NULL ``value`` forward along each clip.

    Two levels: inside chunks of CHUNK frames, then the last value of earlier
    chunks for frames that precede a chunk's first value.
    """
    tagged = df.withColumn("_chunk", F.floor(F.col(frame) / CHUNK))
    per_chunk = tagged.groupBy(clip, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(frame))).alias("_end")
    )
    before = W.partitionBy(clip).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = per_chunk.select(clip, "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(clip, "_chunk").orderBy(frame).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        tagged.join(carry, [clip, "_chunk"], "left")
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_chunk", "_carry")
    )


def tracked_boxes(df: DataFrame, clip: str, frame: str, detected: str, margin: float) -> DataFrame:
    """``df`` with the crop ``box`` of every frame and whether it is ``usable``.

    Undetected frames reuse the last usable box; a detected box too small to
    crop does not, and frames with nothing to show get the centre square.
    """
    own = df.withColumn("_own", F.when(F.col(detected), square_box("x1", "y1", "x2", "y2", "w", "h", margin)))
    filled = forward_fill(own, clip, frame, "_own", "_carried")
    box = F.when(F.col(detected), F.col("_own")).otherwise(F.col("_carried"))
    side = F.least("w", "h")

    def half(v: Column) -> Column:
        return F.floor(v / 2).cast("int")

    centre = F.struct(
        half(F.col("w") - side).alias("l"),
        half(F.col("h") - side).alias("t"),
        half(F.col("w") + side).alias("r"),
        half(F.col("h") + side).alias("b"),
    )
    return (
        filled.withColumn("_box", box)
        .withColumn("usable", F.col("_box").isNotNull().cast("int"))
        .withColumn("box", F.coalesce("_box", centre))
        .drop("_own", "_carried", "_box")
    )


def tiles(df: DataFrame, clip: str, frame: str, width: int, valid: str, value: Column) -> DataFrame:
    """(clip, tile, mean_value): complete tiles with a valid frame.

    A clip shorter than the width keeps its only, padded tile; ``value`` is
    averaged over valid frames.
    """
    per_tile = df.groupBy(clip, F.floor(F.col(frame) / width).cast("int").alias("tile")).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.max(F.col(valid).cast("int")).alias("_any"),
        F.avg(F.when(F.col(valid), value)).alias("mean_value"),
    )
    # With frames 0 .. n - 1, tile 0 is short only if the whole clip is.
    whole = (F.col("n_frames") == width) | (F.col("tile") == 0)
    return per_tile.filter(whole & (F.col("_any") == 1)).drop("_any")


def repaired_fps(df: DataFrame, clip: str, frame: str, ts: str) -> DataFrame:
    """(clip, fps) from the first two timestamps."""
    first_two = df.filter(F.col(frame) <= 1).groupBy(clip).agg(
        F.max(F.when(F.col(frame) == 0, F.col(ts))).alias("_a"), F.max(F.when(F.col(frame) == 1, F.col(ts))).alias("_b")
    )
    return first_two.select(clip, frame_rate(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("fps"))


def cmvn(df: DataFrame, by: Sequence[str], value: str, eps: float = 1e-8) -> DataFrame:
    """Zero mean, unit population deviation per (clip, band)."""
    stats = with_group_stats(df, by, _m=F.avg(value), _s=F.stddev_pop(value))
    return stats.withColumn("normalised", (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def lead_skip(
    df: DataFrame, clip: str, t: str, value: str, skip: float, min_left: float = 0.5, min_len: float = 0.1
) -> DataFrame:
    """Drop a fixed lead where at least ``min_left`` seconds remain.

    What remains of clips shorter than ``min_len`` reads as zero.
    """
    stats = with_group_stats(df, [clip], _len=F.max(t))
    cut = F.when(F.col("_len") - skip >= min_left, F.lit(skip)).otherwise(F.lit(0.0))
    kept = stats.filter(F.col(t) >= cut)
    short = F.col("_len") - cut < min_len
    return kept.withColumn(value, F.when(short, F.lit(0.0)).otherwise(F.col(value))).drop("_len")


def indexed(df: DataFrame, clip: str, t: str, bucket: Column, index: str = "idx") -> DataFrame:
    """0-based position of every sample along its clip."""
    ranked = bucketed_rank(df, lambda _: bucket, [F.col(t)], [clip], rank=index)
    return ranked.withColumn(index, F.col(index) - 1)


def resample_linear(df: DataFrame, clip: str, index: str, value: str, n_out: int) -> DataFrame:
    """(clip, j, value) at n_out points, linear, half-pixel centres.

    Each output needs two inputs; both are looked up with one join on
    (clip, index) and summed with their weights.
    """
    sizes = df.groupBy(clip).agg((F.max(index) + 1).alias("_t"))
    grid = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))))
    at = F.least(F.greatest((F.col("j") + 0.5) * F.col("_t") / F.lit(float(n_out)) - 0.5, F.lit(0.0)), (F.col("_t") - 1).cast("double"))
    grid = grid.withColumn("_x", at).withColumn("_lo", F.floor("_x"))
    hi = F.least(F.col("_lo") + 1, F.col("_t") - 1)
    frac = F.col("_x") - F.col("_lo")
    taps = grid.select(
        clip,
        "j",
        F.inline(
            F.array(
                F.struct(F.col("_lo").alias(index), (1.0 - frac).alias("_w")),
                F.struct(hi.alias(index), frac.alias("_w")),
            )
        ),
    )
    return (
        taps.join(df.select(clip, index, value), [clip, index])
        .groupBy(clip, "j")
        .agg(F.sum(F.col("_w") * F.col(value)).alias(value))
    )


def shifted_windows(windows: DataFrame, clip: str, win: str, seed: int = 42) -> DataFrame:
    """``o0, o1``: a time-shifted copy of each window of the same clip.

    Random sign times uniform(0.4, max(0.5, duration / 3)), clipped to the clip.
    """
    sign = F.when(uniform("shift_sign", seed, clip, win) < 0.5, -1.0).otherwise(1.0)
    top = F.greatest(F.lit(0.5), F.col("dur") / 3.0)
    shift = sign * (0.4 + (top - 0.4) * uniform("shift_size", seed, clip, win))
    length = F.col("t1") - F.col("t0")
    o0 = F.least(F.greatest(F.col("t0") + shift, F.lit(0.0)), F.greatest(F.lit(0.0), F.col("dur") - length))
    return windows.withColumn("o0", o0).withColumn("o1", F.col("o0") + length)


def masked_pool(df: DataFrame, clip: str, vector: str, valid: str, floor: float = 1e-8) -> DataFrame:
    """(clip, n_valid, mean, std) arrays over valid frames; a clip without any has mean 0 and the floored deviation.

    One JVM vector aggregate with map-side combine: frames are not exploded by
    dimension.  Population deviation, variance floored.
    """
    stat = Summarizer.metrics("mean", "variance", "count")
    pooled = (
        df.filter(F.col(valid))
        .groupBy(clip)
        .agg(stat.summary(array_to_vector(F.col(vector).cast("array<double>"))).alias("_s"))
        .select(
            clip,
            F.col("_s.count").alias("n_valid"),
            vector_to_array("_s.mean").alias("mean"),
            vector_to_array("_s.variance").alias("_var"),
        )
    )
    # The summarizer's variance is the sample variance; rescale to population.
    scale = (F.col("n_valid") - 1) / F.col("n_valid")
    std = F.transform("_var", lambda v: F.sqrt(F.greatest(v * scale, F.lit(floor))))
    found = pooled.select(clip, "n_valid", "mean", std.alias("std"))
    # Aggregates by clip on both sides meet without another shuffle.
    clips = df.groupBy(clip).agg(F.max(F.size(vector)).alias("_dim"))
    return clips.join(found, clip, "left").select(
        clip,
        F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        F.coalesce("mean", F.array_repeat(F.lit(0.0), F.col("_dim"))).alias("mean"),
        F.coalesce("std", F.array_repeat(F.lit(floor**0.5), F.col("_dim"))).alias("std"),
    )
