"""Interval and lag joins over time-indexed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numeric import dot
from corpuslens.plans.prefix import running_totals, salted_join, with_group_stats
from corpuslens.session import cut_lineage


def interval_join(
    windows: DataFrame, samples: DataFrame, clip: str, lo: Column, hi: Column, t: str, width: float
) -> DataFrame:
    """Samples with lo <= t < hi of their clip's windows.

    Windows are repeated once per time cell of ``width`` they touch, so the
    join key is (clip, cell): a long clip spreads over many keys and the range
    test only meets neighbours in time.
    """
    last = F.greatest(F.ceil(hi / width) - 1, F.floor(lo / width))
    cells = windows.withColumn("_lo", lo).withColumn("_hi", hi)
    cells = cells.withColumn("_cell", F.explode(F.sequence(F.floor(lo / width), last)))
    pts = samples.withColumn("_cell", F.floor(F.col(t) / width))
    joined = cells.join(pts, [clip, "_cell"])
    return joined.filter((F.col(t) >= F.col("_lo")) & (F.col(t) < F.col("_hi"))).drop("_cell", "_lo", "_hi")


def window_slices(
    windows: DataFrame,
    samples: DataFrame,
    clip: str,
    win: str,
    t: str,
    value: str,
    rate: float,
    width: float,
    min_samples: int = 5,
    eps: float = 1e-8,
) -> DataFrame:
    """Samples of each padded window with their z-score over the window.

    Bounds are widened by ``pad`` on both sides, rounded half-even to the
    sample grid and clipped at zero; a slice under ``min_samples`` reads zero,
    and a window without samples is one row with a null time.
    """
    lo = F.greatest(F.lit(0.0), F.bround((F.col("t0") - F.col("pad")) * rate, 0) / rate)
    hi = F.bround((F.col("t1") + F.col("pad")) * rate, 0) / rate
    rows = interval_join(windows.select(clip, win, "t0", "t1", "pad"), samples, clip, lo, hi, t, width)
    rows = cut_lineage(rows.select(clip, win, t, value), "slices")  # read for the rows, the statistics and the empty windows
    stats = with_group_stats(rows, [clip, win], _n=F.count(F.lit(1)), _m=F.avg(value), _s=F.stddev_pop(value))
    z = (F.col(value) - F.col("_m")) / (F.col("_s") + eps)
    sliced = stats.select(clip, win, t, F.when(F.col("_n") >= min_samples, z).otherwise(F.lit(0.0)).alias("z"))
    empty = windows.select(clip, win).join(rows.select(clip, win).distinct(), [clip, win], "left_anti")
    return sliced.unionByName(empty.select(clip, win, F.lit(None).cast(dict(samples.dtypes)[t]).alias(t), F.lit(0.0).alias("z")))


def band_slices(
    windows: DataFrame, frames: DataFrame, clip: str, win: str, index: str, bands: str, rate: float, n_out: int,
    min_samples: int = 5, eps: float = 1e-8,
) -> DataFrame:
    """(clip, win, j, z): each window [t0, t1) of a clip as ``n_out`` z-scored vectors of bands.

    ``frames`` holds one vector per (clip, index), the index counting from 0
    without gaps at ``rate`` frames a second.  Bounds are rounded half-even to
    frames and kept inside the clip.  Output j stands at (j + 0.5) * n / n_out
    - 0.5 of the window's n frames, kept inside it, and is interpolated
    between its two neighbours; the z-score is over all outputs and bands of
    the window together.  A window of fewer than ``min_samples`` frames, or of
    a clip without frames, is all zeros.

    Every output meets its neighbours by (clip, index): two equal-key joins,
    no range join, and a long clip spreads over all tasks.
    """
    sizes = frames.groupBy(clip).agg((F.max(index) + 1).alias("_t"), F.max(F.size(bands)).alias("_bands"), F.count(F.lit(1)).alias("_rows"))
    most = frames.agg(F.max(F.size(bands))).scalar()
    known = salted_join(windows.select(clip, win, "t0", "t1"), sizes.drop("_rows"), [clip], "left")
    first = F.greatest(F.lit(0), F.bround(F.col("t0") * rate, 0).cast("int"))
    end = F.least(F.coalesce("_t", F.lit(0)), F.bround(F.col("t1") * rate, 0).cast("int"))
    placed = known.select(clip, win, "_bands", first.alias("_i"), (end - first).alias("_n"))
    short = placed.filter(F.col("_n") < min_samples)
    zeros = F.array_repeat(F.lit(0.0), F.coalesce("_bands", most))
    outputs = F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("j")
    empty = short.select(clip, win, outputs, zeros.alias("z"))

    grid = placed.filter(F.col("_n") >= min_samples).select(clip, win, "_i", "_n", outputs)
    at = F.least(F.greatest((F.col("j") + 0.5) * F.col("_n") / F.lit(float(n_out)) - 0.5, F.lit(0.0)), (F.col("_n") - 1).cast("double"))
    low = F.floor(at)
    taps = grid.select(
        clip, win, "j", (at - low).alias("_f"), (F.col("_i") + low).alias("_low"), (F.col("_i") + F.least(low + 1, F.col("_n") - 1)).alias("_high")
    )
    vectors = frames.select(clip, F.col(index).cast("bigint").alias("_low"), F.col(bands).cast("array<double>").alias("_a"))
    both = taps.join(vectors, [clip, "_low"]).join(vectors.withColumnsRenamed({"_low": "_high", "_a": "_b"}), [clip, "_high"])
    mixed = both.select(clip, win, "j", F.zip_with("_a", "_b", lambda a, b: (1 - F.col("_f")) * a + F.col("_f") * b).alias("_v"))
    mixed = cut_lineage(mixed, "interpolated")  # read for the statistics and for the rows
    # Two passes over n_out vectors a window: sums of squares about the mean, not about zero.
    total = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x)
    means = mixed.groupBy(clip, win).agg(F.sum(total).alias("_s"), F.sum(F.size("_v")).alias("_k"))
    centred = mixed.join(means, [clip, win]).select(
        clip, win, "j", "_k", F.transform("_v", lambda x: x - F.col("_s") / F.col("_k")).alias("_v")
    )
    squares = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    spread = centred.groupBy(clip, win).agg((F.sqrt(F.sum(squares) / F.max("_k")) + eps).alias("_d"))
    scaled = centred.join(spread, [clip, win]).select(clip, win, "j", F.transform("_v", lambda x: x / F.col("_d")).alias("z"))
    return scaled.unionByName(empty)


def lag_profile(
    a: DataFrame, b: DataFrame, clip: str, t: str, vec: str, valid: str, max_lag: int
) -> DataFrame:
    """(clip, k, n, sim): mean dot product of a at t with b at t + k, |k| <= max_lag.

    Every clip of ``a`` has a row per lag; without valid frames that have a
    partner there, n and sim are 0.

    ``t`` is an integer frame index; vectors are expected at unit norm.  b is
    repeated for the at most two neighbouring cells its partners lie in, so
    the shuffle carries every vector about twice, not 2 * max_lag + 1 times.
    """
    width = 2 * max_lag + 1
    left = a.filter(F.col(valid)).select(
        clip, F.col(t).alias("_ta"), F.col(vec).alias("_va"), F.floor(F.col(t) / width).alias("_cell")
    )
    span = F.sequence(F.floor((F.col(t) - max_lag) / width), F.floor((F.col(t) + max_lag) / width))
    right = b.select(clip, F.col(t).alias("_tb"), F.col(vec).alias("_vb"), F.explode(span).alias("_cell"))
    near = left.join(right, [clip, "_cell"]).filter(F.abs(F.col("_tb") - F.col("_ta")) <= max_lag)
    met = (
        near.withColumn("k", (F.col("_tb") - F.col("_ta")).cast("int"))
        .groupBy(clip, "k")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(dot("_va", "_vb")).alias("sim"))
    )
    grid = a.select(clip).distinct().select(clip, F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("k"))
    return grid.join(met, [clip, "k"], "left").select(
        clip, "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sim", F.lit(0.0)).alias("sim")
    )


def lag_summary(profiles: DataFrame, clip: str, kind: str) -> DataFrame:
    """(kind, n_clips, top1): share of clips whose profile peaks at lag 0.

    Ties go to the smallest lag, as a first-maximum search does.
    """
    best = profiles.groupBy(kind, clip).agg(F.max_by("k", F.struct("sim", -F.col("k"))).alias("_k"))
    return best.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n_clips"), F.avg((F.col("_k") == 0).cast("double")).alias("top1")
    )


def lag_curve(profiles: DataFrame, kind: str) -> DataFrame:
    return profiles.groupBy(kind, "k").agg(F.avg("sim").alias("mean_sim"))


def interval_overlaps(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """``df`` with ``n_overlaps``: how many other intervals meet this one.

    Counted from two running totals over end points (closed intervals), so no
    pairs are formed: those starting by my end minus those ended before my start.
    """
    points = df.select(
        F.inline(
            F.array(
                F.struct(F.col(lo).alias("x"), F.lit(1).cast("bigint").alias("starts"), F.lit(0).cast("bigint").alias("ends")),
                F.struct(F.col(hi).alias("x"), F.lit(0).cast("bigint").alias("starts"), F.lit(1).cast("bigint").alias("ends")),
            )
        )
    )
    totals = running_totals(points.groupBy("x").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")), "x", ["starts", "ends"])
    started = totals.select(F.col("x").alias(hi), (F.col("starts_before") + F.col("starts")).alias("_started"))
    ended = totals.select(F.col("x").alias(lo), F.col("ends_before").alias("_ended"))
    both = df.join(started, hi).join(ended, lo)
    return both.withColumn("n_overlaps", F.col("_started") - F.col("_ended") - 1).drop("_started", "_ended")
