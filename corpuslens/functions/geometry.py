"""Box arithmetic for face crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.numeric import c

MIN_SIDE = 8  # fixed value: smaller crops are rejected


def square_box(
    x1: Column | str,
    y1: Column | str,
    x2: Column | str,
    y2: Column | str,
    width: Column | str,
    height: Column | str,
    margin: float,
) -> Column:
    """Margin-expanded square around the box centre, clamped to the frame.

    NULL when a side of the clamped square is under 8 pixels or there is no box.
    """
    half = F.greatest(c(x2) - c(x1), c(y2) - c(y1)) * (1.0 + margin) / 2.0
    cx, cy = (c(x1) + c(x2)) / 2.0, (c(y1) + c(y2)) / 2.0

    def px(v: Column) -> Column:
        return F.bround(v, 0).cast("int")

    left, top = F.greatest(px(cx - half), F.lit(0)), F.greatest(px(cy - half), F.lit(0))
    right, bottom = F.least(px(cx + half), c(width)), F.least(px(cy + half), c(height))
    box = F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))
    present = c(x1).isNotNull()
    return F.when(present & (right - left >= MIN_SIDE) & (bottom - top >= MIN_SIDE), box)


def frame_rate(first_ts: Column, second_ts: Column) -> Column:
    """Rate from the first two timestamps; 25 when missing, non-finite or <= 1."""
    fps = F.try_divide(F.lit(1.0), second_ts - first_ts)
    good = fps.isNotNull() & ~F.isnan(fps) & (fps < float("inf")) & (fps > 1.0)
    return F.when(good, F.round(fps, 3)).otherwise(F.lit(25.0))
