"""From model outputs to clip scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpuslens.functions.numeric import sigmoid
from corpuslens.operators.sequences import tiles


def batch_score(
    df: DataFrame,
    features: str,
    make_predict_fn: Callable[[], Callable],
    batch_size: int = 1024,
    shape: Sequence[int] | None = None,
    ok: Column | None = None,
) -> DataFrame:
    """``df`` repeated per stochastic ``sample`` with the model's ``logit``.

    The model function gets the features of a batch once and returns an array
    of (rows, samples), so that what samples share is computed once; rows are
    repeated on the JVM side afterwards.  Rows failing ``ok`` are dropped
    before the model sees them, never scored as zeros; apply every other
    filter or cap first, because a model call blocks pushdown.
    """
    good = df.filter(ok) if ok is not None else df
    scorer = predict_batch_udf(
        make_predict_fn,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(shape)] if shape else None,
    )
    return good.select("*", F.posexplode(scorer(F.col(features))).alias("sample", "logit"))


def sample_rollup(df: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """Mean logit and population deviation of the probability over samples."""
    return df.groupBy(*keys).agg(F.avg(logit).alias("mean_logit"), F.stddev_pop(sigmoid(logit)).alias("std_prob"))


def clip_mean(df: DataFrame, clip: Sequence[str], p: Column, ok: Column) -> DataFrame:
    """Mean frame probability per clip; 0.5 when no frame counts."""
    return df.groupBy(*clip).agg(F.coalesce(F.avg(F.when(ok, p)), F.lit(0.5)).alias("score"))


def tiled_score(
    df: DataFrame, clip: str, frame: str, valid: str, logit: Column, width: int, temperature: float = 1.0
) -> DataFrame:
    """(clip, n_tiles, score): mean of sigmoid(tile logit / T) over usable tiles.

    Clips without a valid frame do not appear.
    """
    per_tile = tiles(df, clip, frame, width, valid, logit)
    p = sigmoid("mean_value", float(temperature))
    return per_tile.groupBy(clip).agg(F.count(F.lit(1)).alias("n_tiles"), F.avg(p).alias("score"))
