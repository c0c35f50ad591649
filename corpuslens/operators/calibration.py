"""Temperature scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numeric import c, sigmoid
from corpuslens.session import cut_lineage

T_MIN, T_MAX = 0.05, 20.0  # fixed values: outside this range a fit is rejected
ROUND_STEPS = 4  # Newton steps between two looks at what has settled
MAX_ROUNDS = 20


def fit_temperature(
    df: DataFrame, logit: str = "logit", y: str = "y", by: Sequence[str] = ("head",)
) -> DataFrame:
    """(by, temperature) minimising BCE(logit / T); 1.0 when the fit is rejected.

    BCE is convex in beta = 1 / T.  Each Newton step is one aggregate per
    group over the distinct (logit, y) counts, bracketed so that it cannot run
    away.  Counts and state are stored, and steps go on until every group has
    settled or its optimum is known to be out of range; a group that never
    does raises.
    """
    by = list(by)
    if not by:
        return fit_temperature(df.withColumn("_all", F.lit(1)), logit, y, ["_all"]).drop("_all")
    counts = df.groupBy(*by, F.col(logit).alias("z"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts, "logit-counts")
    state = counts.groupBy(*by).agg(
        F.lit(0.5 / T_MAX).alias("lo"), F.lit(2.0 / T_MIN).alias("hi"), F.lit(1.0).alias("beta")
    )
    outside = (F.col("lo") >= 1.0 / T_MIN) | (F.col("hi") <= 1.0 / T_MAX)
    for _ in range(MAX_ROUNDS):
        for _ in range(ROUND_STEPS):
            state = _newton_step(counts, state, by)
        state = cut_lineage(state, "newton-state")
        if state.filter(~(F.col("settled") | outside)).isEmpty():
            break
    else:
        raise ValueError("the temperature of some group did not settle")
    t = 1.0 / F.col("beta")
    ok = ~F.isnan(t) & (t > T_MIN) & (t < T_MAX)
    return state.select(*by, F.when(ok, t).otherwise(F.lit(1.0)).alias("temperature"))


def _newton_step(counts: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    joined = counts.join(state, by)
    p = sigmoid(F.col("z") * F.col("beta"))
    grad = F.sum(F.col("n") * F.col("z") * (p - F.col("y")))
    curve = F.sum(F.col("n") * F.col("z") * F.col("z") * p * (1.0 - p))
    s = joined.groupBy(*by).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("beta").alias("beta"), grad.alias("g"), curve.alias("h")
    )
    s = s.withColumn("lo", F.when(F.col("g") < 0, F.col("beta")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(F.col("g") > 0, F.col("beta")).otherwise(F.col("hi"))
    )
    newton = F.col("beta") - F.try_divide(F.col("g"), F.col("h"))
    # Once converged, rounding noise may push the step just past the bracket.
    settled = F.abs(newton - F.col("beta")) <= F.col("beta") * 1e-9
    inside = newton.isNotNull() & (settled | ((newton > F.col("lo")) & (newton < F.col("hi"))))
    nxt = F.when(F.col("g") == 0, F.col("beta")).when(inside, newton).otherwise(F.sqrt(F.col("lo") * F.col("hi")))
    still = F.abs(nxt - F.col("beta")) <= F.col("beta") * 1e-9
    return s.select(*by, "lo", "hi", nxt.alias("beta"), F.coalesce(still, F.lit(True)).alias("settled"))


def calibrated(
    df: DataFrame, calibration: DataFrame, logit: str = "logit", by: Sequence[str] = ("head",)
) -> DataFrame:
    """``df`` with ``p`` and ``pred`` from (head, temperature, threshold).

    A head that was never calibrated uses T = 1 and threshold 0.5.
    """
    cal = calibration.select(*by, F.col("temperature").alias("_t"), F.col("threshold").alias("_thr"))
    joined = df.join(cal, list(by), "left")
    p = sigmoid(c(logit), F.coalesce("_t", F.lit(1.0)))
    return (
        joined.withColumn("p", p)
        .withColumn("pred", (F.col("p") >= F.coalesce("_thr", F.lit(0.5))).cast("int"))
        .drop("_t", "_thr")
    )
