"""Experiment bookkeeping: grids, logs, gates, leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.numeric import is_finite
from corpuslens.operators.bootstrap import bootstrap_ci
from corpuslens.operators.intervals import interval_overlaps
from corpuslens.operators.metrics import auc
from corpuslens.session import cut_lineage


def experiment_grid(arms: DataFrame, first_seed: int, n_seeds: int) -> DataFrame:
    """Every arm with every seed, without a join."""
    return arms.withColumn("seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + n_seeds - 1))))


def selection_metric(modality: Column, video: Column, audio: Column) -> Column:
    """The metric checkpoints are chosen by."""
    return (
        F.when(modality == "video_only", video).when(modality == "audio_only", audio).otherwise(0.5 * (video + audio))
    )


def running_best(log: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """``best`` so far, ``improved`` (strictly) and epochs ``since_best``.

    NaN never improves.  A run has one row per epoch, so its window is short.
    """
    w = W.partitionBy(run).orderBy(epoch)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    good = F.when(is_finite(F.col(metric)), F.col(metric))
    steps = log.withColumn("_m", good).withColumn("_prev", F.max("_m").over(past))
    better = F.col("_m").isNotNull() & (F.col("_prev").isNull() | (F.col("_m") > F.col("_prev")))
    steps = steps.withColumn("improved", better.cast("int")).withColumn("_i", F.row_number().over(w))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.coalesce(F.max(F.when(F.col("improved") == 1, F.col("_i"))).over(upto), F.lit(0))
    return (
        steps.withColumn("best", F.max("_m").over(upto))
        .withColumn("since_best", (F.col("_i") - last).cast("int"))
        .drop("_m", "_prev", "_i")
    )


def stop_reason(since_best: Column, phase: Column, elapsed: Column, patience: int, budget: float | None) -> Column:
    """Time budget in any phase first, then patience in phase 1."""
    spent = F.lit(False) if budget is None else elapsed >= budget
    return F.when(spent, "time_budget").when((phase == 1) & (since_best >= patience), "patience")


def stop_points(
    log: DataFrame, patience: int, budget: float | None, run: str = "run", epoch: str = "epoch", phase: str = "phase",
    elapsed: str = "elapsed_s", metric: str = "metric",
) -> DataFrame:
    """(run, stop_epoch, stop_reason): first epoch a rule fires, NULL if none."""
    steps = running_best(log, run, epoch, metric)
    reason = stop_reason(F.col("since_best"), F.col(phase), F.col(elapsed), patience, budget)
    first = F.min(F.when(reason.isNotNull(), F.struct(F.col(epoch).alias("e"), reason.alias("r"))))
    return steps.groupBy(run).agg(first.alias("_f")).select(
        run, F.col("_f.e").alias("stop_epoch"), F.col("_f.r").alias("stop_reason")
    )


def seed_summary(df: DataFrame, by: Sequence[str], metric: str = "metric") -> DataFrame:
    """Mean and population deviation over seeds, NaN left out."""
    good = F.when(is_finite(F.col(metric)), F.col(metric))
    return df.groupBy(*by).agg(F.count(good).alias("n"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"))


def class_balance(df: DataFrame, label: str, by: Sequence[str] = (), relabel_p: float = 0.0) -> DataFrame:
    """Counts and positive weight, allowing for reals expected to be relabelled."""
    n = df.groupBy(*by).agg(
        F.coalesce(F.sum((F.col(label) == 1).cast("bigint")), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum((F.col(label) == 0).cast("bigint")), F.lit(0)).alias("n_neg"),
    )
    moved = relabel_p * F.col("n_neg")
    pos, neg = F.col("n_pos") + moved, F.col("n_neg") - moved
    return n.withColumn("pos_weight", F.greatest(neg, F.lit(1.0)) / F.greatest(pos, F.lit(1.0)))


def gate_check(gates: DataFrame, results: DataFrame, inverted: float = 0.45) -> DataFrame:
    """Verdict per gate row (dataset, gate, baseline); a missing result fails."""
    j = gates.join(results.select("dataset", "auc"), "dataset", "left")
    ok = F.coalesce(is_finite(F.col("auc")) & (F.col("auc") >= F.col("gate")), F.lit(False))
    verdict = (
        F.when(ok, "OK")
        .when(F.col("auc").isNull(), "SKIP")
        .when(F.col("auc") <= inverted, "FAIL-INVERTED")
        .otherwise("FAIL")
    )
    return j.select(
        "dataset", "auc", "gate", (F.col("auc") - F.col("baseline")).alias("delta"), ok.cast("int").alias("passed"),
        verdict.alias("verdict"),
    )


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(F.col("passed") == 1), F.lit(False)).cast("int").alias("all_passed"))


def reportable(results: DataFrame, min_auc: float = 0.7) -> Column:
    return F.coalesce(F.col("auc") >= min_auc, F.lit(False))


def dataset_report(
    scored: DataFrame, ident: str, threshold: float | Column, by: str = "dataset", y: str = "y", score: str = "score",
    n_boot: int = 2000,
) -> DataFrame:
    """(dataset, n, auc, lo, hi, acc); datasets with one class are left out."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit = F.avg(((F.col(score) >= thr).cast("int") == F.col(y)).cast("double"))
    base = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), hit.alias("acc"))
    areas = auc(scored, y, score, [by]).select(by, "auc").filter("auc is not null")
    ci = bootstrap_ci(scored, ident, n_boot, y=y, score=score, by=[by]).select(by, "lo", "hi")
    return base.join(areas, by).join(ci, by, "left").select(by, "n", "auc", "lo", "hi", "acc")


def leaderboard(report: DataFrame, by: str = "dataset") -> DataFrame:
    """``report`` plus its mean row (NULL results skipped), in one pass."""
    total = F.grouping(by) == 1
    rows = report.groupingSets([[F.col(by)], []], F.col(by)).agg(
        total.alias("_total"),
        F.sum("n").alias("n"),
        F.avg("auc").alias("auc"),
        F.when(~total, F.max("lo")).alias("lo"),
        F.when(~total, F.max("hi")).alias("hi"),
        F.avg("acc").alias("acc"),
    )
    return rows.withColumn(by, F.when(F.col("_total"), F.lit("mean")).otherwise(F.col(by))).drop("_total")


def flag_cut_short(arms: DataFrame, reason: str = "stop_reason") -> DataFrame:
    """``comparable`` is 0 for arms the time budget ended."""
    return arms.withColumn("comparable", (~F.coalesce(F.col(reason) == "time_budget", F.lit(False))).cast("int"))


def ci_overlap(df: DataFrame, key: str, lo: str, hi: str, baseline: str) -> DataFrame:
    """Does each interval meet the baseline's, and how many others does it meet?

    The baseline's bounds are two scalars and the counts come from running
    totals, so no table of pairs is built.
    """
    df = cut_lineage(df)  # read several times below, and costly to bootstrap again
    base = df.filter(F.col(key) == baseline)
    b_lo, b_hi = base.agg(F.min(lo)).scalar(), base.agg(F.max(hi)).scalar()
    counted = interval_overlaps(df, key, lo, hi)
    with_base = counted.withColumn("_lo", b_lo).withColumn("_hi", b_hi)
    meets = (F.col(lo) <= F.col("_hi")) & (F.col("_lo") <= F.col(hi))
    return with_base.withColumn("meets_baseline", meets.cast("int")).drop("_lo", "_hi")
