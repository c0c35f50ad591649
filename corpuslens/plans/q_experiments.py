"""Grids, training logs, gates, reports and leaderboards."""

from pyspark.sql import functions as F

from corpuslens.functions.numeric import rounded
from corpuslens.operators import bootstrap as B
from corpuslens.operators import experiments as E
from corpuslens.operators import metrics as M
from corpuslens.plans.catalog import query
from corpuslens.plans.q_evaluation import AUC_EXPR, BOOT_CI, auc_ranks, boot_id, ci_sql


@query(
    "experiment_grid",
    "SELECT arm, dataset, seed::INT AS seed FROM (SELECT DISTINCT p_brand AS arm, p_type AS dataset FROM part), range(42, 45) s(seed)",
)
def experiment_grid(t):
    arms = t.part.select(F.col("p_brand").alias("arm"), F.col("p_type").alias("dataset")).distinct()
    return E.experiment_grid(arms, 42, 3)


BEST = """
    SELECT run, epoch, phase, elapsed_s, metric, improved, max(metric) OVER u AS best,
           (row_number() OVER u - coalesce(max(CASE WHEN improved = 1 THEN i END) OVER u, 0))::INT AS since_best FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
             coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS improved FROM train_log)
    WINDOW u AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("running_best", f"SELECT run, epoch, improved, best, since_best FROM ({BEST})")
def running_best(t):
    return E.running_best(t.train_log).select("run", "epoch", "improved", "best", "since_best")


STOP = f"""SELECT run, arg_min(CASE WHEN why IS NOT NULL THEN epoch END, CASE WHEN why IS NOT NULL THEN epoch END) AS stop_epoch, arg_min(why, CASE WHEN why IS NOT NULL THEN epoch END) AS stop_reason FROM (
    SELECT *, CASE WHEN elapsed_s >= 14000 THEN 'time_budget' WHEN phase = 1 AND since_best >= 6 THEN 'patience' END AS why FROM ({BEST})) GROUP BY run"""


@query("stop_point", STOP)
def stop_point(t):
    return E.stop_points(t.train_log, 6, 14000.0)


@query("comparable_arms", f"SELECT run, stop_reason, (stop_reason IS DISTINCT FROM 'time_budget')::INT AS comparable FROM ({STOP})")
def comparable_arms(t):
    return E.flag_cut_short(E.stop_points(t.train_log, 6, 14000.0)).select("run", "stop_reason", "comparable")


@query(
    "seed_summary",
    """SELECT epoch, count(m)::BIGINT AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (
         SELECT epoch, CASE WHEN run % 7 <> 0 THEN metric END AS m FROM train_log) GROUP BY epoch""",
)
def seed_summary(t):
    log = t.train_log.withColumn("metric", F.when(F.col("run") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("metric")))
    return E.seed_summary(log, ["epoch"]).select("epoch", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    "selection_metric",
    """SELECT run, epoch, round(CASE run % 3 WHEN 0 THEN metric WHEN 1 THEN elapsed_s ELSE 0.5 * (metric + elapsed_s) END, 9) AS metric FROM train_log""",
)
def selection_metric(t):
    mode = F.when(F.col("run") % 3 == 0, "video_only").when(F.col("run") % 3 == 1, "audio_only").otherwise("both")
    m = E.selection_metric(mode, F.col("metric"), F.col("elapsed_s"))
    return t.train_log.select("run", "epoch", rounded(m, 9).alias("metric"))


GATES = [("d0", 0.5, 0.45), ("d1", 0.85, 0.64), ("d2", 0.45, 0.58), ("d3", 0.51, 0.5), ("d9", 0.7, 0.5)]
GATE_ROWS = ", ".join(f"('{d}', {g}::DOUBLE, {b}::DOUBLE)" for d, g, b in GATES)
GATE_SQL = f"""
    WITH r AS (SELECT dataset, {AUC_EXPR} AS auc FROM ({auc_ranks('scored', 'dataset')})), g(dataset, gate, baseline) AS (VALUES {GATE_ROWS})
    SELECT dataset, auc, gate, auc - baseline AS delta, coalesce(auc >= gate, false)::INT AS passed,
           CASE WHEN auc IS NULL THEN 'SKIP' WHEN auc >= gate THEN 'OK' WHEN auc <= 0.45 THEN 'FAIL-INVERTED' ELSE 'FAIL' END AS verdict
    FROM g LEFT JOIN r USING (dataset)"""


def _gates(t):
    gates = t.spark.createDataFrame(GATES, "dataset string, gate double, baseline double")
    return E.gate_check(gates, M.auc(t.scored, by=["dataset"]))


@query("gate_check", f"SELECT dataset, round(auc, 9) AS auc, gate, round(delta, 9) AS delta, passed, verdict FROM ({GATE_SQL})")
def gate_check(t):
    return _gates(t).withColumn("auc", rounded("auc", 9)).withColumn("delta", rounded("delta", 9))


@query("gate_summary", f"SELECT bool_and(passed = 1)::INT AS all_passed FROM ({GATE_SQL})")
def gate_summary(t):
    return E.all_passed(_gates(t))


@query(
    "reportable_heads",
    f"SELECT grp, round(auc, 9) AS auc, coalesce(auc >= 0.7, false)::INT AS reportable FROM (SELECT grp, {AUC_EXPR} AS auc FROM ({auc_ranks('scored', 'grp')}))",
)
def reportable_heads(t):
    r = M.auc(t.scored, by=["grp"])
    return r.select("grp", rounded("auc", 9).alias("auc"), E.reportable(r).cast("int").alias("reportable"))


@query(
    "dataset_report",
    """SELECT lang AS dataset, count(*)::BIGINT AS n, CASE WHEN min(y) <> max(y) THEN round(avg(((score >= thr)::INT = y)::INT), 6) END AS acc
       FROM (SELECT *, CASE WHEN lang IN ('de', 'en') THEN 900.0 ELSE 1500.0 END AS thr FROM quality_scored) GROUP BY lang""",
)
def dataset_report(t):
    thr = t.spark.createDataFrame([("video", 900.0), ("audio", 1500.0)], "head string, threshold double")
    rows = t.quality_scored.select(F.col("lang").alias("dataset"), "y", F.col("score").cast("double").alias("score"))
    rows = rows.withColumn("head", F.when(F.col("dataset").isin("de", "en"), "video").otherwise("audio"))
    return M.dataset_accuracy(rows, thr).select("dataset", "n", rounded("acc").alias("acc"))


REPORT = f"""
    SELECT b.dataset, b.n, a.auc, c.lo, c.hi, b.acc FROM (SELECT dataset, count(*) AS n, avg(((score >= 100)::INT = y)::INT) AS acc FROM scored GROUP BY dataset) b
    JOIN (SELECT dataset, {AUC_EXPR} AS auc FROM ({auc_ranks('scored', 'dataset')})) a USING (dataset)
    LEFT JOIN ({ci_sql('scored', BOOT_CI, 'dataset')}) c USING (dataset)"""


def report(t):
    return E.dataset_report(t.scored.withColumn("_id", boot_id()), "_id", 100.0, n_boot=BOOT_CI)


@query(
    "leaderboard",
    f"""WITH r AS ({REPORT}) SELECT dataset, n::BIGINT AS n, round(auc, 6) AS auc, round(lo, 6) AS lo, round(hi, 6) AS hi, round(acc, 6) AS acc FROM r
        UNION ALL SELECT 'mean', sum(n)::BIGINT, round(avg(auc), 6), NULL, NULL, round(avg(acc), 6) FROM r""",
)
def leaderboard(t):
    board = E.leaderboard(report(t))
    return board.select("dataset", "n", *[rounded(c).alias(c) for c in ("auc", "lo", "hi", "acc")])


@query(
    "ci_overlap",
    f"""WITH r AS ({ci_sql('scored', BOOT_CI, 'grp')}), z AS (SELECT min(grp) AS base FROM r)
        SELECT a.grp, (SELECT count(*) FROM r b WHERE b.grp <> a.grp AND b.lo <= a.hi AND a.lo <= b.hi)::BIGINT AS n_overlaps,
               (SELECT (a.lo <= b.hi AND b.lo <= a.hi)::INT FROM r b, z WHERE b.grp = z.base) AS meets_baseline FROM r a""",
)
def ci_overlap(t):
    ci = B.bootstrap_ci(t.scored.withColumn("_id", boot_id()), "_id", BOOT_CI, by=["grp"])
    base = t.scored.agg(F.min("grp")).scalar()
    named = ci.withColumn("_base", base).withColumn("name", F.when(F.col("grp") == F.col("_base"), "base").otherwise("other"))
    return E.ci_overlap(named, "name", "lo", "hi", "base").select("grp", "n_overlaps", "meets_baseline")
