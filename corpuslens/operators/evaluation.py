"""Calibrate heads on one split and report them on another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.numeric import sigmoid
from corpuslens.operators.bootstrap import bootstrap_ci, stable_threshold
from corpuslens.operators.calibration import calibrated, fit_temperature
from corpuslens.operators.metrics import auc, calibration_error
from corpuslens.session import cut_lineage


def calibrate(val: DataFrame, ident: str, logit: str = "logit", n_boot: int = 200) -> DataFrame:
    """(head, temperature, threshold, val_auc) fitted on (head, y, logit) rows."""
    temps = cut_lineage(fit_temperature(val, logit), "temperature")  # one row per head
    p = val.join(temps, "head").withColumn("score", sigmoid(logit, F.col("temperature")))
    thr = stable_threshold(p, ident, n_boot, by=["head"])
    area = auc(val, score=logit, by=["head"]).select("head", F.col("auc").alias("val_auc"))
    return temps.join(thr, "head").join(area, "head", "left")


def report(
    test: DataFrame, calibration: DataFrame, ident: str, logit: str = "logit", n_boot: int = 2000, min_auc: float = 0.7
) -> DataFrame:
    """One row per head: n, auc with interval, ece, accuracy, reportable.

    A head is reportable when its AUC on the calibration split reached
    ``min_auc``.
    """
    rows = calibrated(test, calibration, logit)
    hit = F.avg((F.col("pred") == F.col("y")).cast("double"))
    base = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"), hit.alias("acc"))
    area = auc(rows, score="p", by=["head"]).select("head", "auc")
    ci = bootstrap_ci(rows, ident, n_boot, score="p", by=["head"]).select("head", "lo", "hi")
    ece = calibration_error(rows, by=["head"])
    flag = calibration.select("head", F.coalesce(F.col("val_auc") >= min_auc, F.lit(False)).cast("int").alias("reportable"))
    out = base
    for part in (area, ci, ece, flag):
        out = out.join(part, "head", "left")
    return out.select("head", "n", "auc", "lo", "hi", "ece", "acc", "reportable")
