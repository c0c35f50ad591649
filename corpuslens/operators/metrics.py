"""Exact ranking and threshold metrics over scored tables.

Everything that needs score order starts from one table with a row per
distinct (group, score): a map-side combined aggregate that removes ties and
usually shrinks the data before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.numeric import equal_bin, ratio, right_closed_bin
from corpuslens.functions.paths import CATEGORIES
from corpuslens.plans.prefix import running_totals


def score_table(
    df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """(by, score, pos, neg): class counts, or weights, per distinct score."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(F.lit(0))).alias("neg"),
    )


def ordered_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return running_totals(table, "score", ["pos", "neg"], by)


def _pair_wins() -> Column:
    below = F.col("neg_before").cast("double") + F.col("neg") / 2.0
    return F.sum(F.col("pos").cast("double") * below)


def auc_from_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc); NULL auc when a group holds one class."""
    return (
        ordered_scores(table, by)
        .groupBy(*by)
        .agg(
            F.max("pos_total").alias("n_pos"),
            F.max("neg_total").alias("n_neg"),
            _pair_wins().alias("_wins"),
        )
        .select(
            *by,
            "n_pos",
            "n_neg",
            ratio(F.col("_wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        )
    )


def auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with average ranks for ties, NULL for a single class."""
    return auc_from_scores(score_table(df, y, score, by), by)


def auc_strict(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Like :func:`auc`, but the job fails when only one class is present."""
    return auc(df, y, score).withColumn(
        "auc",
        F.when(F.col("auc").isNull(), F.raise_error(F.lit("only one class present")).cast("double")).otherwise(
            F.col("auc")
        ),
    )


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tpr, fpr) per distinct score, plus the (0, 0, +inf) origin."""
    by = list(by)
    at_least = ordered_scores(score_table(df, y, score, by), by)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = at_least.select(
        *by,
        F.col("score").cast("double").alias("threshold"),
        F.coalesce(ratio(tp, F.col("pos_total")), F.lit(0.0)).alias("tpr"),
        F.coalesce(ratio(fp, F.col("neg_total")), F.lit(0.0)).alias("fpr"),
    )
    heads = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    origin = heads.select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("tpr"),
        F.lit(0.0).alias("fpr"),
    )
    return points.unionByName(origin)


def youden_from_scores(table: DataFrame, by: Sequence[str] = (), default: float = 0.5) -> DataFrame:
    """(by, threshold, j): best TPR - FPR, ties to the highest threshold."""
    tp = (F.col("pos_total") - F.col("pos_before")).cast("double") / F.col("pos_total")
    fp = (F.col("neg_total") - F.col("neg_before")).cast("double") / F.col("neg_total")
    two = (F.col("pos_total") > 0) & (F.col("neg_total") > 0)
    # Only observed scores compete, so the +inf origin can never win.
    best = F.max(F.when(two, F.struct((tp - fp).alias("j"), F.col("score").cast("double").alias("threshold"))))
    return (
        ordered_scores(table, by)
        .groupBy(*by)
        .agg(best.alias("_best"))
        .select(
            *by,
            F.coalesce(F.col("_best.threshold"), F.lit(default)).alias("threshold"),
            F.col("_best.j").alias("j"),
        )
    )


def youden(
    df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), default: float = 0.5
) -> DataFrame:
    return youden_from_scores(score_table(df, y, score, by), by, default)


def average_ranks(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``avg_rank``: 1-based, ties share the mean of their ranks."""
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(counts, score, ["n"], by).select(
        *by, score, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )
    return df.join(ranks, [*by, score])


def balanced_accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur."""
    recall = {k: F.avg(F.when(F.col(y) == k, (F.col(pred) == k).cast("double"))) for k in (0, 1)}
    both = F.array_compact(F.array("_r0", "_r1"))
    mean = F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(both), F.lit(0))
    return df.groupBy(*by).agg(recall[0].alias("_r0"), recall[1].alias("_r1")).select(
        *by, mean.alias("balanced_accuracy")
    )


def _cell(y: Column, pred: Column, t: int, p: int) -> Column:
    return F.coalesce(F.sum(((y == t) & (pred == p)).cast("bigint")), F.lit(0)).alias(f"c{t}{p}")


def confusion_2x2(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """All four cells, zeros included, from one aggregate."""
    cells = df.groupBy(*by).agg(*[_cell(F.col(y), F.col(pred), t, p) for t in (0, 1) for p in (0, 1)])
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("y"), F.lit(p).alias("pred"), F.col(f"c{t}{p}").alias("n"))
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    return cells.select(*by, F.inline(rows))


def confusion_4way(df: DataFrame, true: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """(cells, summary): dense 4x4 counts; accuracy and the rows left out."""
    names = CATEGORIES
    known = F.col(true).isin(names)
    agg = df.agg(
        *[
            F.coalesce(F.sum(((F.col(true) == t) & (F.col(pred) == p)).cast("bigint")), F.lit(0)).alias(f"c{i}_{j}")
            for i, t in enumerate(names)
            for j, p in enumerate(names)
        ],
        F.coalesce(F.sum((~known).cast("bigint")), F.lit(0)).alias("skipped"),
    )
    cells = agg.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(t).alias("true_category"), F.lit(p).alias("pred_category"), F.col(f"c{i}_{j}").alias("n"))
                    for i, t in enumerate(names)
                    for j, p in enumerate(names)
                ]
            )
        )
    )
    trace = sum((F.col(f"c{i}_{i}") for i in range(4)), F.lit(0))
    total = sum((F.col(f"c{i}_{j}") for i in range(4) for j in range(4)), F.lit(0))
    summary = agg.select(
        trace.cast("bigint").alias("correct"),
        total.cast("bigint").alias("total"),
        "skipped",
        ratio(trace, total).alias("attribution_accuracy"),
    )
    return cells, summary


def classification_report(
    df: DataFrame, y: str = "y", pred: str = "pred", names: Sequence[str] = ("class 0", "class 1")
) -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and weighted rows."""
    cells = df.agg(*[_cell(F.col(y), F.col(pred), t, p) for t in (0, 1) for p in (0, 1)])

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    cols = cells
    for k in (0, 1):
        tp, support = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")
        predicted = F.col(f"c0{k}") + F.col(f"c1{k}")
        cols = cols.withColumns({f"p{k}": safe(tp, predicted), f"r{k}": safe(tp, support), f"s{k}": support})
        p, r = F.col(f"p{k}"), F.col(f"r{k}")
        cols = cols.withColumn(f"f{k}", safe(2 * p * r, p + r))
    total = F.col("s0") + F.col("s1")

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        null = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("row"),
            (null if p is None else p).alias("precision"),
            (null if r is None else r).alias("recall"),
            f.alias("f1"),
            s.cast("bigint").alias("support"),
        )

    def weighted(m: str) -> Column:
        return safe(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), total)

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2.0

    rows = F.array(
        *[row(names[k], F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}")) for k in (0, 1)],
        row("accuracy", None, None, safe(F.col("c00") + F.col("c11"), total), total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    )
    return cols.select(F.inline(rows))


def _confidence(p: str) -> Column:
    return F.greatest(F.col(p), 1.0 - F.col(p))


def _calibration_bins(df: DataFrame, y: str, p: str, n_bins: int, by: Sequence[str]) -> DataFrame:
    correct = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return (
        df.select(*by, _confidence(p).alias("_conf"), correct.alias("_ok"))
        .withColumn("bin", right_closed_bin(F.col("_conf"), n_bins))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_conf").alias("confidence"), F.avg("_ok").alias("accuracy"))
    )


def calibration_error(
    df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 15, by: Sequence[str] = ()
) -> DataFrame:
    """Expected calibration error over right-closed confidence bins."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return _calibration_bins(df, y, p, n_bins, by).groupBy(*by).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def reliability(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n, confidence, accuracy); bins without rows do not appear."""
    return _calibration_bins(df, y, p, n_bins, by)


def score_histogram(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 25) -> DataFrame:
    """Counts per class and equal bin on [0, 1], empty bins included."""
    counts = df.groupBy(equal_bin(F.col(p), n_bins).alias("bin")).agg(
        F.sum((F.col(y) == 0).cast("bigint")).alias("n_real"), F.sum((F.col(y) == 1).cast("bigint")).alias("n_fake")
    )
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        F.coalesce("n_real", F.lit(0)).cast("bigint").alias("n_real"),
        F.coalesce("n_fake", F.lit(0)).cast("bigint").alias("n_fake"),
    )


def head_rows(df: DataFrame, heads: dict[str, tuple[str, Column]], has_audio: str, always: Sequence[str]) -> DataFrame:
    """Unpivot heads to (id columns, head, y, score), keeping a head's rows only
    where the clip has the evidence for it: ``always`` heads on every clip, the
    others only where ``has_audio``."""
    entries = F.array(
        *[
            F.struct(F.lit(h).alias("head"), y.cast("int").alias("y"), F.col(s).cast("double").alias("score"))
            for h, (s, y) in heads.items()
        ]
    )
    used = {s for s, _ in heads.values()}
    rest = [x for x in df.columns if x not in used]
    return df.select(*rest, F.inline(entries)).filter(F.col("head").isin(list(always)) | (F.col(has_audio) == 1))


def shortcut_audit(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """|AUC - 0.5| of each scalar feature used alone as a score, worst first flag."""
    long = df.select(
        F.col(y).alias("y"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])),
    )
    gaps = auc(long, by=["feature"]).select("feature", "auc", F.abs(F.col("auc") - 0.5).alias("gap"))
    worst = F.max(F.struct("gap", "feature")).over(W.partitionBy())  # one row per feature
    return gaps.withColumn("is_worst", worst["feature"] == F.col("feature"))


def threshold_transfer(
    df: DataFrame, fit: str = "val", apply: str = "test", y: str = "y", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Youden threshold on one split, balanced accuracy on another."""
    by = list(by)
    thr = youden(df.filter(F.col("split") == fit), y, score, by).select(*by, "threshold")
    test = df.filter(F.col("split") == apply)
    both = test.join(thr, by, "left") if by else test.withColumn("threshold", thr.select("threshold").scalar())
    scored = both.withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))
    classes = scored.groupBy(*by).agg(
        F.max("threshold").alias("threshold"),
        F.count(F.lit(1)).alias("n_test"),
        *[F.avg(F.when(F.col(y) == k, (F.col("pred") == k).cast("double"))).alias(f"_r{k}") for k in (0, 1)],
    )
    # NULL unless both classes occur in the applied split.
    return classes.select(*by, "threshold", "n_test", ((F.col("_r0") + F.col("_r1")) / 2.0).alias("balanced_accuracy"))


def dataset_accuracy(
    df: DataFrame, thresholds: DataFrame, y: str = "y", score: str = "score", by: str = "dataset", head: str = "head",
    default: float = 0.5,
) -> DataFrame:
    """(dataset, n, acc) at the head's threshold; NULL acc for a single class."""
    hit = ((F.col(score) >= F.coalesce("threshold", F.lit(default))).cast("int") == F.col(y)).cast("double")
    two = F.min(y) != F.max(y)
    return (
        df.join(thresholds.select(head, "threshold"), head, "left")
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.when(two, F.avg(hit)).alias("acc"))
    )


