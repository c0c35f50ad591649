"""Ranking metrics, thresholds, calibration and bootstrap."""

from pyspark.sql import functions as F

from corpuslens.functions.hashing import id60, MIX_A, MIX_B, MIX_MASK, MIX_STEP
from corpuslens.functions.numeric import edges, rounded, smooth_label
from corpuslens.operators import bootstrap as B
from corpuslens.operators import calibration as C
from corpuslens.operators import metrics as M
from corpuslens.operators.scoring import sample_rollup
from corpuslens.plans.catalog import query

AUC_RANKS = """
    SELECT {by} sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs, sum(y) AS np, count(*) - sum(y) AS nn
    FROM (SELECT {by} y, rank() OVER ({part} ORDER BY {score})
                 + (count(*) OVER (PARTITION BY {by} {score}) - 1) / 2.0 AS r FROM {src})
    {group}
"""


def auc_ranks(src: str, by: str = "", score: str = "score") -> str:
    return AUC_RANKS.format(
        src=src,
        score=score,
        by=f"{by}," if by else "",
        part=f"PARTITION BY {by}" if by else "",
        group=f"GROUP BY {by}" if by else "",
    )


AUC_EXPR = "(rs - np * (np + 1) / 2.0)::DOUBLE / nullif(np * nn, 0)::DOUBLE"


@query("auc", f"SELECT np::BIGINT AS n_pos, nn::BIGINT AS n_neg, round({AUC_EXPR}, 9) AS auc FROM ({auc_ranks('scored_ties')})")
def auc(t):
    return M.auc(t.scored_ties).select("n_pos", "n_neg", rounded("auc", 9).alias("auc"))


@query("auc_by_group", f"SELECT grp, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, round({AUC_EXPR}, 9) AS auc FROM ({auc_ranks('scored', 'grp')})")
def auc_by_group(t):
    return M.auc(t.scored, by=["grp"]).select("grp", "n_pos", "n_neg", rounded("auc", 9).alias("auc"))


@query(
    "avg_rank",
    """SELECT id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS avg_rank
       FROM scored_ties""",
)
def avg_rank(t):
    return M.average_ranks(t.scored_ties.select("id", "score")).select("id", F.col("avg_rank").cast("double").alias("avg_rank"))


ROC = """
    SELECT score AS threshold, tp / p AS tpr, fp / n AS fpr FROM (
      SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp,
             sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n
      FROM (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY score))
"""


@query(
    "roc_curve",
    f"""SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM ({ROC.format(src='scored')})
        UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
)
def roc_curve(t):
    return M.roc_curve(t.scored).select("threshold", rounded("tpr", 9).alias("tpr"), rounded("fpr", 9).alias("fpr"))


YOUDEN = """
    SELECT {by} arg_max(score, (j, score)) AS threshold, max(j) AS j FROM (
      SELECT {by} score, sum(pos) OVER ({part} ORDER BY score DESC)::DOUBLE / sum(pos) OVER ({part})
             - sum(neg) OVER ({part} ORDER BY score DESC)::DOUBLE / sum(neg) OVER ({part}) AS j
      FROM (SELECT {by} score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {src} GROUP BY {by} score)) {group}
"""


def youden_sql(src: str, by: str = "") -> str:
    return YOUDEN.format(
        src=src, by=f"{by}," if by else "", part=f"PARTITION BY {by}" if by else "", group=f"GROUP BY {by}" if by else ""
    )


@query("youden", f"SELECT grp, threshold, round(j, 9) AS j FROM ({youden_sql('scored', 'grp')}) ")
def youden(t):
    return M.youden(t.scored, by=["grp"]).select("grp", "threshold", rounded("j", 9).alias("j"))


PRED = "(SELECT *, (score >= 0.05)::INT AS pred FROM scored_ties)"


def _pred(t):
    return t.scored_ties.withColumn("pred", (F.col("score") >= 0.05).cast("int"))


@query(
    "balanced_accuracy",
    f"SELECT grp, round(avg(r), 9) AS balanced_accuracy FROM (SELECT grp, y, avg((pred = y)::INT) AS r FROM {PRED} GROUP BY grp, y) GROUP BY grp",
)
def balanced_accuracy(t):
    return M.balanced_accuracy(_pred(t), by=["grp"]).select("grp", rounded("balanced_accuracy", 9).alias("balanced_accuracy"))


@query(
    "classification_report",
    f"""
    WITH k AS (SELECT c, sum((y = c AND pred = c)::INT)::DOUBLE AS tp, sum((pred = c)::INT)::DOUBLE AS pp,
                      sum((y = c)::INT)::DOUBLE AS s, count(*)::DOUBLE AS n
               FROM {PRED}, (VALUES (0), (1)) v(c) GROUP BY c),
    m AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r FROM k),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m)
    SELECT row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM (
      SELECT CASE c WHEN 0 THEN 'real' ELSE 'fake' END AS row, p, r, f, s AS support FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / max(n), max(n) FROM f
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), max(n) FROM f
      UNION ALL SELECT 'weighted avg', sum(p * s) / max(n), sum(r * s) / max(n), sum(f * s) / max(n), max(n) FROM f)
    """,
)
def classification_report(t):
    rep = M.classification_report(_pred(t), names=("real", "fake"))
    return rep.select("row", rounded("precision").alias("precision"), rounded("recall").alias("recall"), rounded("f1").alias("f1"), "support")


@query(
    "confusion_2x2",
    f"""SELECT g.y, g.pred, count(p.y)::BIGINT AS n FROM (SELECT * FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(pred)) g
        LEFT JOIN {PRED} p ON p.y = g.y AND p.pred = g.pred GROUP BY g.y, g.pred""",
)
def confusion_2x2(t):
    return M.confusion_2x2(_pred(t))


FOUR = "(VALUES ('RealVideo-RealAudio'), ('RealVideo-FakeAudio'), ('FakeVideo-RealAudio'), ('FakeVideo-FakeAudio'))"
PRED_CAT = """(SELECT category, (CASE WHEN video_pred = 1 THEN 'FakeVideo' ELSE 'RealVideo' END) || '-' ||
               (CASE WHEN audio_pred = 1 THEN 'FakeAudio' ELSE 'RealAudio' END) AS pred FROM modality)"""


def _four(t):
    from corpuslens.functions.paths import category_of

    return M.confusion_4way(t.modality.withColumn("pred_category", category_of("video_pred", "audio_pred")), "category", "pred_category")


@query(
    "confusion_4way",
    f"""SELECT a.c AS true_category, b.c AS pred_category, count(p.pred)::BIGINT AS n FROM {FOUR} a(c) CROSS JOIN {FOUR} b(c)
        LEFT JOIN {PRED_CAT} p ON p.category = a.c AND p.pred = b.c GROUP BY a.c, b.c""",
)
def confusion_4way(t):
    return _four(t)[0]


@query(
    "attribution_accuracy",
    f"""SELECT count(*) FILTER (category = pred)::BIGINT AS correct, count(*) FILTER (category <> 'Unknown')::BIGINT AS total,
               count(*) FILTER (category = 'Unknown')::BIGINT AS skipped,
               round(count(*) FILTER (category = pred)::DOUBLE / count(*) FILTER (category <> 'Unknown'), 9) AS attribution_accuracy
        FROM {PRED_CAT}""",
)
def attribution_accuracy(t):
    return _four(t)[1].withColumn("attribution_accuracy", rounded("attribution_accuracy", 9))


def _bin_sql(n: int) -> str:
    return " + ".join(f"(conf > {e!r}::DOUBLE)::INT" for e in edges(n)[1:-1])


def _cal_sql(n: int) -> str:
    return f"""SELECT {_bin_sql(n)} AS bin, count(*) AS n, avg(conf) AS confidence, avg(ok) AS accuracy FROM (
        SELECT greatest(p, 1.0::DOUBLE - p) AS conf, ((p >= 0.5)::INT = y)::INT::DOUBLE AS ok FROM scored) GROUP BY 1"""


@query("ece", f"SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece FROM ({_cal_sql(15)})")
def ece(t):
    return M.calibration_error(t.scored).select(rounded("ece", 9).alias("ece"))


@query(
    "reliability",
    f"SELECT bin, n::BIGINT AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM ({_cal_sql(10)})",
)
def reliability(t):
    return M.reliability(t.scored).select("bin", "n", rounded("confidence").alias("confidence"), rounded("accuracy").alias("accuracy"))


@query(
    "score_histogram",
    """SELECT g.bin::INT AS bin, count(*) FILTER (s.y = 0)::BIGINT AS n_real, count(*) FILTER (s.y = 1)::BIGINT AS n_fake
       FROM range(25) g(bin) LEFT JOIN (SELECT y, least(floor(p * 25), 24) AS b FROM scored WHERE p BETWEEN 0 AND 1) s ON s.b = g.bin
       GROUP BY g.bin""",
)
def score_histogram(t):
    return M.score_histogram(t.scored)


HEADS = """
    SELECT id, 'video' AS head, video_label AS y, video_score AS score FROM modality
    UNION ALL SELECT id, 'audio', audio_label, audio_score FROM modality WHERE has_audio = 1
    UNION ALL SELECT id, 'fusion', greatest(video_label, audio_label), fusion_score FROM modality WHERE has_audio = 1
"""


def _heads(t):
    from corpuslens.functions.paths import any_fake

    heads = {
        "video": ("video_score", F.col("video_label")),
        "audio": ("audio_score", F.col("audio_label")),
        "fusion": ("fusion_score", any_fake("video_label", "audio_label")),
    }
    return M.head_rows(t.modality, heads, "has_audio", ["video"])


@query("head_unpivot_mask", f"SELECT id, head, y, round(score, 6) AS score FROM ({HEADS})")
def head_unpivot_mask(t):
    return _heads(t).select("id", "head", "y", rounded("score").alias("score"))


# The sync head scores a clip's matched window as 0 and its shifted one as 1.
SYNC = """
    UNION ALL SELECT id, 'sync', 0, video_score - audio_score FROM modality WHERE has_audio = 1
    UNION ALL SELECT id, 'sync', 1, video_score - 0.9::DOUBLE * audio_score FROM modality WHERE has_audio = 1
"""


@query(
    "head_report",
    f"""WITH h AS ({HEADS} {SYNC}) SELECT head, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, round({AUC_EXPR}, 9) AS auc
        FROM ({auc_ranks('h', 'head')})""",
)
def head_report(t):
    matched = F.struct(F.lit(0).alias("y"), (F.col("video_score") - F.col("audio_score")).alias("score"))
    shifted = F.struct(F.lit(1).alias("y"), (F.col("video_score") - 0.9 * F.col("audio_score")).alias("score"))
    sync = t.modality.filter("has_audio = 1").select("id", F.lit("sync").alias("head"), F.inline(F.array(matched, shifted)))
    rows = _heads(t).select("id", "head", "y", "score").unionByName(sync)
    return M.auc(rows, by=["head"]).select("head", "n_pos", "n_neg", rounded("auc", 9).alias("auc"))


FEATURES = """
    SELECT doc_id, y, 'n_chars' AS feature, score::DOUBLE AS score FROM quality_scored
    UNION ALL SELECT doc_id, y, 'n_words', len(string_split(text, ' '))::DOUBLE FROM quality_scored
    UNION ALL SELECT doc_id, y, 'n_lines', len(string_split(text, chr(10)))::DOUBLE FROM quality_scored
    UNION ALL SELECT doc_id, y, 'toxic', toxic::DOUBLE FROM quality_scored
"""


@query(
    "shortcut_audit",
    f"""WITH f AS ({FEATURES}), a AS (SELECT feature, {AUC_EXPR} AS auc FROM ({auc_ranks('f', 'feature')}))
        SELECT feature, round(auc, 9) AS auc, round(abs(auc - 0.5), 9) AS gap,
               (feature = (SELECT arg_max(feature, (abs(auc - 0.5), feature)) FROM a))::INT AS is_worst FROM a""",
)
def shortcut_audit(t):
    rows = t.quality_scored.select(
        "y",
        F.col("score").alias("n_chars"),
        F.size(F.split("text", " ")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        "toxic",
    )
    out = M.shortcut_audit(rows, "y", ["n_chars", "n_words", "n_lines", "toxic"])
    return out.select("feature", rounded("auc", 9).alias("auc"), rounded("gap", 9).alias("gap"), F.col("is_worst").cast("int").alias("is_worst"))


@query(
    "val_thr_test_bacc",
    f"""WITH v AS (SELECT * FROM split_scored WHERE split = 'val'), thr AS ({youden_sql('v', 'dataset')})
        SELECT s.dataset, max(thr.threshold) AS threshold, count(*)::BIGINT AS n_test,
               round((avg(CASE WHEN y = 0 THEN (score < threshold)::INT END) + avg(CASE WHEN y = 1 THEN (score >= threshold)::INT END)) / 2, 9)
                 AS balanced_accuracy
        FROM split_scored s JOIN thr ON thr.dataset = s.dataset WHERE s.split = 'test' GROUP BY s.dataset""",
)
def val_thr_test_bacc(t):
    out = M.threshold_transfer(t.split_scored, by=["dataset"])
    return out.withColumn("balanced_accuracy", rounded("balanced_accuracy", 9))


MC = """
    SELECT clip, h.head, s.sample, (CASE WHEN h.head = 'video' THEN v_label ELSE a_label END) AS y,
           (((clip * 31 + s.sample * 17 + h.k) % 41) - 20) / 10.0::DOUBLE AS logit
    FROM mc_base, range(20) s(sample), (VALUES ('video', 0), ('audio', 5)) h(head, k) WHERE h.head = 'video' OR has_audio = 1
"""


def _mc(t):
    heads = F.array(
        F.struct(F.lit("video").alias("head"), F.lit(0).alias("k"), F.col("v_label").alias("y")),
        F.struct(F.lit("audio").alias("head"), F.lit(5).alias("k"), F.col("a_label").alias("y")),
    )
    rows = t.mc_base.select("clip", "has_audio", F.inline(heads)).filter("head = 'video' or has_audio = 1")
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(19))))
    z = (F.pmod(F.col("clip") * 31 + F.col("sample") * 17 + F.col("k"), F.lit(41)) - 20) / F.lit(10.0)
    return rows.select("clip", "head", "sample", "y", z.alias("logit"))


@query(
    "mc_rollup",
    f"""SELECT clip, head, max(y)::INT AS y, round(avg(logit), 6) + 0.0 AS mean_logit,
               round(stddev_pop(1.0 / (1.0 + exp(-logit))), 6) AS std_prob FROM ({MC}) GROUP BY clip, head""",
)
def mc_rollup(t):
    out = sample_rollup(_mc(t), ["clip", "head", "y"])
    return out.select("clip", "head", "y", rounded("mean_logit").alias("mean_logit"), rounded("std_prob").alias("std_prob"))


SQL_STEPS = 16


def temperature_sql(src: str, steps: int) -> str:
    """Newton on 1 / T as a chain of aggregates, one CTE per step."""
    parts = [
        f"cnt AS (SELECT head, logit AS z, y, count(*) AS n FROM ({src}) GROUP BY 1, 2, 3)",
        "st0 AS (SELECT head, 0.025::DOUBLE AS lo, 40.0::DOUBLE AS hi, 1.0::DOUBLE AS beta FROM cnt GROUP BY head)",
    ]
    for i in range(steps):
        parts.append(
            f"""g{i} AS (SELECT head, max(lo) AS lo, max(hi) AS hi, max(beta) AS beta,
                   sum(n * z * (1.0 / (1.0 + exp(-z * beta)) - y)) AS g,
                   sum(n * z * z * (1.0 / (1.0 + exp(-z * beta))) * (1.0 - 1.0 / (1.0 + exp(-z * beta)))) AS h
                 FROM cnt JOIN st{i} USING (head) GROUP BY head),
             b{i} AS (SELECT head, CASE WHEN g < 0 THEN beta ELSE lo END AS lo, CASE WHEN g > 0 THEN beta ELSE hi END AS hi,
                   beta, beta - g / nullif(h, 0) AS nw, g FROM g{i}),
             st{i + 1} AS (SELECT head, lo, hi, CASE WHEN g = 0 THEN beta WHEN abs(nw - beta) <= beta * 1e-9 OR (nw > lo AND nw < hi) THEN nw ELSE sqrt(lo * hi) END AS beta
                 FROM b{i})"""
        )
    return "WITH " + ",\n".join(parts) + f" SELECT head, 1.0 / beta AS t FROM st{steps}"


TEMP_SRC = """SELECT 'raw' AS head, logit, y FROM scored
              UNION ALL SELECT 'sharp', (score - 400.0) / 60.0, CASE WHEN score + (id % 97) * 2.0 > 300 THEN 1 ELSE 0 END FROM scored"""


@query(
    "temperature",
    f"""SELECT head, CASE WHEN t > 0.05 AND t < 20 THEN round(t, 6) ELSE 1.0 END AS temperature
        FROM ({temperature_sql(TEMP_SRC, SQL_STEPS)})""",
)
def temperature(t):
    s = t.scored
    sharp = F.when(F.col("score") + F.pmod("id", F.lit(97)) * 2.0 > 300, 1).otherwise(0)
    rows = s.select(F.lit("raw").alias("head"), "logit", "y").unionByName(
        s.select(F.lit("sharp").alias("head"), ((F.col("score") - 400.0) / 60.0).alias("logit"), sharp.alias("y"))
    )
    return C.fit_temperature(rows).select("head", rounded("temperature").alias("temperature"))


@query(
    "calibrated_decisions",
    """SELECT id, head, round(p, 9) AS p, (p >= thr)::INT AS pred FROM (
         SELECT s.id, s.head, 1.0 / (1.0 + exp(-(s.logit / coalesce(c.temp, 1.0)))) AS p, coalesce(c.thr, 0.5) AS thr
         FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'sync' END AS head, logit FROM scored) s
         LEFT JOIN (VALUES ('video', 0.75::DOUBLE, 0.6::DOUBLE), ('audio', 1.5::DOUBLE, 0.4::DOUBLE)) c(head, temp, thr) ON c.head = s.head)""",
)
def calibrated_decisions(t):
    cal = t.spark.createDataFrame([("video", 0.75, 0.6), ("audio", 1.5, 0.4)], "head string, temperature double, threshold double")
    head = F.when(F.col("id") % 3 == 0, "video").when(F.col("id") % 3 == 1, "audio").otherwise("sync")
    out = C.calibrated(t.scored.select("id", "logit", head.alias("head")), cal)
    return out.select("id", "head", rounded("p", 9).alias("p"), "pred")


@query("smoothed_labels", "SELECT id, round(y * 0.95::DOUBLE + 0.025::DOUBLE, 6) AS target FROM scored_ties")
def smoothed_labels(t):
    return t.scored_ties.select("id", rounded(smooth_label("y", 0.05)).alias("target"))


# ---- bootstrap ---------------------------------------------------------------


def bits_sql(rows: str, n_boot: int) -> str:
    """(columns of rows, which have ident), replicate, u: numbers of 31 bits."""
    return f"""
      SELECT *, xor(h3, h3 >> 16) AS u FROM (SELECT *, (xor(xor(h2, hi), h2 >> 13) * {MIX_B}) & {MIX_MASK} AS h3
      FROM (SELECT *, (xor(h1, h1 >> 15) * {MIX_A}) & {MIX_MASK} AS h2 FROM (
        SELECT s.*, r.replicate, xor(ident & {MIX_MASK}, ((r.replicate + 1) * {MIX_STEP}) & {MIX_MASK}) AS h1, (ident >> 31) & {MIX_MASK} AS hi
        FROM ({rows}) s, range({n_boot}) r(replicate))))"""


def weights_sql(src: str, n_boot: int) -> str:
    """(rows of src).*, replicate, w: the same draws in SQL."""
    cuts = " + ".join(f"(u >= {cut})::INT" for cut in B.POISSON_CDF)
    rows = f"SELECT *, ('0x' || substr(md5('boot:42:' || id), 1, 15))::BIGINT AS ident FROM {src}"
    return f"SELECT *, {cuts} AS w FROM ({bits_sql(rows, n_boot)})"


def boot_auc_sql(src: str, n_boot: int, by: str = "") -> str:
    b = f"{by}," if by else ""
    return f"""
      SELECT {b} replicate, (sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE)::DOUBLE AS value FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY {b} replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
        FROM (SELECT {b} replicate, score, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg
              FROM ({weights_sql(src, n_boot)}) GROUP BY {b} replicate, score)) GROUP BY {b} replicate"""


def ci_sql(src: str, n_boot: int, by: str = "") -> str:
    b = f"{by}," if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b} quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n_valid
               FROM ({boot_auc_sql(src, n_boot, by)}) WHERE value IS NOT NULL {tail}"""


BOOT_CI, BOOT_THR = 2000, 200


def boot_id():
    return id60("boot", 42, "id")


@query(
    "bootstrap_ci",
    f"""SELECT 'ties' AS name, round(lo, 9) AS lo, round(hi, 9) AS hi, n_valid::BIGINT AS n_valid FROM ({ci_sql('scored_ties', BOOT_CI)})
        UNION ALL SELECT 'events', round(lo, 9), round(hi, 9), n_valid::BIGINT FROM ({ci_sql('scored', BOOT_CI)})""",
)
def bootstrap_ci(t):
    parts = []
    for name, src in (("ties", t.scored_ties), ("events", t.scored)):
        ci = B.bootstrap_ci(src.withColumn("_id", boot_id()), "_id", BOOT_CI)
        parts.append(ci.select(F.lit(name).alias("name"), rounded("lo", 9).alias("lo"), rounded("hi", 9).alias("hi"), "n_valid"))
    return parts[0].unionByName(parts[1])


def ties_auc_sql(src: str, n_boot: int) -> str:
    return f"""
      WITH s AS (SELECT DISTINCT count(*) AS n FROM {src} GROUP BY score, y),
      k AS (SELECT n, unnest(range(greatest(0, n - (floor(12 * sqrt(n))::BIGINT + 12)), n + floor(12 * sqrt(n))::BIGINT + 13)) AS k FROM s),
      cdf AS (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS p FROM k),
      steps AS (SELECT n, min(k) AS first_k, list(p ORDER BY k) AS ps FROM cdf GROUP BY n),
      h AS ({bits_sql(f"SELECT *, ('0x' || substr(md5('boot:42:' || score::DECIMAL(38,9) || ':' || y), 1, 15))::BIGINT AS ident FROM (SELECT score, y, count(*) AS n FROM {src} GROUP BY score, y)", n_boot)}),
      w AS (SELECT score, y, replicate, first_k + least(len(list_filter(ps, lambda p: p <= u / {MIX_MASK + 1}.0::DOUBLE)), len(ps) - 1) AS w FROM h JOIN steps USING (n))
      SELECT replicate, (sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE)::DOUBLE AS value FROM (
        SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
        FROM (SELECT replicate, score, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM w GROUP BY replicate, score)) GROUP BY replicate"""


@query(
    "bootstrap_ties",
    f"""SELECT round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi, count(*)::BIGINT AS n_valid
        FROM ({ties_auc_sql('scored_ties', BOOT_CI)}) WHERE value IS NOT NULL""",
)
def bootstrap_ties(t):
    """The interval of ``bootstrap_ci`` with one draw per distinct score, label and replicate."""
    ci = B.bootstrap_ci(B.compacted(t.scored_ties), "ident", BOOT_CI, n="n")
    return ci.select(rounded("lo", 9).alias("lo"), rounded("hi", 9).alias("hi"), "n_valid")


@query(
    "bootstrap_brier",
    f"""SELECT dataset, replicate::INT AS replicate, round((sum(w * (p - y) * (p - y)) / sum(w))::DOUBLE, 9) AS value
        FROM ({weights_sql('scored', BOOT_THR)}) GROUP BY dataset, replicate HAVING sum(w) > 0""",
)
def bootstrap_brier(t):
    """A folded metric on scores that hardly repeat."""
    src = t.scored.withColumn("_id", boot_id())
    out = B.bootstrap_fold(src, "_id", B.Brier(), BOOT_THR, score="p", by=["dataset"])
    return out.select("dataset", "replicate", rounded("value", 9).alias("value"))


@query(
    "bootstrap_metric",
    f"""SELECT replicate::INT AS replicate, round((sum(w * (y = (score >= 0.05)::INT)::INT * (1 - y))::DOUBLE / sum(w * (1 - y))
                + sum(w * (y = (score >= 0.05)::INT)::INT * y)::DOUBLE / sum(w * y)) / 2, 9) AS value
        FROM ({weights_sql('scored_ties', BOOT_CI)}) GROUP BY replicate""",
)
def bootstrap_metric(t):
    def balanced(weighted, groups):
        hit = (F.col("y") == (F.col("score") >= 0.05).cast("int")).cast("int")
        recall = [
            F.sum(F.when(F.col("y") == k, F.col("w") * hit)) / F.sum(F.when(F.col("y") == k, F.col("w"))) for k in (0, 1)
        ]
        return weighted.groupBy(*groups).agg(((recall[0] + recall[1]) / 2).alias("value"))

    src = t.scored_ties.withColumn("_id", boot_id())
    return B.bootstrap_metric(src, "_id", balanced, BOOT_CI).select("replicate", rounded("value", 9).alias("value"))


@query(
    "bootstrap_threshold",
    f"""
    WITH c AS (SELECT dataset, replicate, score, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg
               FROM ({weights_sql('scored', BOOT_THR)}) GROUP BY 1, 2, 3 HAVING sum(w) > 0),
    j AS (SELECT dataset, replicate, score, sum(pos) OVER (PARTITION BY dataset, replicate ORDER BY score DESC) / sum(pos) OVER (PARTITION BY dataset, replicate)
            - sum(neg) OVER (PARTITION BY dataset, replicate ORDER BY score DESC) / sum(neg) OVER (PARTITION BY dataset, replicate) AS j FROM c)
    SELECT dataset, round(quantile_cont(thr, 0.5), 6) AS threshold
    FROM (SELECT dataset, replicate, arg_max(score, (j, score)) AS thr FROM j GROUP BY 1, 2) GROUP BY dataset""",
)
def bootstrap_threshold(t):
    out = B.stable_threshold(t.scored.withColumn("_id", boot_id()), "_id", BOOT_THR, by=["dataset"])
    return out.select("dataset", rounded("threshold").alias("threshold"))


# ---- calibrate on val, report on test ------------------------------------------

HEADED = """SELECT id, split, y, CASE id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'fusion' END AS head,
                   logit + CASE WHEN id % 3 = 0 THEN 2.0::DOUBLE * y ELSE 0.0::DOUBLE END AS logit FROM split_scored"""
CAL_SQL = f"""
    t AS (SELECT head, CASE WHEN t > 0.05 AND t < 20 THEN t ELSE 1.0 END AS temp FROM ({temperature_sql("SELECT * FROM hv", SQL_STEPS)})),
    pv AS (SELECT hv.id, hv.head, hv.y, 1.0 / (1.0 + exp(-(hv.logit / t.temp))) AS score FROM hv JOIN t USING (head)),
    cw AS (SELECT head, replicate, score, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg
           FROM ({weights_sql('pv', BOOT_THR)}) GROUP BY 1, 2, 3 HAVING sum(w) > 0),
    jw AS (SELECT head, replicate, score, sum(pos) OVER (PARTITION BY head, replicate ORDER BY score DESC) / sum(pos) OVER (PARTITION BY head, replicate)
             - sum(neg) OVER (PARTITION BY head, replicate ORDER BY score DESC) / sum(neg) OVER (PARTITION BY head, replicate) AS j FROM cw),
    thr AS (SELECT head, quantile_cont(thr, 0.5) AS threshold FROM (SELECT head, replicate, arg_max(score, (j, score)) AS thr FROM jw GROUP BY 1, 2) GROUP BY 1),
    va AS (SELECT head, {AUC_EXPR} AS val_auc FROM ({auc_ranks('hv', 'head', 'logit')}))"""
WITH_CAL = f"WITH h AS ({HEADED}), hv AS (SELECT * FROM h WHERE split = 'val'), {CAL_SQL}"


def _headed(t):
    head = F.when(F.col("id") % 3 == 0, "video").when(F.col("id") % 3 == 1, "audio").otherwise("fusion")
    z = F.col("logit") + F.when(F.col("id") % 3 == 0, 2.0 * F.col("y")).otherwise(0.0)
    return t.split_scored.select("id", "split", "y", head.alias("head"), z.alias("logit"), boot_id().alias("_id"))


def _calibration(t):
    from corpuslens.operators.evaluation import calibrate

    return calibrate(_headed(t).filter("split = 'val'"), "_id", n_boot=BOOT_THR)


@query(
    "calibration_fit",
    f"{WITH_CAL} SELECT head, round(temp, 6) AS temperature, round(threshold, 6) AS threshold, round(val_auc, 6) AS val_auc FROM t JOIN thr USING (head) JOIN va USING (head)",
)
def calibration_fit(t):
    return _calibration(t).select("head", *[rounded(c).alias(c) for c in ("temperature", "threshold", "val_auc")])


@query(
    "test_report",
    f"""{WITH_CAL},
    s AS (SELECT h.id, h.head, h.y, 1.0 / (1.0 + exp(-(h.logit / t.temp))) AS score, thr.threshold FROM h JOIN t USING (head) JOIN thr USING (head) WHERE h.split = 'test'),
    b AS (SELECT head, count(*) AS n, avg(((score >= threshold)::INT = y)::INT) AS acc FROM s GROUP BY head),
    a AS (SELECT head, {AUC_EXPR} AS auc FROM ({auc_ranks('s', 'head')})),
    c AS ({ci_sql('s', BOOT_CI, 'head')}),
    e AS (SELECT head, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM (
            SELECT head, {_bin_sql(15)} AS bin, count(*) AS n, avg(conf) AS confidence, avg(ok) AS accuracy
            FROM (SELECT head, greatest(score, 1.0::DOUBLE - score) AS conf, ((score >= 0.5)::INT = y)::INT::DOUBLE AS ok FROM s) GROUP BY 1, 2) GROUP BY head)
    SELECT head, b.n::BIGINT AS n, round(auc, 6) AS auc, round(lo, 6) AS lo, round(hi, 6) AS hi, round(ece, 6) AS ece, round(acc, 6) AS acc,
           (val_auc >= 0.7)::INT AS reportable
    FROM b JOIN a USING (head) JOIN c USING (head) JOIN e USING (head) JOIN va USING (head)""",
)
def held_out_report(t):
    from corpuslens.operators.evaluation import report
    from corpuslens.session import cut_lineage

    cal = cut_lineage(_calibration(t), "calibration")  # one row per head
    out = report(_headed(t).filter("split = 'test'"), cal, "_id", n_boot=BOOT_CI)
    return out.select("head", "n", *[rounded(c).alias(c) for c in ("auc", "lo", "hi", "ece", "acc")], "reportable")
