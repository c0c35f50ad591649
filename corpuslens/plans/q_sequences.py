"""Frame windows, time series, intervals, lags and clip scores."""

import numpy as np
from pyspark.sql import functions as F

from corpuslens.functions.numeric import dot, norm, rounded, sigmoid
from corpuslens.operators import intervals as V
from corpuslens.operators import scoring as SC
from corpuslens.operators import sequences as Q
from corpuslens.plans.catalog import query
from corpuslens.plans.q_sampling import unit

W = "[" + ", ".join(f"{((i * 7) % 11 - 5) / 10}" for i in range(64)) + "]"
WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]
LOGIT = f"list_inner_product(embedding::DOUBLE[], {W}::DOUBLE[])"


def logit():
    return dot(F.col("embedding").cast("array<double>"), F.array(*[F.lit(w) for w in WEIGHTS]))


@query(
    "centre_window",
    """SELECT clip, frame_idx, start::INT AS start FROM (SELECT clip, frame_idx, greatest(0, count(*) OVER (PARTITION BY clip) - 12) // 2 AS start FROM frames_more) WHERE frame_idx >= start AND frame_idx < start + 12""",
)
def centre_window(t):
    rows = t.frames_more.select("clip", "frame_idx")
    return Q.window_of(rows, "clip", "frame_idx", 12).select("clip", "frame_idx", "start")


RUN = """SELECT clip, frame_idx, start::INT AS start_frame FROM (
           SELECT clip, frame_idx, ('0x' || substr(md5('{tag}:42:' || clip), 1, 8))::BIGINT % (greatest(0, count(*) OVER (PARTITION BY clip) - 8) + 1) AS start FROM frames)
         WHERE frame_idx >= start AND frame_idx < start + 8"""


@query("train_window", RUN.format(tag="window").replace("start_frame", "start"))
def train_window(t):
    return Q.window_of(t.frames.select("clip", "frame_idx"), "clip", "frame_idx", 8, train_seed=42).select("clip", "frame_idx", "start")


@query("contiguous_run", RUN.format(tag="run"))
def contiguous_run(t):
    return Q.contiguous_run(t.frames.select("clip", "frame_idx"), "clip", "frame_idx", 8).select("clip", "frame_idx", "start_frame")


@query(
    "pad_sequence",
    """WITH f AS (SELECT * FROM frames_more), s AS (SELECT clip, count(*) AS n, max(ts) AS last_ts FROM f GROUP BY clip)
       SELECT s.clip, g.j::INT AS frame_idx, round(coalesce(f.ts, s.last_ts + (g.j - s.n + 1) / 25.0::DOUBLE), 6) AS ts, coalesce(f.valid, false)::INT AS valid
       FROM s CROSS JOIN range(24) g(j) LEFT JOIN f ON f.clip = s.clip AND f.frame_idx = g.j""",
)
def pad_sequence(t):
    out = Q.pad_frames(t.frames_more, "clip", "frame_idx", "ts", "valid", F.lit(25.0), 24)
    return out.select("clip", "frame_idx", rounded("ts").alias("ts"), F.col("valid").cast("int").alias("valid"))


BOXES = """
    SELECT clip, frame_idx, detected, w, h, CASE WHEN ok THEN l END AS l, CASE WHEN ok THEN t END AS t, CASE WHEN ok THEN r END AS r, CASE WHEN ok THEN b END AS b FROM (
      SELECT *, detected AND r - l >= 8 AND b - t >= 8 AS ok FROM (
        SELECT *, greatest(0, round_even((x1 + x2) / 2 - half, 0)) AS l, greatest(0, round_even((y1 + y2) / 2 - half, 0)) AS t,
               least(w, round_even((x1 + x2) / 2 + half, 0)) AS r, least(h, round_even((y1 + y2) / 2 + half, 0)) AS b
        FROM (SELECT *, greatest(x2 - x1, y2 - y1) * 1.3::DOUBLE / 2 AS half FROM boxes)))"""


def _carried(c: str) -> str:
    return f"""CASE WHEN detected THEN {c} ELSE last_value({c} IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame_idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS {c}"""


@query(
    "box_ffill",
    f"""SELECT clip, frame_idx, coalesce(l, (w - least(w, h)) // 2)::INT AS l, coalesce(t, (h - least(w, h)) // 2)::INT AS t,
               coalesce(r, (w + least(w, h)) // 2)::INT AS r, coalesce(b, (h + least(w, h)) // 2)::INT AS b, (l IS NOT NULL)::INT AS usable
        FROM (SELECT clip, frame_idx, w, h, {_carried('l')}, {_carried('t')}, {_carried('r')}, {_carried('b')} FROM ({BOXES}))""",
)
def box_ffill(t):
    out = Q.tracked_boxes(t.boxes, "clip", "frame_idx", "detected", 0.3)
    return out.select("clip", "frame_idx", "box.l", "box.t", "box.r", "box.b", "usable")


@query(
    "tiled_score",
    f"""SELECT clip, count(*)::BIGINT AS n_tiles, round(avg(1.0 / (1.0 + exp(-(z / 0.7)))), 6) AS score FROM (
          SELECT clip, frame_idx // 6 AS tile, count(*) AS n, bool_or(valid) AS any_valid, avg(CASE WHEN valid THEN {LOGIT} END) AS z
          FROM frames_more GROUP BY 1, 2) WHERE (n = 6 OR tile = 0) AND any_valid GROUP BY clip""",
)
def tiled_score(t):
    out = SC.tiled_score(t.frames_more, "clip", "frame_idx", "valid", logit(), 6, 0.7)
    return out.select("clip", "n_tiles", rounded("score").alias("score"))


@query(
    "clip_score",
    f"SELECT clip, round(coalesce(avg(CASE WHEN valid THEN 1.0 / (1.0 + exp(-({LOGIT}))) END), 0.5), 6) AS score FROM frames_more GROUP BY clip",
)
def clip_score(t):
    return SC.clip_mean(t.frames_more, ["clip"], sigmoid(logit()), F.col("valid")).select("clip", rounded("score").alias("score"))


SAMPLES = 20


def make_linear():
    """A stand-in model: linear in the features, shifted per stochastic sample."""
    w = np.array(WEIGHTS)
    shift = np.arange(SAMPLES) * 0.01

    def predict(features: np.ndarray) -> np.ndarray:
        return (features.astype(np.float64) @ w)[:, None] + shift

    return predict


@query(
    "batch_score",
    f"SELECT vec_id, s.sample::INT AS sample, round({LOGIT} + s.sample * 0.01::DOUBLE, 6) + 0.0 AS logit FROM embeddings, range({SAMPLES}) s(sample) WHERE label <> 2",
)
def batch_score(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    out = SC.batch_score(rows, "features", make_linear, shape=[64], ok=F.col("label") != 2)
    return out.select("vec_id", "sample", rounded("logit").alias("logit"))


@query(
    "masked_pool",
    """SELECT clip, d::INT AS dim, coalesce(round(avg(v) FILTER (WHERE valid), 6) + 0.0, 0) AS mean,
              round(sqrt(greatest(coalesce(var_pop(v) FILTER (WHERE valid), 0), 1e-8)), 6) AS std
       FROM (SELECT clip, valid, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS d FROM frames_more) GROUP BY 1, 2""",
)
def masked_pool(t):
    out = Q.masked_pool(t.frames_more, "clip", "embedding", "valid")
    rows = out.select("clip", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "v"))
    return rows.select("clip", "dim", rounded("v.mean").alias("mean"), rounded("v.std").alias("std"))


@query(
    "cmvn",
    "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) + 0.0 AS z FROM series WINDOW w AS (PARTITION BY clip, band)",
)
def cmvn(t):
    return Q.cmvn(t.series, ["clip", "band"], "value").select("event_id", rounded("normalised").alias("z"))


@query(
    "lead_skip",
    """SELECT event_id, CASE WHEN len - cut < 2400000 THEN 0 ELSE value END::DOUBLE AS value FROM (
         SELECT *, CASE WHEN len - 100000 >= 2450000 THEN 100000 ELSE 0 END AS cut FROM (SELECT *, max(t) OVER (PARTITION BY clip) AS len FROM series)) WHERE t >= cut""",
)
def lead_skip(t):
    return Q.lead_skip(t.series, "clip", "t", "value", 100000.0, 2450000.0, 2400000.0).select("event_id", "value")


@query(
    "resample_linear",
    """WITH i AS (SELECT clip, value, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY clip) AS n FROM series),
       g AS (SELECT DISTINCT clip, n, j FROM i, range(16) r(j)),
       x AS (SELECT *, least(greatest((j + 0.5::DOUBLE) * n / 16.0::DOUBLE - 0.5::DOUBLE, 0), n - 1) AS x FROM g)
       SELECT x.clip, x.j::INT AS j, round((1 - (x - floor(x))) * a.value + (x - floor(x)) * b.value, 9) AS value FROM x
       JOIN i a ON a.clip = x.clip AND a.idx = floor(x) JOIN i b ON b.clip = x.clip AND b.idx = least(floor(x) + 1, x.n - 1)""",
)
def resample_linear(t):
    idx = Q.indexed(t.series.select("clip", "t", "value"), "clip", "t", F.floor(F.col("t") / 86400))
    return Q.resample_linear(idx, "clip", "idx", "value", 16).select("clip", "j", rounded("value", 9).alias("value"))


@query(
    "shifted_window",
    f"""SELECT clip, win, round(o0, 4) AS o0, round(o0 + (t1 - t0), 4) AS o1 FROM (
          SELECT *, least(greatest(t0 + (CASE WHEN {unit('shift_sign', "clip || ':' || win")} < 0.5 THEN -1 ELSE 1 END)
                    * (0.4 + (greatest(0.5, dur / 3) - 0.4) * {unit('shift_size', "clip || ':' || win")}), 0), greatest(0, dur - (t1 - t0))) AS o0 FROM spans)""",
)
def shifted_window(t):
    out = Q.shifted_windows(t.spans, "clip", "win")
    return out.select("clip", "win", rounded("o0", 4).alias("o0"), rounded("o1", 4).alias("o1"))


@query(
    "interval_slice",
    """SELECT clip, win, round(t, 6) AS t, round(CASE WHEN n < 5 THEN 0 ELSE (value - m) / (s + 1e-8) END, 6) + 0.0 AS z FROM (
         SELECT *, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s FROM (
           SELECT w.clip, w.win, x.t, x.value FROM (
             SELECT clip, win, t0, t1, pad FROM spans UNION ALL SELECT clip, -1 - win, -t1 - 600, -t0 - 600, 0 FROM spans WHERE win < 2) w
             LEFT JOIN series x ON x.clip = w.clip
             AND x.t >= greatest(0, round_even((w.t0 - w.pad) / 64, 0) * 64) AND x.t < round_even((w.t1 + w.pad) / 64, 0) * 64)
         WINDOW p AS (PARTITION BY clip, win))""",
)
def interval_slice(t):
    spans = t.spans.select("clip", "win", "t0", "t1", "pad")
    before = spans.filter("win < 2").selectExpr("clip", "-1 - win AS win", "-t1 - 600 AS t0", "-t0 - 600 AS t1", "pad * 0 AS pad")
    out = V.window_slices(spans.unionByName(before), t.series, "clip", "win", "t", "value", 1 / 64, 7200.0)
    return out.select("clip", "win", rounded("t").alias("t"), rounded("z").alias("z"))


@query(
    "band_slices",
    """WITH b AS (SELECT c.clip, c.win, greatest(0, round_even(c.t0 * 25, 0))::INT AS i, least(s.t, round_even(c.t1 * 25, 0))::INT AS e
                  FROM cuts c JOIN (SELECT clip, max(frame_idx) + 1 AS t FROM frames_more GROUP BY clip) s ON s.clip = c.clip),
       x AS (SELECT clip, win, i, e - i AS n, j, least(greatest((j + 0.5::DOUBLE) * (e - i) / 8.0::DOUBLE - 0.5::DOUBLE, 0), e - i - 1) AS x FROM b, range(8) r(j)),
       v AS (SELECT x.clip, x.win, x.j, unnest(list_transform(list_zip(p.embedding, q.embedding), lambda z: (1 - (x - floor(x))) * z[1]::DOUBLE + (x - floor(x)) * z[2]::DOUBLE)) AS v,
                    unnest(range(64)) AS band
             FROM x JOIN frames_more p ON p.clip = x.clip AND p.frame_idx = i + floor(x)
                    JOIN frames_more q ON q.clip = x.clip AND q.frame_idx = i + least(floor(x) + 1, n - 1) WHERE n >= 5)
       SELECT clip, win, j::INT AS j, band::INT AS band, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8), 6) + 0.0 AS z FROM v WINDOW w AS (PARTITION BY clip, win)
       UNION ALL SELECT clip, win, j::INT, d::INT, 0 FROM x, range(64) y(d) WHERE n < 5""",
)
def band_slices(t):
    out = V.band_slices(t.cuts, t.frames_more, "clip", "win", "frame_idx", "embedding", 25.0, 8)
    rows = out.select("clip", "win", "j", F.posexplode("z").alias("band", "z"))
    return rows.select("clip", "win", "j", "band", rounded("z").alias("z"))


LAG = """SELECT c.clip, c.k, coalesce(n, 0)::BIGINT AS n, coalesce(sim, 0) AS sim
         FROM (SELECT DISTINCT clip, k::INT AS k FROM frames_more, range(-8, 9) r(k)) c LEFT JOIN (
           SELECT a.clip, (b.frame_idx + {shift} - a.frame_idx)::INT AS k, count(*)::BIGINT AS n,
                  avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS sim
           FROM frames_more a JOIN frames_more b ON b.clip = a.clip AND abs(b.frame_idx + {shift} - a.frame_idx) <= 8
           WHERE a.valid GROUP BY 1, 2) m ON m.clip = c.clip AND m.k = c.k"""


def _lag(t, shift: int):
    raw = F.col("embedding").cast("array<double>")
    unit_rows = t.frames_more.select("clip", "frame_idx", "valid", raw.alias("_v")).withColumn("_n", norm("_v"))
    rows = unit_rows.select("clip", "frame_idx", "valid", F.transform("_v", lambda x: x / F.col("_n")).alias("vec"))
    other = rows.withColumn("frame_idx", F.col("frame_idx") + shift)
    return V.lag_profile(rows, other, "clip", "frame_idx", "vec", "valid", 8)


@query("lag_profile", f"SELECT clip, k, n, round(sim, 6) + 0.0 AS sim FROM ({LAG.format(shift=0)})")
def lag_profile(t):
    return _lag(t, 0).select("clip", "k", "n", rounded("sim").alias("sim"))


KINDS = f"SELECT 'matched' AS kind, * FROM ({LAG.format(shift=0)}) UNION ALL SELECT 'shifted', * FROM ({LAG.format(shift=2)})"


def _kinds(t):
    return _lag(t, 0).withColumn("kind", F.lit("matched")).unionByName(_lag(t, 2).withColumn("kind", F.lit("shifted")))


@query(
    "lag_top1",
    f"SELECT kind, count(*)::BIGINT AS n_clips, round(avg((k = 0)::INT), 6) AS top1 FROM (SELECT kind, clip, arg_max(k, (sim, -k)) AS k FROM ({KINDS}) GROUP BY 1, 2) GROUP BY kind",
)
def lag_top1(t):
    return V.lag_summary(_kinds(t), "clip", "kind").withColumn("top1", rounded("top1"))


@query("lag_curve", f"SELECT kind, k, round(avg(sim), 6) + 0.0 AS mean_sim FROM ({KINDS}) GROUP BY 1, 2")
def lag_curve(t):
    return V.lag_curve(_kinds(t), "kind").select("kind", "k", rounded("mean_sim").alias("mean_sim"))
