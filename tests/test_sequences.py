import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import experiments as E
from corpuslens.operators import intervals as V
from corpuslens.operators import scoring as SC
from corpuslens.operators import sequences as Q


def test_forward_fill_crosses_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 4)
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"clip": np.repeat([0, 1, 2], 40), "f": np.tile(np.arange(40), 3)})
    pdf["v"] = np.where(rng.rand(120) < 0.15, pdf.f.astype(float), np.nan)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = Q.forward_fill(df, "clip", "f", "v", "o").toPandas().sort_values(["clip", "f"])
    want = pdf.groupby("clip").v.ffill()
    assert got.o.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_a_small_detected_box_does_not_reuse_or_replace_the_last(spark):
    big, tiny = (100.0, 100.0, 200.0, 200.0), (10.0, 10.0, 12.0, 12.0)
    rows = [(0, False, None), (1, True, big), (2, True, tiny), (3, False, None)]
    data = [("c", f, d, *(b or (None,) * 4), 640, 360) for f, d, b in rows]
    df = spark.createDataFrame(data, "clip string, f int, det boolean, x1 double, y1 double, x2 double, y2 double, w int, h int")
    got = {r.f: (r.usable, r.box.l) for r in Q.tracked_boxes(df, "clip", "f", "det", 0.0).collect()}
    assert got == {0: (0, 140), 1: (1, 100), 2: (0, 140), 3: (1, 100)}


def test_masked_pool_ignores_masked_frames(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(10, 4)
    rows = [("a", i, x[i].tolist() if i < 6 else [1e6] * 4, i < 6) for i in range(10)] + [("one", 0, [1.0, 2.0, 3.0, 4.0], True)]
    got = {r.clip: r for r in Q.masked_pool(spark.createDataFrame(rows, "clip string, f int, v array<double>, ok boolean"), "clip", "v", "ok").collect()}
    assert np.allclose(got["a"]["mean"], x[:6].mean(0)) and np.allclose(got["a"]["std"], x[:6].std(0))
    assert np.allclose(got["one"]["std"], 1e-4)


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


@pytest.mark.parametrize("shift", [0, 2])
def test_lag_profile_peaks_at_the_true_offset(spark, shift):
    rng = np.random.RandomState(1)
    a = [(c, t, v.tolist(), True) for c in range(3) for t, v in enumerate(unit(rng.randn(30, 16)))]
    df = spark.createDataFrame(a, "clip int, t int, v array<double>, ok boolean")
    prof = V.lag_profile(df, df.withColumn("t", F.col("t") + shift), "clip", "t", "v", "ok", 3)
    best = prof.groupBy("clip").agg(F.max_by("k", "sim").alias("k"), F.max("sim").alias("s"), F.count("*").alias("n")).collect()
    assert [r.k for r in best] == [shift] * 3 and all(r.s == pytest.approx(1) and r.n == 7 for r in best)


def test_interval_join_equals_brute_force(spark):
    rng = np.random.RandomState(2)
    w = pd.DataFrame({"clip": rng.randint(0, 3, 60), "win": range(60), "lo": rng.rand(60) * 90})
    w["hi"] = w.lo + rng.rand(60) * 25
    s = pd.DataFrame({"clip": rng.randint(0, 3, 400), "t": rng.rand(400) * 100})
    got = V.interval_join(spark.createDataFrame(w), spark.createDataFrame(s), "clip", F.col("lo"), F.col("hi"), "t", 10.0)
    got = {(r.win, r.t) for r in got.collect()}
    both = w.merge(s, on="clip")
    both = both[(both.t >= both.lo) & (both.t < both.hi)]
    assert got == set(zip(both.win, both.t))


def test_short_slices_read_zero(spark):
    w = spark.createDataFrame([("a", 0, 0.0, 1.0, 0.0), ("a", 1, 1.0, 2.0, 0.0)], "clip string, win int, t0 double, t1 double, pad double")
    s = spark.createDataFrame([("a", i / 10, float(i)) for i in range(13)], "clip string, t double, value double")
    got = V.window_slices(w, s, "clip", "win", "t", "value", 10.0, 1.0).toPandas()
    assert len(got[got.win == 0]) == 10 and got[got.win == 0].z.std(ddof=0) == pytest.approx(1)
    assert (got[got.win == 1].z == 0).all()


def test_overlap_counts_equal_brute_force(spark):
    rng = np.random.RandomState(3)
    lo = rng.rand(80).round(2)
    hi = lo + rng.rand(80).round(2) * 0.2
    df = spark.createDataFrame(pd.DataFrame({"k": range(80), "lo": lo, "hi": hi}))
    got = {r.k: r.n_overlaps for r in V.interval_overlaps(df, "k", "lo", "hi").collect()}
    for i in range(80):
        assert got[i] == sum((lo[j] <= hi[i]) and (lo[i] <= hi[j]) for j in range(80)) - 1


def test_tiles_drop_tails_pad_short_clips_and_skip_blind_ones(spark):
    rows = [("long", f, True, 0.0) for f in range(8)] + [("short", f, f == 0, 1.0) for f in range(2)] + [("blind", f, False, 0.0) for f in range(6)]
    df = spark.createDataFrame(rows, "clip string, f int, ok boolean, z double")
    got = {r.clip: (r.n_tiles, r.score) for r in SC.tiled_score(df, "clip", "f", "ok", F.col("z"), 3).collect()}
    assert got == {"long": (2, 0.5), "short": (1, pytest.approx(1 / (1 + np.exp(-1))))}


def test_linear_resampling_uses_half_pixel_centres(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 10, 20, 30])], "clip string, idx int, value double")
    got = [r.value for r in Q.resample_linear(df, "clip", "idx", "value", 8).orderBy("j").collect()]
    assert got == [0.0, 2.5, 7.5, 12.5, 17.5, 22.5, 27.5, 30.0]


STOPS = [  # epochs since the best, patience, phase, seconds so far, budget in seconds
    (0, 3, 1, 5.0, 60.0, None), (2, 3, 1, 5.0, None, None), (3, 3, 1, 5.0, None, "patience"), (8, 3, 1, 59.0, 60.0, "patience"),
    (3, 3, 0, 5.0, None, None), (40, 3, 0, 59.5, 60.0, None), (1, 3, 1, 61.0, 60.0, "time_budget"), (1, 3, 0, 60.5, 60.0, "time_budget"),
    (1, 3, 1, 1e12, None, None),
]


@pytest.mark.parametrize("case", STOPS)
def test_stop_rule(spark, case):
    since, patience, phase, elapsed, budget, want = case
    col = E.stop_reason(F.lit(since), F.lit(phase), F.lit(elapsed), patience, budget)
    assert spark.range(1).select(col.alias("r")).first().r == want


def test_running_best_ignores_nan_and_equal_values(spark):
    log = [("r", e, m) for e, m in enumerate([float("nan"), 0.5, 0.5, 0.7, float("nan"), 0.6])]
    got = E.running_best(spark.createDataFrame(log, "run string, epoch int, metric double")).orderBy("epoch").collect()
    assert [r.improved for r in got] == [0, 1, 0, 1, 0, 0]
    assert [r.since_best for r in got] == [1, 0, 1, 0, 1, 2]


def test_gates_fail_when_missing_or_nan(spark):
    gates = spark.createDataFrame([(d, 0.7, 0.6) for d in "abcd"], "dataset string, gate double, baseline double")
    res = spark.createDataFrame([("a", 0.8), ("b", 0.4), ("c", float("nan"))], "dataset string, auc double")
    got = {r.dataset: (r.passed, r.verdict) for r in E.gate_check(gates, res).collect()}
    assert got == {"a": (1, "OK"), "b": (0, "FAIL-INVERTED"), "c": (0, "FAIL"), "d": (0, "SKIP")}
    assert E.all_passed(E.gate_check(gates, res)).first().all_passed == 0


def plain_slice(frames, t0, t1, rate, n_out):
    low, high = max(0, int(np.round(t0 * rate))), min(len(frames), int(np.round(t1 * rate)))
    cut = frames[low:high] if high > low else frames[:0]
    if len(cut) < 5:
        return np.zeros((n_out, frames.shape[1]))
    at = np.clip((np.arange(n_out) + 0.5) * len(cut) / n_out - 0.5, 0, len(cut) - 1)
    a = np.floor(at).astype(int)
    mixed = cut[a] + (at - a)[:, None] * (cut[np.minimum(a + 1, len(cut) - 1)] - cut[a])
    return (mixed - mixed.mean()) / (mixed.std() + 1e-8)


def test_band_slices_equal_slice_resample_and_scaling_one_by_one(spark):
    rng = np.random.default_rng(4)
    clips = {"long": rng.normal(size=(90, 3)) + 4, "flat": np.ones((30, 3)), "tiny": rng.normal(size=(4, 3))}
    spans = [(0.0, 2.0), (-1.0, 0.35), (1.1, 1.4), (2.9, 9.0), (3.5, 3.6), (50.0, 60.0), (2.0, 1.0)]
    frames = spark.createDataFrame([(c, i, v.tolist()) for c, x in clips.items() for i, v in enumerate(x)], "clip string, k int, v array<double>")
    windows = spark.createDataFrame([(c, w, *s) for c in [*clips, "missing"] for w, s in enumerate(spans)], "clip string, win int, t0 double, t1 double")
    got = {(r.clip, r.win, r.j): r.z for r in V.band_slices(windows, frames, "clip", "win", "k", "v", 25.0, 7).collect()}
    assert len(got) == 4 * len(spans) * 7
    for c in [*clips, "missing"]:
        for w, (t0, t1) in enumerate(spans):
            want = plain_slice(clips.get(c, np.zeros((0, 3))), t0, t1, 25.0, 7)
            assert np.abs(np.array([got[c, w, j] for j in range(7)]) - want).max() < 1e-6
