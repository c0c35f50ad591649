"""Seeded sampling, pairing and batch plans."""

from pyspark.sql import functions as F

from corpuslens.operators import pairing as PR
from corpuslens.operators import sampling as S
from corpuslens.plans.catalog import query


def ranked(src: str, tag: str, key: str = "id", by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, row_number() OVER ({part} ORDER BY md5('{tag}:42:' || {key}), {key}) AS r, count(*) OVER ({part}) AS n FROM {src})"


def unit(tag: str, key: str) -> str:
    return f"('0x' || substr(md5('{tag}:42:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("seeded_shuffle", f"SELECT id, r AS position FROM {ranked('scored', 'shuffle')}")
def seeded_shuffle(t):
    return S.seeded_shuffle(t.scored.select("id"), ["id"], "shuffle")


@query("seeded_topn", "SELECT doc_id, path FROM doc_paths ORDER BY md5('eval:42:' || doc_id), doc_id LIMIT 400")
def seeded_topn(t):
    return S.seeded_top(t.doc_paths.select("doc_id", "path"), ["doc_id"], 400, "eval")


@query(
    "category_cap",
    f"""SELECT id, category FROM {ranked('modality', 'category', 'id', 'category')}
        WHERE r <= CASE category WHEN 'FakeVideo-RealAudio' THEN 700 WHEN 'FakeVideo-FakeAudio' THEN 900 ELSE n END""",
)
def category_cap(t):
    caps = {"FakeVideo-RealAudio": 700, "FakeVideo-FakeAudio": 900}
    return S.category_cap(t.modality.select("id", "category"), ["id"], "category", caps, "category")


@query("class_quota", f"SELECT id, y FROM {ranked('(SELECT * FROM scored WHERE score > 5)', 'quota', 'id', 'y')} WHERE r <= 60")
def class_quota(t):
    return S.class_quota(t.scored.select("id", "y", "score"), ["id"], "y", 60, F.col("score") > 5, "quota").select("id", "y")


@query("exact_fraction", f"SELECT id FROM {ranked('scored', 'fraction')} WHERE r <= round_even(n * 0.35, 0)")
def exact_fraction(t):
    return S.exact_fraction(t.scored.select("id"), ["id"], 0.35, "fraction")


@query(
    "k_per_group",
    f"SELECT clip, frame_idx, vec_id FROM {ranked('(SELECT * FROM frames WHERE valid)', 'frames', 'vec_id', 'clip')} WHERE n >= 16 AND r <= 16",
)
def k_per_group(t):
    rows = t.frames.select("clip", "frame_idx", "vec_id", "valid")
    return S.k_per_group(rows, ["vec_id"], ["clip"], 16, F.col("valid"), "frames").select("clip", "frame_idx", "vec_id")


@query(
    "middle_frame",
    "SELECT clip, frame_idx FROM (SELECT clip, frame_idx, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS r, count(*) OVER (PARTITION BY clip) AS n FROM frames WHERE valid) WHERE r = n // 2 + 1",
)
def middle_frame(t):
    rows = t.frames.filter("valid").select("clip", "frame_idx")
    return S.middle_of_group(rows, ["clip"], "frame_idx", F.floor(F.col("frame_idx") / 4096))


@query(
    "bernoulli_relabel",
    f"""SELECT id, (video_label = 0 AND has_audio = 1 AND u < 0.25)::INT AS relabelled,
               CASE WHEN video_label = 0 AND has_audio = 1 AND u < 0.25 THEN 1 ELSE video_label END AS video_label
        FROM (SELECT *, {unit('relabel', 'id')} AS u FROM modality)""",
)
def bernoulli_relabel(t):
    rows = t.modality.select("id", "video_label", "has_audio")
    return S.bernoulli_relabel(rows, ["id"], "video_label", 0.25, F.col("has_audio") == 1).drop("has_audio")


@query(
    "frame_dropout",
    f"""SELECT clip, frame_idx, ((valid AND NOT (d AND left_over)) OR (NOT any_valid AND frame_idx = first))::INT AS valid FROM (
          SELECT *, bool_or(valid AND NOT d) OVER (PARTITION BY clip) AS left_over, bool_or(valid) OVER (PARTITION BY clip) AS any_valid,
                 min(frame_idx) OVER (PARTITION BY clip) AS first
          FROM (SELECT clip, frame_idx, valid, valid AND {unit('drop', "clip || ':' || frame_idx")} < 0.1 AS d
                FROM (SELECT clip, frame_idx, valid AND clip % 6 <> 0 AS valid FROM frames)))""",
)
def frame_dropout(t):
    rows = t.frames.select("clip", "frame_idx", (F.col("valid") & (F.col("clip") % 6 != 0)).alias("valid"))
    return S.frame_dropout(rows, "clip", "frame_idx", "valid").withColumn("valid", F.col("valid").cast("int"))


PAIRS = """SELECT r.real_key, f.key AS fake_key FROM (SELECT * FROM pairs WHERE label = 1) f
             LEFT JOIN (SELECT target_id, max(key) AS real_key FROM pairs WHERE label = 0 GROUP BY 1) r USING (target_id)
           UNION ALL SELECT key, NULL FROM pairs WHERE label = 0 AND key NOT IN (
             SELECT max(key) FROM pairs WHERE label = 0 AND target_id IN (SELECT target_id FROM pairs WHERE label = 1) GROUP BY target_id)"""


@query("pair_by_target", PAIRS)
def pair_by_target(t):
    return PR.pair_by_target(t.pairs, "key")


ZIP = """SELECT identity_group, k, r.key AS real_key, f.key AS fake_key
         FROM (SELECT identity_group, key, row_number() OVER (PARTITION BY identity_group ORDER BY md5('zip:42:' || key), key) AS k FROM pairs WHERE label = 0) r
         FULL JOIN (SELECT identity_group, key, row_number() OVER (PARTITION BY identity_group ORDER BY md5('zip:42:' || key), key) AS k FROM pairs WHERE label = 1) f
         USING (identity_group, k)"""


@query("pair_rank_zip", ZIP)
def pair_rank_zip(t):
    return PR.pair_by_rank(t.pairs, "key", label="label")


BATCH_PLAN = f"""
    WITH z AS (SELECT coalesce(real_key, '') AS a, coalesce(fake_key, '') AS b, (real_key IS NOT NULL AND fake_key IS NOT NULL)::INT AS pair FROM ({ZIP})),
    s AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY md5('epoch3:42:' || a || ':' || b), a, b) AS r, sum(pair) OVER () AS np, sum(pair + 1) OVER () AS n FROM z),
    f AS (SELECT a AS key, 2 * (r - 1) AS pos, n FROM s WHERE pair = 1 UNION ALL SELECT b, 2 * (r - 1) + 1, n FROM s WHERE pair = 1
          UNION ALL SELECT greatest(a, b), 2 * np + r - 1, n FROM s WHERE pair = 0),
    raw AS (SELECT key, (pos // 32)::BIGINT AS rb, (pos % 32)::INT AS slot, (n // 32)::BIGINT AS nb FROM f),
    mv AS (SELECT rb, row_number() OVER (ORDER BY md5('batches3:42:' || rb), rb) - 1 AS to_b FROM (SELECT DISTINCT rb FROM raw WHERE rb < nb))
    SELECT coalesce(to_b, rb)::BIGINT AS batch, slot, key FROM raw LEFT JOIN mv USING (rb)"""


def _batch_plan(t, carry=()):
    return PR.batch_plan(PR.pair_by_rank(t.pairs, "key", label="label", carry=carry), 32, epoch=3, drop_last=False)


@query("batch_plan", BATCH_PLAN)
def batch_plan(t):
    return _batch_plan(t)


NEG = """WITH p AS (SELECT key, identity_group, has_audio, r - 1 AS pos, n FROM {r}),
         b AS (SELECT *, pos // 64 AS bt, pos % 64 AS sl, least(64, n - (pos // 64) * 64) AS sz FROM p)
         SELECT x.key, CASE WHEN y.identity_group <> x.identity_group AND y.has_audio = 1 THEN y.key ELSE x.key END AS negative_key,
                CASE WHEN y.identity_group <> x.identity_group AND y.has_audio = 1 THEN 'cross_identity' ELSE 'same_clip_shift' END AS source
         FROM b x JOIN b y ON y.bt = x.bt AND y.sl = (x.sl + 1) % x.sz""".format(r=ranked("pairs", "negatives", "key"))


@query("negative_assignment", NEG)
def negative_assignment(t):
    return PR.negative_partners(t.pairs, "key", "identity_group", "has_audio", 64)


@query(
    "batch_negatives",
    f"""
    WITH p AS ({BATCH_PLAN}), n AS (SELECT batch, count(*) AS size FROM p GROUP BY batch),
    i AS (SELECT p.*, q.identity_group AS g, q.has_audio AS a, size,
                 CASE WHEN size > 1 THEN 1 + ('0x' || substr(md5('turn:42:' || p.batch), 1, 8))::BIGINT % greatest(size - 1, 1) ELSE 0 END AS turn
          FROM p JOIN pairs q USING (key) JOIN n USING (batch))
    SELECT x.batch, x.slot, x.key, CASE WHEN y.g <> x.g AND y.a = 1 THEN y.key ELSE x.key END AS negative_key,
           CASE WHEN y.g <> x.g AND y.a = 1 THEN 'cross_identity' ELSE 'same_clip_shift' END AS source
    FROM i x JOIN i y ON y.batch = x.batch AND y.slot = (x.slot + x.turn) % x.size""",
)
def batch_negatives(t):
    plan = _batch_plan(t, carry=["identity_group", "has_audio"])
    return PR.batch_negatives(plan, t.pairs, "key", "identity_group", "has_audio")


@query("negative_sources", f"SELECT source, count(*)::BIGINT AS n FROM ({NEG}) GROUP BY source")
def negative_sources(t):
    return PR.negative_sources(PR.negative_partners(t.pairs, "key", "identity_group", "has_audio", 64))


@query("group_codes", "SELECT identity_group, row_number() OVER (ORDER BY identity_group) - 1 AS code FROM (SELECT DISTINCT identity_group FROM pairs)")
def group_codes(t):
    return PR.group_codes(t.pairs, "identity_group")
