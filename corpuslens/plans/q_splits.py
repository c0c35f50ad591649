"""Group-disjoint splits and their checks."""

from pyspark.sql import functions as F

from corpuslens.functions.numeric import rounded
from corpuslens.operators import splits as S
from corpuslens.plans.catalog import query


def assign_sql(src: str, group: str = "identity_group", seed: int = 42, fracs=(0.6, 0.2, 0.2)) -> str:
    """(group, n, split): cumulative midpoints in seeded order, big groups first."""
    a, b = fracs[0], fracs[0] + fracs[1]
    return f"""
      SELECT {group}, n, CASE WHEN mid < {a!r} THEN 'train' WHEN mid < {b!r} THEN 'val' ELSE 'test' END AS split FROM (
        SELECT {group}, n, (coalesce(sum(n) OVER (ORDER BY big DESC, h, {group} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE)
               / sum(n) OVER () AS mid
        FROM (SELECT {group}, n, md5('split:{seed}:' || {group}) AS h, (n > sum(n) OVER () * {min(fracs) / 2!r}::DOUBLE)::INT AS big
              FROM (SELECT {group}, count(*) AS n FROM {src} GROUP BY 1)))"""


# A clip table with groups of very different sizes; ``train_only`` rows have their own groups.
CLIPS = """SELECT id, category, video_label, audio_label, has_audio,
                  CASE WHEN has_audio = 0 THEN 'aux::' ELSE 'main::' END || 'g' || substr(md5(split_part(id, ':', 1)), 1, 2) AS identity_group,
                  (has_audio = 0)::INT AS train_only FROM modality"""


def _clips(t):
    g = F.concat(
        F.when(F.col("has_audio") == 0, "aux::").otherwise("main::"),
        F.lit("g"),
        F.substring(F.md5(F.substring_index("id", ":", 1)), 1, 2),
    )
    return t.modality.withColumn("identity_group", g).withColumn("train_only", (F.col("has_audio") == 0).cast("int"))


@query("group_split", f"WITH c AS ({CLIPS}), a AS ({assign_sql('c')}) SELECT c.id, c.identity_group, a.split FROM c JOIN a USING (identity_group)")
def group_split(t):
    return S.group_split(_clips(t)).select("id", "identity_group", "split")


# Half of the rows in up to 256 heavy groups, the others in a light group per target.
MIXED = """SELECT key, CASE WHEN label = 1 THEN 's' || substr(md5(CAST(source_id AS VARCHAR)), 1, 2) ELSE 't' || target_id END AS identity_group
           FROM pairs"""


def pack_sql(src: str, seed: int = 42) -> str:
    """(identity_group, n, split): heavy groups one after another to the largest deficit, light ones by midpoint."""
    return f"""
      WITH RECURSIVE sizes AS (SELECT identity_group, n, sum(n) OVER ()::BIGINT AS total, md5('split:{seed}:' || identity_group) AS h
                               FROM (SELECT identity_group, count(*) AS n FROM ({src}) GROUP BY 1)),
      heavy AS (SELECT *, row_number() OVER (ORDER BY h, identity_group) AS i FROM sizes WHERE n * 1000 > total),
      walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0 AS k
               UNION ALL
               SELECT i, a + CASE WHEN k = 1 THEN n ELSE 0 END, b + CASE WHEN k = 2 THEN n ELSE 0 END, c + CASE WHEN k = 3 THEN n ELSE 0 END, k
               FROM (SELECT h.i, h.n, a, b, c,
                            CASE WHEN 0.6::DOUBLE * total - a >= greatest(0.2::DOUBLE * total - b, 0.2::DOUBLE * total - c) THEN 1
                                 WHEN 0.2::DOUBLE * total - b >= 0.2::DOUBLE * total - c THEN 2 ELSE 3 END AS k
                     FROM walk JOIN heavy h ON h.i = walk.i + 1)),
      room AS (SELECT greatest(0.0::DOUBLE, 0.6::DOUBLE * t - a) AS ra, greatest(0.0::DOUBLE, 0.2::DOUBLE * t - b) AS rb, greatest(0.0::DOUBLE, 0.2::DOUBLE * t - c) AS rc
               FROM (SELECT arg_max(a, i) AS a, arg_max(b, i) AS b, arg_max(c, i) AS c FROM walk), (SELECT max(total) AS t FROM sizes)),
      light AS (SELECT identity_group, n, (coalesce(sum(n) OVER (ORDER BY h, identity_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE)
                                          / sum(n) OVER () AS mid FROM sizes WHERE n * 1000 <= total)
      SELECT identity_group, n, CASE k WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM heavy JOIN walk USING (i)
      UNION ALL
      SELECT identity_group, n, CASE WHEN mid * (ra + rb + rc) < ra THEN 'train' WHEN mid * (ra + rb + rc) < ra + rb THEN 'val' ELSE 'test' END FROM light, room"""


@query("group_split_greedy", f"SELECT c.key, c.identity_group, p.split FROM ({MIXED}) c JOIN ({pack_sql(MIXED)}) p USING (identity_group)")
def group_split_greedy(t):
    heavy = F.concat(F.lit("s"), F.substring(F.md5(F.col("source_id").cast("string")), 1, 2))
    group = F.when(F.col("label") == 1, heavy).otherwise(F.concat(F.lit("t"), F.col("target_id").cast("string")))
    rows = t.pairs.select("key", group.alias("identity_group"))
    return S.group_split(rows, greedy=True).select("key", "identity_group", "split")


PINNED = f"""WITH c AS ({CLIPS}), p AS (SELECT * FROM c WHERE train_only = 0), a AS ({assign_sql('p')})
             SELECT c.*, coalesce(a.split, 'train') AS split FROM c LEFT JOIN a USING (identity_group)"""


@query("group_split_pinned", f"SELECT id, train_only, split FROM ({PINNED})")
def group_split_pinned(t):
    return S.group_split(_clips(t), train_only="train_only").select("id", "train_only", "split")


@query(
    "split_summary",
    f"""SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT identity_group)::BIGINT AS n_groups, sum(video_label)::BIGINT AS video_fake,
               sum(audio_label)::BIGINT AS audio_fake, round(avg(video_label), 6) AS frac_fake FROM ({PINNED}) GROUP BY split""",
)
def split_summary(t):
    return S.split_summary(S.group_split(_clips(t), train_only="train_only")).withColumn("frac_fake", rounded("frac_fake"))


ROWS = f"""SELECT *, CASE WHEN r <= floor(0.6 * n) THEN 'train' WHEN r <= floor(0.8 * n) THEN 'val' ELSE 'test' END AS split
           FROM (SELECT *, row_number() OVER (ORDER BY md5('rows:42:' || id), id) AS r, count(*) OVER () AS n FROM ({CLIPS}))"""


@query("row_split", f"SELECT id, split FROM ({ROWS})")
def row_split(t):
    return S.row_split(t.modality.select("id"), ["id"])


@query(
    "split_leaks",
    f"""SELECT identity_group, sum((split = 'train')::INT)::BIGINT AS n_train, sum((split = 'val')::INT)::BIGINT AS n_val, sum((split = 'test')::INT)::BIGINT AS n_test
        FROM ({ROWS}) GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_leaks(t):
    """Leaks of the row-wise control; the group split has none (see the tests)."""
    return S.split_leaks(S.row_split(_clips(t), ["id"]))


IDS = "SELECT DISTINCT CASE substr(md5(CAST(l_partkey AS STRING)), 1, 1) WHEN '0' THEN 'val' WHEN '1' THEN 'test' ELSE 'train' END AS split, l_partkey AS id FROM lineitem WHERE l_partkey % 50 <> 0"


@query(
    "official_split",
    f"""WITH i AS ({IDS}) SELECT p.key, CASE WHEN t.split = 'train' THEN 'train' WHEN t.split IS NOT NULL THEN 'val' END AS split,
               CASE WHEN t.split IS NULL THEN 'unknown_target'
                    WHEN p.source_id IS NOT NULL AND (s.split IS NULL OR (s.split = 'train') <> (t.split = 'train')) THEN 'crosses_splits' END AS violation
        FROM pairs p LEFT JOIN i t ON t.id = p.target_id LEFT JOIN i s ON s.id = p.source_id""",
)
def official_split(t):
    h = F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 1)
    name = F.when(h == "0", "val").when(h == "1", "test").otherwise("train")
    ids = t.lineitem.filter("l_partkey % 50 <> 0").select(name.alias("split"), F.col("l_partkey").alias("id")).distinct()
    return S.official_split(t.pairs, ids).select("key", "split", "violation")


TARGETS = """SELECT p.*, CASE WHEN r <= greatest(1, round_even(n * 0.85, 0)) THEN 'train' ELSE 'val' END AS split FROM pairs p
             JOIN (SELECT target_id, row_number() OVER (ORDER BY md5('targets:42:' || target_id), target_id) AS r, count(*) OVER () AS n
                   FROM (SELECT DISTINCT target_id FROM pairs)) q ON q.target_id = p.target_id"""


@query("target_split", f"SELECT key, target_id, split FROM ({TARGETS})")
def target_split(t):
    return S.target_split(t.pairs).select("key", "target_id", "split")


@query(
    "source_leakage",
    f"""WITH s AS ({TARGETS}) SELECT key FROM s WHERE split = 'val' AND source_id IS NOT NULL AND source_id IN
        (SELECT target_id FROM s WHERE split = 'train' UNION SELECT source_id FROM s WHERE split = 'train' AND source_id IS NOT NULL)""",
)
def source_leakage(t):
    return S.source_leakage(S.target_split(t.pairs)).select("key")


@query(
    "parent_holdout",
    """SELECT f.vec_id, f.clip, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM frames f
       JOIN (SELECT clip, row_number() OVER (ORDER BY md5('holdout:42:' || clip), clip) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT clip FROM frames)) p
       ON p.clip = f.clip""",
)
def parent_holdout(t):
    return S.parent_holdout(t.frames.select("vec_id", "clip"), "clip").select("vec_id", "clip", "split")


MANIFEST = "SELECT split, row_number() OVER (PARTITION BY split ORDER BY md5(key), key) AS position, key FROM (SELECT split, CAST(id AS STRING) AS key FROM split_scored)"


def _manifest(t):
    return S.split_manifest(t.split_scored.select("split", F.col("id").cast("string").alias("key")), "key")


@query("split_manifest", MANIFEST)
def split_manifest(t):
    return _manifest(t)


@query(
    "split_repro",
    f"""WITH a AS ({MANIFEST}), b AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY md5(key), key) AS position, key
          FROM (SELECT split, CAST(id AS STRING) AS key FROM split_scored WHERE id % 1000 <> 7))
        SELECT split, position, a.key AS rebuilt_key, b.key AS saved_key FROM a FULL JOIN b USING (split, position)
        WHERE split IN ('val', 'test') AND a.key IS DISTINCT FROM b.key""",
)
def split_repro(t):
    rows = t.split_scored.filter("id % 1000 <> 7").select("split", F.col("id").cast("string").alias("key"))
    return S.split_difference(_manifest(t), S.split_manifest(rows, "key"))


@query("split_overlap", f"WITH s AS ({TARGETS}) SELECT source_id FROM s WHERE split = 'train' INTERSECT SELECT source_id FROM s WHERE split = 'val'")
def split_overlap(t):
    return S.split_overlap(S.target_split(t.pairs), "source_id", "train", "val")
