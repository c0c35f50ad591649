"""Path parsing, labels, manifests, identities and integrity."""

from pyspark.sql import functions as F

from corpuslens.functions import geometry as G
from corpuslens.functions import paths as P
from corpuslens.functions.numeric import feature_ok, rounded
from corpuslens.operators import identity as ID
from corpuslens.operators import integrity as I
from corpuslens.operators.experiments import class_balance as balance
from corpuslens.operators.sequences import expand_frames, repaired_fps
from corpuslens.plans.catalog import query
from corpuslens.sources import listing as L
from corpuslens.sources import tables as S

CAT = """CASE WHEN lower(path) LIKE '%realvideo-realaudio%' THEN 'RealVideo-RealAudio'
              WHEN lower(path) LIKE '%realvideo-fakeaudio%' THEN 'RealVideo-FakeAudio'
              WHEN lower(path) LIKE '%fakevideo-realaudio%' THEN 'FakeVideo-RealAudio'
              WHEN lower(path) LIKE '%fakevideo-fakeaudio%' THEN 'FakeVideo-FakeAudio' ELSE 'Unknown' END"""
BASE = "string_split(path, '/')[-1]"
DOC_TOKENS = """list_sort(list_distinct(list_concat(
    regexp_extract_all(lower(string_split(path, '/')[-2]), '(id[0-9]+)', 1), regexp_extract_all(lower(string_split(path, '/')[-1]), '(id[0-9]+)', 1))))"""


@query(
    "path_filter",
    "SELECT page_id, url FROM pages WHERE NOT (lower(url) LIKE '%/de/%' OR lower(url) LIKE '%example.org%' OR lower(url) LIKE '%ref=%')",
)
def path_filter(t):
    return L.exclude_tokens(t.pages.select("page_id", "url"), ["/de/", "example.org", "ref="], "url")


@query(
    "path_category",
    f"""SELECT doc_id, category, CASE WHEN category = 'RealVideo-RealAudio' THEN 0 WHEN category <> 'Unknown' THEN 1
               WHEN lower({BASE}) LIKE '%real%' AND lower({BASE}) NOT LIKE '%fake%' THEN 0 ELSE 1 END AS label
        FROM (SELECT doc_id, path, {CAT} AS category FROM doc_paths)""",
)
def path_category(t):
    return t.doc_paths.select("doc_id", P.category("path").alias("category"), P.clip_label("path").alias("label"))


FOLDER = "replace(path, '/in/', CASE doc_id % 4 WHEN 0 THEN '/Celeb-real/' WHEN 1 THEN '/YouTube-real/' WHEN 2 THEN '/Celeb-synthesis/' ELSE '/other/' END)"


@query("labelled_folders", f"SELECT {FOLDER} AS path, (doc_id % 4 = 2)::INT AS label FROM doc_paths WHERE doc_id % 4 < 3")
def labelled_folders(t):
    root = F.when(F.col("doc_id") % 4 == 0, "/Celeb-real/").when(F.col("doc_id") % 4 == 1, "/YouTube-real/")
    root = root.when(F.col("doc_id") % 4 == 2, "/Celeb-synthesis/").otherwise("/other/")
    return L.labelled_folders(t.doc_paths.select(F.replace("path", F.lit("/in/"), root).alias("path")))


@query(
    "modality_labels",
    f"""SELECT category, (lower(category) LIKE '%fakevideo%')::INT AS video_label, (lower(category) LIKE '%fakeaudio%')::INT AS audio_label,
               count(*)::BIGINT AS n FROM (SELECT {CAT} AS category FROM doc_paths) GROUP BY category""",
)
def modality_labels(t):
    cats = t.doc_paths.select(P.category("path").alias("category"))
    cats = cats.select("category", P.video_label("category").alias("video_label"), P.audio_label("category").alias("audio_label"))
    return cats.groupBy("category", "video_label", "audio_label").agg(F.count(F.lit(1)).alias("n"))


@query("any_label", "SELECT id, (video_label = 1 OR audio_label = 1)::INT AS any_label FROM modality")
def any_label(t):
    return t.modality.select("id", P.any_fake("video_label", "audio_label").alias("any_label"))


@query(
    "sample_key",
    f"""SELECT doc_id, (CASE category WHEN 'RealVideo-RealAudio' THEN 'RVRA' WHEN 'RealVideo-FakeAudio' THEN 'RVFA' WHEN 'FakeVideo-RealAudio' THEN 'FVRA'
               WHEN 'FakeVideo-FakeAudio' THEN 'FVFA' ELSE 'UNK' END) || '_' || lang || '_' || string_split({BASE}, '.')[1] || '_' || substr(md5(path), 1, 8) AS key
        FROM (SELECT *, {CAT} AS category FROM doc_paths)""",
)
def sample_key(t):
    return t.doc_paths.select("doc_id", P.sample_key(P.category("path"), "lang", "path").alias("key"))


NAMES = """SELECT doc_id, '/v/' || lang || '.v1/' || (CASE doc_id % 4 WHEN 0 THEN lpad(CAST(doc_id % 1000 AS STRING), 3, '0')
           WHEN 1 THEN lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '_' || lpad(CAST((doc_id * 7) % 1000 AS STRING), 3, '0')
           WHEN 2 THEN 'take.b' || CAST(doc_id % 50 AS STRING) ELSE 'clip' END) || '.mp4' AS path FROM documents"""


def _names(t):
    name = (
        F.when(F.col("doc_id") % 4 == 0, F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
        .when(
            F.col("doc_id") % 4 == 1,
            F.concat_ws("_", F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lpad((F.col("doc_id") * 7 % 1000).cast("string"), 3, "0")),
        )
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("take.b"), (F.col("doc_id") % 50).cast("string")))
        .otherwise("clip")
    )
    return t.documents.select("doc_id", F.concat(F.lit("/v/"), "lang", F.lit(".v1/"), name, F.lit(".mp4")).alias("path"))


STEM = f"regexp_replace({BASE}, '\\.[^.]*$', '')"
RUNS = f"regexp_extract_all({STEM}, '([0-9]+)', 1)"


@query("parse_pair_name", f"SELECT doc_id, coalesce({RUNS}[1], {STEM}) AS target_id, {RUNS}[2] AS source_id FROM ({NAMES})")
def parse_pair_name(t):
    return _names(t).select("doc_id", P.target_id("path").alias("target_id"), P.source_id("path").alias("source_id"))


@query(
    "identity_tokens",
    f"""SELECT 'clip' AS kind, doc_id, array_to_string({DOC_TOKENS}, ',') AS tokens FROM doc_paths
        UNION ALL SELECT 'pair', doc_id, array_to_string(list_sort(list_distinct(list_filter(
          ['ff::' || coalesce({RUNS}[1], {STEM}), 'ff::' || {RUNS}[2]], lambda x: x IS NOT NULL))), ',') FROM ({NAMES})""",
)
def identity_tokens(t):
    a = t.doc_paths.select(F.lit("clip").alias("kind"), "doc_id", F.array_join(P.identity_tokens("path"), ",").alias("tokens"))
    b = _names(t).select(F.lit("pair").alias("kind"), "doc_id", F.array_join(P.pair_tokens("path"), ",").alias("tokens"))
    return a.unionByName(b)


def components_sql(clips: str, key: str) -> str:
    """Component label per clip of (key, tokens) by reachability."""
    return f"""
      WITH RECURSIVE c AS ({clips}), star AS (SELECT tokens[1] AS a, unnest(tokens) AS b FROM c),
      e AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
      reach(token, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.token),
      lab AS (SELECT token, min(label) AS label FROM reach GROUP BY token)
      SELECT c.{key}, lab.label AS identity_group FROM c JOIN lab ON lab.token = c.tokens[1]"""


DOC_GROUPS = components_sql(f"SELECT doc_id, {DOC_TOKENS} AS tokens FROM doc_paths", "doc_id")
PAGE_GROUPS = components_sql(
    "SELECT page_id, list_sort(list_distinct(list_concat([host], list_transform(numbers, lambda n: 'n' || n)))) AS tokens FROM page_names", "page_id"
)


def doc_groups(t):
    return ID.identity_groups(t.doc_paths.withColumn("tokens", P.identity_tokens("path")))


@query("identity_groups", DOC_GROUPS)
def identity_groups(t):
    return doc_groups(t).select("doc_id", "identity_group")


@query("identity_groups_pages", PAGE_GROUPS)
def identity_groups_pages(t):
    numbers = F.transform("numbers", lambda n: F.concat(F.lit("n"), n))
    clips = t.page_names.select("page_id", F.array_sort(F.array_union(F.array("host"), numbers)).alias("tokens"))
    return ID.identity_groups(clips).select("page_id", "identity_group")


PAIR_GROUPS = components_sql(
    f"""SELECT doc_id, list_sort(list_distinct(list_filter(['ff::' || coalesce({RUNS}[1], {STEM}), 'ff::' || {RUNS}[2]], lambda x: x IS NOT NULL))) AS tokens
        FROM ({NAMES})""",
    "doc_id",
)


@query("identity_groups_pairs", PAIR_GROUPS)
def identity_groups_pairs(t):
    return ID.identity_groups(_names(t).select("doc_id", P.pair_tokens("path").alias("tokens"))).select("doc_id", "identity_group")


JOBS = f"""WITH g AS ({DOC_GROUPS}), j AS (
             SELECT d.doc_id, d.path, g.identity_group, {CAT} AS category, {BASE} AS base FROM doc_paths d JOIN g USING (doc_id)),
           k AS (SELECT *, CASE WHEN category = 'RealVideo-RealAudio' THEN 0 WHEN category <> 'Unknown' THEN 1 WHEN lower(base) LIKE '%real%' THEN 0 ELSE 1 END AS y FROM j),
           r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('category_sample:42:' || path), path) AS r FROM k WHERE y = 1)
           SELECT path, category, identity_group FROM k WHERE y = 0
           UNION ALL SELECT path, category, identity_group FROM r WHERE r <= CASE category WHEN 'FakeVideo-RealAudio' THEN 40 WHEN 'FakeVideo-FakeAudio' THEN 60 ELSE 1000000000 END"""


@query(
    "primary_jobs",
    f"""SELECT (CASE category WHEN 'RealVideo-RealAudio' THEN 'RVRA' WHEN 'RealVideo-FakeAudio' THEN 'RVFA' WHEN 'FakeVideo-RealAudio' THEN 'FVRA'
               WHEN 'FakeVideo-FakeAudio' THEN 'FVFA' ELSE 'UNK' END) || '_' || identity_group || '_' || string_split({BASE}, '.')[1] || '_' || substr(md5(path), 1, 8) AS key,
               category, identity_group, (lower(category) LIKE '%fakevideo%')::INT AS video_label, (lower(category) LIKE '%fakeaudio%')::INT AS audio_label
        FROM ({JOBS})""",
)
def primary_jobs(t):
    from corpuslens.operators.manifests import primary_jobs as jobs

    out = jobs(t.doc_paths, {"FakeVideo-RealAudio": 40, "FakeVideo-FakeAudio": 60}, exclude=["other-corpus"])
    return out.select("key", "category", "identity_group", "video_label", "audio_label")


@query(
    "component_stats",
    f"""SELECT count(*)::BIGINT AS n_groups, sum(n)::BIGINT AS n_rows, max(n)::BIGINT AS largest, round(max(n)::DOUBLE / sum(n), 6) AS largest_share
        FROM (SELECT identity_group, count(*) AS n FROM ({DOC_GROUPS}) GROUP BY 1)""",
)
def component_stats(t):
    return ID.component_stats(doc_groups(t)).withColumn("largest_share", rounded("largest_share"))


PRIMARY = f"""SELECT CAST(doc_id AS STRING) AS key, path, {CAT} AS category, 'g' || CAST(doc_id % 200 AS STRING) AS identity_group FROM doc_paths"""


@query(
    "merge_manifests",
    f"""SELECT key, category, 'fav::' || identity_group AS identity_group, '/a' AS crop_dir, (lower(category) LIKE '%fakevideo%')::INT AS video_label,
               (lower(category) LIKE '%fakeaudio%')::INT AS audio_label, 1 AS has_audio, 'primary' AS corpus, NULL::INT AS train_only, 30.0::DOUBLE AS fps
        FROM ({PRIMARY})
        UNION ALL
        SELECT key, 'FFPP-m' || CAST(target_id % 4 AS STRING), 'ffpp::' || identity_group, '/b', label, 0, 0, 'auxiliary', 1, 25.0::DOUBLE
        FROM (SELECT *, row_number() OVER (ORDER BY md5('mixture:42:' || key), key) AS r, count(*) OVER () AS n FROM pairs) WHERE r <= round_even(n * 0.3, 0)""",
)
def merge_manifests(t):
    cat = P.category("path")
    primary = t.doc_paths.select(
        F.col("doc_id").cast("string").alias("key"),
        "path",
        cat.alias("category"),
        F.concat(F.lit("g"), (F.col("doc_id") % 200).cast("string")).alias("identity_group"),
        P.video_label(cat).alias("video_label"),
        P.audio_label(cat).alias("audio_label"),
        F.lit(16).alias("n_valid_faces"),
        F.lit(30.0).alias("fps"),
    )
    aux = t.pairs.withColumn("method", F.concat(F.lit("m"), (F.col("target_id") % 4).cast("string"))).withColumn("path", F.col("key"))
    out = I.merge_manifests(primary, aux, "/a", "/b", 0.3)
    return out.select("key", "category", "identity_group", "crop_dir", "video_label", "audio_label", "has_audio", "corpus", "train_only", "fps")


@query(
    "status_rules",
    """SELECT status, (status IN ('ok', 'cached'))::INT AS usable, count(*)::BIGINT AS n FROM (
         SELECT CASE WHEN event_id % 10 = 0 THEN 'cached' WHEN event_type = 'signup' THEN 'visual_error' WHEN user_id % 5 = 0 THEN 'no_faces'
                     WHEN event_type = 'view' AND value > 100 THEN 'audio_error' WHEN value * 100 < 1600 THEN 'audio_too_short' ELSE 'ok' END AS status
         FROM events) GROUP BY status""",
)
def status_rules(t):
    status = I.extraction_status(
        F.col("event_id") % 10 == 0,
        F.col("event_type") == "signup",
        F.col("user_id") % 5,
        (F.col("event_type") == "view") & (F.col("value") > 100),
        F.col("value") * 100,
        16000,
    )
    rows = t.events.select(status.alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", I.usable(F.col("status")).cast("int").alias("usable"), "n")


@query("min_valid", "SELECT clip, sum(valid::INT)::BIGINT AS n_valid FROM frames GROUP BY clip HAVING sum(valid::INT) >= 16")
def min_valid(t):
    return I.min_valid(t.frames, "clip", "valid", 16)


FEATS = """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE)
             WHEN vec_id % 13 = 0 THEN list_append(embedding::DOUBLE[], 'nan'::DOUBLE) ELSE embedding::DOUBLE[] END AS f FROM embeddings"""


@query(
    "feature_sanity",
    f"""SELECT vec_id, len(f)::INT AS n FROM ({FEATS}) WHERE len(list_filter(f, lambda x: isfinite(x))) = len(f)
        AND len(list_filter(f, lambda x: x <> 0)) > 0""",
)
def feature_sanity(t):
    f = F.col("embedding").cast("array<double>")
    made = (
        F.when(F.col("vec_id") % 11 == 0, F.transform(f, lambda x: F.lit(0.0)))
        .when(F.col("vec_id") % 13 == 0, F.array_append(f, F.lit(float("nan"))))
        .otherwise(f)
    )
    return t.embeddings.select("vec_id", made.alias("f")).filter(feature_ok("f")).select("vec_id", F.size("f").alias("n"))


BOX = """SELECT clip, frame_idx, x1, greatest(0, round_even((x1 + x2) / 2 - half, 0)) AS l, greatest(0, round_even((y1 + y2) / 2 - half, 0)) AS t,
                least(w, round_even((x1 + x2) / 2 + half, 0)) AS r, least(h, round_even((y1 + y2) / 2 + half, 0)) AS b
         FROM (SELECT *, greatest(x2 - x1, y2 - y1) * 1.3::DOUBLE / 2 AS half FROM boxes)"""


@query(
    "square_box",
    f"""SELECT clip, frame_idx, CASE WHEN ok THEN l::INT END AS l, CASE WHEN ok THEN t::INT END AS t, CASE WHEN ok THEN r::INT END AS r, CASE WHEN ok THEN b::INT END AS b
        FROM (SELECT *, (x1 IS NOT NULL AND r - l >= 8 AND b - t >= 8) AS ok FROM ({BOX}))""",
)
def square_box(t):
    box = G.square_box("x1", "y1", "x2", "y2", "w", "h", 0.3)
    return t.boxes.withColumn("box", box).select("clip", "frame_idx", "box.l", "box.t", "box.r", "box.b")


@query(
    "class_balance",
    """SELECT grp, np::BIGINT AS n_pos, nn::BIGINT AS n_neg, round(greatest(nn - 0.25 * nn, 1) / greatest(np + 0.25 * nn, 1), 9) AS pos_weight
       FROM (SELECT grp, sum(y)::DOUBLE AS np, (count(*) - sum(y))::DOUBLE AS nn FROM scored_ties GROUP BY grp)""",
)
def class_balance(t):
    return balance(t.scored_ties, "y", ["grp"], 0.25).withColumn("pos_weight", rounded("pos_weight", 9))


@query("frame_index", "SELECT doc_id, unnest(range(0, n_chars % 7))::INT AS frame_idx FROM documents WHERE n_chars % 7 > 0")
def frame_index(t):
    return expand_frames(t.documents.select("doc_id", (F.col("n_chars") % 7).alias("n")), "n").select("doc_id", "frame_idx")


@query(
    "fps_repair",
    """SELECT clip, CASE WHEN fps > 1 THEN round(fps, 3) ELSE 25.0 END AS fps FROM (SELECT clip, 1.0 / nullif(max(CASE WHEN frame_idx = 1 THEN ts END) - max(CASE WHEN frame_idx = 0 THEN ts END), 0) AS fps
         FROM (SELECT clip, frame_idx, frame_idx::DOUBLE / (CASE clip % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 29.97 WHEN 2 THEN 0.5 ELSE 60.0 END)::DOUBLE AS ts FROM frames) GROUP BY clip)""",
)
def fps_repair(t):
    rate = F.when(F.col("clip") % 4 == 0, 25.0).when(F.col("clip") % 4 == 1, 29.97).when(F.col("clip") % 4 == 2, 0.5).otherwise(60.0)
    return repaired_fps(t.frames.withColumn("ts", F.col("frame_idx") / rate), "clip", "frame_idx", "ts")


@query(
    "corpus_summary",
    """SELECT lang, source, grouping(lang, source)::INT AS grouping, count(*)::BIGINT AS n FROM documents
       GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())""",
)
def corpus_summary(t):
    return I.corpus_summary(t.documents, [["lang"], ["source"], ["lang", "source"], []])


@query(
    "storage_estimate",
    "SELECT lang, count(*)::BIGINT AS n, (count(*) * 32 * 256 * 256 * 3)::BIGINT AS estimated_bytes, sum(n_chars)::BIGINT AS actual_bytes FROM documents GROUP BY lang",
)
def storage_estimate(t):
    return I.storage_estimate(t.documents, ["lang"], F.col("n_chars"), 32, 256)


@query("orphans", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans(t):
    return I.orphans(t.customer.select("c_custkey", "c_name"), t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("exists_semi", "SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def exists_semi(t):
    listing = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return I.existing(t.lineitem, listing, "l_partkey").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("resume_jobs", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_jobs(t):
    return I.orphans(t.documents.select("doc_id", "source"), t.labels, "doc_id")


TIERS = """SELECT clip, frame_idx, CASE WHEN label % 3 = 0 THEN 'mesh' WHEN label % 3 = 1 THEN 'points' ELSE 'parametric' END AS tier,
                  CASE WHEN label % 3 = 0 THEN vec_id WHEN label % 3 = 1 THEN vec_id + 1000 ELSE -1 END::BIGINT AS landmark FROM frames"""


def _tiered(t):
    keys = ["clip", "frame_idx"]
    mesh = t.frames.filter("label % 3 = 0").select(*keys, F.col("vec_id").alias("landmark"))
    points = t.frames.filter("label % 3 < 2").select(*keys, (F.col("vec_id") + 1000).alias("landmark"))
    return I.tiered_lookup(t.frames.select(*keys), [("mesh", mesh), ("points", points)], keys, "landmark", F.lit(-1).cast("bigint"), "parametric")


@query("tiered_lookup", TIERS)
def tiered_lookup(t):
    return _tiered(t)


@query(
    "tier_share",
    f"""SELECT tier, n::BIGINT AS n, round(share, 6) AS share, (tier = 'parametric' AND share > 0.05)::INT AS alarm
        FROM (SELECT tier, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ({TIERS}) GROUP BY tier)""",
)
def tier_share(t):
    return I.tier_share(_tiered(t), "parametric").withColumn("share", rounded("share"))


@query(
    "feature_lookup",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 OR l.doc_id IS NULL THEN '0.0,0.0' ELSE CAST(l.toxic::DOUBLE AS STRING) || ',' || CAST(l.quality::DOUBLE AS STRING) END AS feature,
              CASE WHEN d.doc_id % 3 = 0 THEN 16 ELSE 9 END AS n_valid,
              CASE WHEN d.doc_id % 3 = 0 OR l.doc_id IS NULL THEN 25.0::DOUBLE ELSE 30.0::DOUBLE END AS fps
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def feature_lookup(t):
    q, x = F.col("quality").cast("double"), F.col("toxic").cast("double")
    feats = t.labels.select("doc_id", F.array(q, x).alias("mfcc_full"), F.array(x, q).alias("mfcc_trim"), F.lit(30.0).alias("fps"))
    rows = t.documents.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("has_audio"), F.lit(16).alias("n_frames"), F.lit(9).alias("n_valid"))
    out = I.feature_lookup(rows, feats, "doc_id", True, 2, "n_frames", "has_audio")
    return out.select("doc_id", F.array_join(F.transform("feature", lambda v: v.cast("string")), ",").alias("feature"), "n_valid", "fps")


@query(
    "duplicate_keys",
    "SELECT l_orderkey || ':' || l_linenumber AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(t):
    return I.duplicate_keys(t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key")), "key")


@query("missing_families", "SELECT p_brand || '/' || p_type AS family FROM part EXCEPT SELECT p_brand || '/' || p_type FROM part WHERE p_size <= 20")
def missing_families(t):
    fam = F.concat_ws("/", "p_brand", "p_type").alias("family")
    return I.missing_families(t.part.filter("p_size <= 20").select(fam), t.part.select(fam), "family")


def _layout_case(family: str) -> str:
    if family == "original":
        pats = [r"^(.*/)?original_sequences/(.*/)?c23/(.*/)?[^/]+\.mp4$", r"^(.*/)?original_sequences/(.*/)?[^/]+\.mp4$", r"^(.*/)?original/(.*/)?[^/]+\.mp4$"]
    else:
        pats = [rf"^(.*/)?manipulated_sequences/{family}/c23/(.*/)?[^/]+\.mp4$", rf"^(.*/)?manipulated_sequences/{family}/(.*/)?[^/]+\.mp4$", rf"^(.*/)?{family}/(.*/)?[^/]+\.mp4$"]
    whens = " ".join(f"WHEN regexp_matches(substr(path, length(root) + 2), '{p}') THEN {i}" for i, p in enumerate(pats))
    return f"SELECT root, path, '{family}' AS family, CASE {whens} END AS pr FROM layouts"


@query(
    "layout_fallback",
    f"""WITH h AS ({" UNION ALL ".join(_layout_case(f) for f in L.FAMILIES)}),
        c AS (SELECT *, min(pr) OVER (PARTITION BY root, family) AS best FROM h WHERE pr IS NOT NULL)
        SELECT DISTINCT family, path FROM c WHERE pr = best AND (NOT regexp_matches(path, '/(c0|c23|c40)/') OR path LIKE '%/c23/%')""",
)
def layout_fallback(t):
    return L.discover_layouts(t.layouts)


@query(
    "original_fallback",
    """SELECT path FROM layouts WHERE lower(path) LIKE '%original%' AND regexp_matches(path, 'original_sequences/(.*/)?c23/')""",
)
def original_fallback(t):
    return L.discover_originals(t.layouts).select("path")


@query(
    "json_labels",
    """SELECT user_id || '/' || event_id || '.mp4' AS path, (event_type = 'error')::INT AS label FROM events
       WHERE event_type IN ('error', 'click') AND json_extract(props, '$.k')::INT < 50""",
)
def json_labels(t):
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.when(F.col("event_type") == "error", "fake").when(F.col("event_type") == "click", "REAL").otherwise("n/a")
    name = F.concat(F.col("event_id").cast("string"), F.lit(".mp4"))
    raw = t.events.select(F.col("user_id").cast("string").alias("folder"), F.to_json(F.create_map(name, F.struct(word.alias("label")))).alias("text"))
    present = t.events.filter(k < 50).select(F.concat_ws("/", F.col("user_id").cast("string"), name).alias("path"))
    return I.existing(S.json_clip_labels(raw, "folder", "text"), present, "path")


@query(
    "speech_labels",
    """SELECT '/wav/' || doc_id || '.wav' AS path, toxic AS label FROM labels WHERE quality = 1""",
)
def speech_labels(t):
    word = F.when(F.col("quality") == 0, "unknown").when(F.col("toxic") == 1, "Spoof").otherwise("bona-fide")
    rows = t.labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"), word.alias("label"))
    return S.speech_labels(rows, "/wav")


@query(
    "protocol_parse",
    """SELECT 'E_' || event_id AS name, (event_type <> 'view')::INT AS label FROM events WHERE event_type <> 'signup'""",
)
def protocol_parse(t):
    last = F.when(F.col("event_type") == "view", "bonafide").otherwise("spoof")
    mid = F.when(F.col("event_type") == "signup", "-").otherwise("-  A07")
    line = F.concat_ws("  ", F.concat(F.lit(" S"), F.col("user_id").cast("string")), F.concat(F.lit("E_"), F.col("event_id").cast("string")), mid, last)
    return S.protocol_entries(t.events.select(line.alias("value")))
