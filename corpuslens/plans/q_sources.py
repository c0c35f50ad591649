"""Queries that go through files: listings, manifests, sinks, ingest."""

from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.numeric import rounded
from corpuslens.operators import metrics as M
from corpuslens.operators.integrity import existing
from corpuslens.plans.catalog import query
from corpuslens.plans.q_evaluation import AUC_EXPR, auc_ranks
from corpuslens.plans.q_manifests import CAT
from corpuslens.session import workspace
from corpuslens.sources import listing as L
from corpuslens.sources import sinks as K
from corpuslens.sources import tables as S
from corpuslens.streaming import ingest as ST


@query(
    "media_listing",
    "SELECT lang, source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes FROM documents GROUP BY lang, source",  # a line feed after each text
)
def media_listing(t):
    """Text written per language and source, listed back by folder."""
    out = workspace(t.spark, "media")
    t.documents.select("lang", "source", "text").write.partitionBy("lang", "source").text(out)
    files = L.list_media(t.spark, out, ("mp4", "txt"))
    folder = [F.regexp_extract("path", f"/{c}=([^/]+)/", 1).alias(c) for c in ("lang", "source")]
    return files.groupBy(*folder).agg(F.sum("length").alias("n_bytes"))


MANIFEST = f"""SELECT lpad(CAST(doc_id AS STRING), 9, '0') AS key, path, {CAT} AS category, lang AS identity_group, (lower({CAT}) LIKE '%fakevideo%')::INT AS video_label,
                      (lower({CAT}) LIKE '%fakeaudio%')::INT AS audio_label, (n_chars % 33)::INT AS n_valid_faces, 25.0::DOUBLE AS fps FROM doc_paths"""


def _primary(t):
    cat = P.category("path")
    return t.doc_paths.select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("key"),
        "path",
        cat.alias("category"),
        F.col("lang").alias("identity_group"),
        P.video_label(cat).alias("video_label"),
        P.audio_label(cat).alias("audio_label"),
        (F.col("n_chars") % 33).cast("int").alias("n_valid_faces"),
        F.lit(25.0).alias("fps"),
    )


def _auxiliary(t):
    return t.doc_paths.select(
        F.col("doc_id").cast("string").alias("key"),
        "path",
        F.lit("FaceSwap").alias("method"),
        F.lit(1).alias("label"),
        F.col("doc_id").cast("string").alias("target_id"),
        F.lit(None).cast("string").alias("source_id"),
        F.col("lang").alias("identity_group"),
    )


@query("manifest_roundtrip", MANIFEST)
def manifest_roundtrip(t):
    out = workspace(t.spark, "manifest")
    K.write_manifest(_primary(t), out)
    return S.read_manifest(t.spark, out)


@query("header_sniff", f"SELECT key, video_label, audio_label FROM ({MANIFEST})")
def header_sniff(t):
    """Two manifests side by side; the right one is told by its header."""
    out = workspace(t.spark, "manifests")
    K.write_auxiliary_manifest(_auxiliary(t), f"{out}/a")
    K.write_manifest(_primary(t), f"{out}/b")
    picked = S.pick_by_header(t.spark, [f"{out}/b", f"{out}/a"], S.PRIMARY_MARKS)
    return S.read_manifest(t.spark, picked).select("key", "video_label", "audio_label")


@query("feature_cache", "SELECT vec_id AS key, 'c' || (label % 3) AS corpus, len(embedding)::INT AS n FROM embeddings")
def feature_cache(t):
    out = workspace(t.spark, "features")
    rows = t.embeddings.select(
        F.col("vec_id").alias("key"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("corpus"), "embedding"
    )
    K.write_features(rows, out)
    return t.spark.read.parquet(out).select("key", "corpus", F.size("embedding").alias("n"))


@query(
    "run_records",
    "SELECT run::BIGINT AS seed, count(*)::BIGINT AS epochs, max(metric) AS best FROM train_log GROUP BY run",
)
def run_records(t):
    """Record files of several seeds each, read back as a row per seed."""
    out = workspace(t.spark, "runs")
    runs = t.train_log.groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.max("metric").alias("best"))
    seed = F.struct(F.col("run").cast("bigint").alias("seed"), "epochs", "best")
    records = runs.groupBy((F.col("run") % 8).alias("part")).agg(F.to_json(F.struct(F.collect_list(seed).alias("per_seed"))).alias("record"))
    records.write.partitionBy("part").text(out)
    return S.read_run_record(t.spark, out).select("seed", "epochs", "best")


@query("results_roundtrip", f"SELECT dataset, np::BIGINT + nn::BIGINT AS n, round({AUC_EXPR}, 9) AS auc FROM ({auc_ranks('scored', 'dataset')})")
def results_roundtrip(t):
    """Results with raw scores attached are stored without them."""
    out = workspace(t.spark, "results")
    res = M.auc(t.scored, by=["dataset"]).select(
        "dataset", (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc", F.lit("raw").alias("y_true"), F.lit("raw").alias("y_score")
    )
    K.write_results(res, out)
    stored = t.spark.read.json(out)
    return stored.select("dataset", "n", rounded("auc", 9).alias("auc")).selectExpr("*") if "y_true" not in stored.columns else stored


@query(
    "append_results",
    "SELECT grp AS arm, count(*)::BIGINT AS n_test, NULL AS encoder FROM scored_ties GROUP BY grp",
)
def append_results(t):
    """All arms, and one of them once more; a column outside the field list is ignored."""
    out = workspace(t.spark, "arms")
    rows = t.scored_ties.groupBy(F.col("grp").alias("arm")).agg(F.count(F.lit(1)).alias("n_test"), F.max("score").alias("extra"))
    K.append_results(rows, out, ["arm", "n_test", "encoder"])
    K.append_results(rows.filter("arm = 'F'"), out, ["arm", "n_test", "encoder"])
    stored = t.spark.read.csv(out, header=True, schema="n_test bigint, encoder string, arm string")
    return stored.select("arm", "n_test", "encoder")


@query("key_list", "SELECT CAST(doc_id AS STRING) AS key FROM labels WHERE quality = 1")
def key_list(t):
    out = workspace(t.spark, "keys")
    K.write_keys(t.labels.filter("quality = 1").select(F.col("doc_id").alias("key")), out)
    return t.spark.read.text(out).select(F.col("value").alias("key"))


@query("stored_splits", "SELECT split, count(*)::BIGINT AS n FROM split_scored GROUP BY split")
def stored_splits(t):
    from corpuslens.operators.splits import split_manifest

    out = workspace(t.spark, "splits")
    K.write_splits(split_manifest(t.split_scored, "id"), out)
    return t.spark.read.parquet(out).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


ID3 = "lpad(CAST(doc_id % 1000 AS STRING), 3, '0')"
SPLIT_OF = f"CASE WHEN substr(md5({ID3}), 1, 1) < 'c' THEN 'train' WHEN substr(md5({ID3}), 1, 1) < 'e' THEN 'val' ELSE 'test' END"


@query("split_file_load", f"SELECT DISTINCT {SPLIT_OF} AS split, {ID3} AS id FROM documents")
def split_file_load(t):
    """Split texts of four folders: overlapping, malformed, sound, and one inside another whose train file comes later."""
    ids = t.documents.select(F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0").alias("id")).distinct()
    h = F.substring(F.md5("id"), 1, 1)
    ids = ids.withColumn("split", F.when(h < "c", "train").when(h < "e", "val").otherwise("test"))
    # Three-digit ids: a split file holds at most a thousand of them.
    pair = F.concat(F.lit('["'), F.col("id"), F.lit('", "'), F.col("id"), F.lit('"]'))
    text = ids.groupBy("split").agg(F.concat(F.lit("["), F.array_join(F.collect_list(pair), ", "), F.lit("]")).alias("text"))
    overlapping = text.select(F.lit("/a").alias("dir"), "split", F.lit('[["001", "002"]]').alias("text"))
    malformed = text.select(F.lit("/b").alias("dir"), "split", F.lit('{"images": []}').alias("text"))
    sound = text.select(F.lit("/c/inner").alias("dir"), "split", "text")
    swapped = F.when(F.col("split") == "val", "test").when(F.col("split") == "test", "val").otherwise("train")
    outer = text.select(F.lit("/c").alias("dir"), swapped.alias("split"), "text")
    files = overlapping.unionByName(malformed).unionByName(sound).unionByName(outer)
    return S.valid_splits(files).select("split", "id")


@query(
    "json_label_files",
    "SELECT doc_id || '.mp4' AS name, toxic AS label FROM labels WHERE quality = 1 AND doc_id % 2 = 0",
)
def json_label_files(t):
    """Label files on disk, joined with the files that exist."""
    out = workspace(t.spark, "labels")
    word = F.when(F.col("quality") == 0, "unknown").when(F.col("toxic") == 1, "fake").otherwise("REAL")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".mp4"))
    rows = t.labels.select(F.to_json(F.create_map(name, F.struct(word.alias("label")))).alias("value"))
    rows.write.text(out)
    raw = t.spark.read.text(out).select(F.lit("/v").alias("folder"), F.col("value").alias("text"))
    present = t.labels.filter("doc_id % 2 = 0").select(F.concat(F.lit("/v/"), name).alias("path"))
    return existing(S.json_clip_labels(raw, "folder", "text"), present, "path").select(P.base_name("path").alias("name"), "label")


@query(
    "incremental_ingest",
    """SELECT CAST(doc_id AS STRING) AS key, CASE WHEN n_chars = 0 THEN 'no_faces' WHEN n_chars < 500 THEN 'audio_too_short' ELSE 'ok' END AS status FROM documents""",
)
def incremental_ingest(t):
    """Two drops of job files with repeats; every key is processed once."""
    base = workspace(t.spark, "ingest")
    jobs = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.col("n_chars").alias("samples"))
    n = F.col("samples")
    status = F.when(n == 0, "no_faces").when(n < 500, "audio_too_short").otherwise("ok")

    def drain(state: str = "state"):
        return ST.ingest_new(t.spark, f"{base}/jobs", "key string, samples bigint", f"{base}/store", f"{base}/{state}", status)

    jobs.filter("samples < 4000").write.mode("append").parquet(f"{base}/jobs")
    drain()
    jobs.write.mode("append").parquet(f"{base}/jobs")
    drain()
    # A new checkpoint reads every file again and must keep what is stored.
    return drain("again").select("key", "status")
