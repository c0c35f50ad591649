"""Manifests, label files, split files and saved results."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.sources import walk

# --- fixed values: manifest columns and label words --------------------------
PRIMARY_SCHEMA = (
    "key string, path string, category string, identity_group string, "
    "video_label int, audio_label int, n_valid_faces int, fps double"
)
AUXILIARY_SCHEMA = (
    "key string, path string, method string, label int, target_id string, source_id string, identity_group string"
)
PRIMARY_MARKS = ["audio_label"]
AUXILIARY_MARKS = ["method", "target_id"]
CLIP_LABELS = {"REAL": 0, "FAKE": 1}
SPEECH_LABELS = {"bona-fide": 0, "spoof": 1}
PROTOCOL_REAL = "bonafide"
SPLIT_PAIR = r'\[\s*"\d{3}"\s*,\s*"\d{3}"\s*\]'
# --- end of fixed values ------------------------------------------------------


def read_manifest(spark: SparkSession, path: str | Sequence[str], schema: str = PRIMARY_SCHEMA) -> DataFrame:
    """A manifest with declared types; empty text reads as NULL, ``nan`` as NaN."""
    return spark.read.csv(path if isinstance(path, str) else list(path), header=True, schema=schema, nanValue="nan")


def pick_by_header(spark: SparkSession, paths: Sequence[str], marks: Sequence[str], filesystem: FileSystem | None = None) -> str:
    """First manifest, in path order, whose header names every marked column.

    On mounted storage, or on a ``filesystem`` of pyarrow's, one job reads the
    header lines of all candidates; on other storage it is a small job for each.
    """
    given = sorted(paths)
    first = None
    if filesystem is not None:
        found = [(p, filesystem.get_file_info(p).type == FileType.Directory) for p in given]
    else:
        found = [walk.existing_roots(spark, [p])[0] for p in given]
    if filesystem is None and not walk.on_mounted_storage([p for p, _ in found]):
        first = next((p for p in given if set(marks) <= set(spark.read.csv(p, header=True).columns)), None)
    elif found:
        named = F.forall(F.lit(list(marks)), lambda m: F.array_contains("columns", m))
        lines = walk.headers(spark, [(walk.plain(p), folder) for p, folder in found], filesystem)
        place = lines.filter(named).agg(F.min("place")).first()[0]
        first = None if place is None else given[place]
    if first is None:
        raise FileNotFoundError(f"no manifest with columns {list(marks)}")
    return first


def json_clip_labels(df: DataFrame, folder: str, text: str) -> DataFrame:
    """(path, label) from JSON objects {file: {"label": ...}} of a folder."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("label", T.StringType())]))
    rows = df.select(F.col(folder).alias("_f"), F.explode(F.from_json(F.col(text), schema)).alias("name", "info"))
    word = F.upper(F.coalesce(F.col("info.label"), F.lit("")))
    label = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in CLIP_LABELS.items()])
    return rows.select(F.concat_ws("/", "_f", "name").alias("path"), label.alias("label")).filter("label is not null")


def read_json_labels(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """Every label file below a root; each is one bounded folder listing."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .text(root, wholetext=True)
        .select(
            F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), "/[^/]+$", "").alias("folder"),
            F.col("value").alias("text"),
        )
    )
    return json_clip_labels(raw, "folder", "text")


def speech_labels(df: DataFrame, folder: str, file: str = "file", word: str = "label") -> DataFrame:
    """(path, label) from a (file, label word) table; other words are dropped."""
    low = F.lower(F.coalesce(F.col(word), F.lit("")))
    label = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in SPEECH_LABELS.items()])
    return df.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.coalesce(file, F.lit(""))).alias("path"), label.alias("label")).filter(
        "label is not null"
    )


def protocol_entries(lines: DataFrame, text: str = "value") -> DataFrame:
    """(name, label) of whitespace protocol lines: field 2 and the last field.

    Lines with fewer than five fields are skipped.
    """
    parts = F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")
    rows = lines.select(parts.alias("_p")).filter(F.size("_p") >= 5)
    real = F.element_at("_p", -1) == PROTOCOL_REAL
    return rows.select(F.element_at("_p", 2).alias("name"), F.when(real, 0).otherwise(1).alias("label"))


def split_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """(split, id) of the first directory holding a valid split file triple.

    Valid: train, val and test files of one directory, each a non-empty list
    of pairs of three-digit strings, with no id in two splits.  Empty if none.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{train,val,test}.json")
        .text(list(roots) if not isinstance(roots, str) else roots, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    return valid_splits(
        raw.select(
            F.regexp_replace("file", "/[^/]+$", "").alias("dir"),
            F.regexp_extract("file", r"([a-z]+)\.json$", 1).alias("split"),
            F.col("value").alias("text"),
        )
    )


def valid_splits(files: DataFrame) -> DataFrame:
    """(split, id) from (dir, split, text) rows; see :func:`split_files`."""
    shape = F.regexp_replace(F.regexp_replace("text", SPLIT_PAIR, "P"), r"\s+", "")
    good = files.filter(F.replace(shape, F.lit(",P"), F.lit("")) == "[P]")
    ids = good.select("dir", "split", F.explode(F.flatten(F.from_json("text", "array<array<string>>"))).alias("id")).distinct()
    # A directory's ids number in the thousands; counts combine map-side.
    dirs = ids.groupBy("dir", "id").agg(F.count(F.lit(1)).alias("_in"), F.max("split").alias("_s"))
    whole = dirs.groupBy("dir").agg(F.max("_in").alias("_in"))
    have = good.select("dir", "split").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("_k"))
    sound = whole.join(have, "dir").filter("_in = 1 and _k = 3")
    # The folder whose train file comes first by path, which differs from the first folder where folders nest.
    first = sound.agg(F.min_by("dir", F.concat("dir", F.lit("/train.json")))).scalar()
    return ids.withColumn("_first", first).filter("dir = _first").select("split", "id")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, name, n, auc, lo, hi, acc) from a saved result document."""
    result = "struct<name:string,n:bigint,auc:double,auc_ci:array<double>,acc:double>"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"map<string,{result}>")).alias("dataset", "r"))
    return rows.filter("r is not null").select(
        "dataset", "r.name", "r.n", "r.auc",
        F.try_element_at("r.auc_ci", F.lit(1)).alias("lo"), F.try_element_at("r.auc_ci", F.lit(2)).alias("hi"), "r.acc",
    )


def read_run_record(spark: SparkSession, path: str) -> DataFrame:
    """One row per seed of a saved run record."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.inline("per_seed"))
