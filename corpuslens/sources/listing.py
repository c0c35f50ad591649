"""Finding media files."""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.paths import folder_label, mentions_any, unix_path
from corpuslens.sources import walk

# --- fixed values: directory layouts, most specific first --------------------
FAMILIES = ["original", "Deepfakes", "Face2Face", "FaceSwap", "NeuralTextures"]
ORIGINAL_LAYOUTS = [
    r"^(.*/)?original_sequences/(.*/)?{level}/(.*/)?[^/]+\.mp4$",
    r"^(.*/)?original_sequences/(.*/)?[^/]+\.mp4$",
    r"^(.*/)?original/(.*/)?[^/]+\.mp4$",
]
MANIPULATED_LAYOUTS = [
    r"^(.*/)?manipulated_sequences/{family}/{level}/(.*/)?[^/]+\.mp4$",
    r"^(.*/)?manipulated_sequences/{family}/(.*/)?[^/]+\.mp4$",
    r"^(.*/)?{family}/(.*/)?[^/]+\.mp4$",
]
COMPRESSION_LEVELS = ["c0", "c23", "c40"]
MANIPULATION_TOKENS = ["deepfakes", "face2face", "faceswap", "neuraltextures", "manipulated"]
# --- end of fixed values ------------------------------------------------------


def list_files(spark: SparkSession, roots: str | Sequence[str], glob: str, filesystem: FileSystem | None = None) -> DataFrame:
    """(path, length) of files whose names match below ``roots``; contents are not read.

    Mounted storage is walked by tasks.  So are object stores if ``filesystem``
    names one of pyarrow's (roots are then its paths, without patterns); other
    storage is listed by Spark's file index, which holds all names on the driver.
    Hidden names (``.x``, ``_x``) are skipped, a missing root fails.
    """
    given = [roots] if isinstance(roots, str) else list(roots)
    if filesystem is not None:
        infos = filesystem.get_file_info(given)
        if missing := [i.path for i in infos if i.type == FileType.NotFound]:
            raise FileNotFoundError(missing[0])
        return walk.walked(spark, [(i.path, i.type == FileType.Directory) for i in infos], glob, filesystem)
    found = walk.existing_roots(spark, given)
    if walk.on_mounted_storage([p for p, _ in found]):
        return walk.walked(spark, [(walk.plain(p), folder) for p, folder in found], glob)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(given).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def list_media(spark: SparkSession, roots: str | Sequence[str], extensions: Sequence[str] = ("mp4", "avi")) -> DataFrame:
    """(path, length) of the first extension that has any file."""
    listed = list_files(spark, roots, "*.{" + ",".join(extensions) + "}")
    return first_extension(listed, extensions)


def first_extension(listed: DataFrame, extensions: Sequence[str] = ("mp4", "avi")) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("path").endswith(f".{e}"), F.lit(i)) for i, e in enumerate(extensions)])
    ranked = listed.withColumn("_ext", order).filter("_ext is not null")
    best = ranked.agg(F.min("_ext")).scalar()
    return ranked.withColumn("_best", best).filter("_ext = _best").drop("_ext", "_best")


def exclude_tokens(df: DataFrame, tokens: Sequence[str], path: str = "path") -> DataFrame:
    return df.filter(~mentions_any(path, tokens))


def discover_layouts(listed: DataFrame, level: str = "c23") -> DataFrame:
    """(root, family, path) of the first layout that hits per root and family.

    The compression level is checked after that choice, so a wrong-level
    canonical tree still hides a flat one under the same root.
    """
    rel = F.substring(unix_path("path"), F.length("root") + F.lit(2), F.length("path"))
    tests = []
    for family in FAMILIES:
        layouts = ORIGINAL_LAYOUTS if family == "original" else MANIPULATED_LAYOUTS
        hits = [F.when(rel.rlike(p.format(family=family, level=level)), F.lit(i)) for i, p in enumerate(layouts)]
        tests.append(F.struct(F.lit(family).alias("family"), F.coalesce(*hits).alias("priority")))
    hits = listed.select("root", "path", F.inline(F.array(*tests))).filter("priority is not null")
    best = hits.groupBy("root", "family").agg(F.min("priority").alias("priority"))
    chosen = hits.join(best, ["root", "family", "priority"])
    parts = F.split(unix_path("path"), "/")
    unlabelled = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in COMPRESSION_LEVELS]))
    right = F.array_contains(parts, level)
    return chosen.filter(unlabelled | right).select("family", "path").distinct()


def discover_originals(listed: DataFrame, level: str = "c23") -> DataFrame:
    """Original clips: canonical layout, else any path that says so by name."""
    canonical = F.col("path").rlike(ORIGINAL_LAYOUTS[0].format(level=level))
    named = F.lower("path").contains("original") & ~mentions_any("path", MANIPULATION_TOKENS)
    tagged = listed.withColumn("_p", F.when(canonical, 0).when(named & F.col("path").endswith(".mp4"), 1))
    tagged = tagged.filter("_p is not null")
    return tagged.withColumn("_best", tagged.agg(F.min("_p")).scalar()).filter("_p = _best").drop("_p", "_best")


def labelled_folders(listed: DataFrame) -> DataFrame:
    """(path, label) of files under a labelled folder."""
    return listed.select("path", folder_label("path").alias("label")).filter("label is not null")
