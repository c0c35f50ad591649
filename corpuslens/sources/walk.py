"""Folders walked and header lines read inside tasks."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import _place

ROWS = "path string, length long, folder boolean"
#: Rows handed to Spark at once.
BATCH = 10_000
#: Levels of folders that are dealt out before each remaining tree is walked by one task.
LEVELS = 2


def existing_roots(spark: SparkSession, roots: list[str]) -> list[tuple[str, bool]]:
    """(qualified path, whether a folder) of all roots, patterns resolved; a root that isn't there fails."""
    found = []
    for root in roots:
        files, place = _place(spark, root)
        hits = files.globStatus(place)
        if not hits:
            raise FileNotFoundError(root)
        found += [(h.getPath().toString(), h.isDirectory()) for h in hits]
    return found


def on_mounted_storage(paths: list[str]) -> bool:
    return all(p.startswith("file:") for p in paths)


def plain(path: str) -> str:
    """The path without the scheme of mounted storage."""
    return re.sub("^file:/+", "/", path)


def hidden(name: str) -> bool:
    """Names that Spark's own listing skips."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def glob_pattern(glob: str) -> str:
    """A regular expression for a file-name pattern of ``*``, ``?`` and ``{a,b}``."""
    parts = {"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}
    inside, out = 0, []
    for c in glob:
        inside += (c == "{") - (c == "}")
        out.append(parts[c] if c in "*?{}" or (c == "," and inside) else re.escape(c))
    return "".join(out)


def children(path: str, filesystem: pafs.FileSystem | None) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether a folder) of what stands in a folder; mounted folders are streamed."""
    if filesystem is None:
        with os.scandir(path) as entries:
            for e in entries:
                if not hidden(e.name):
                    folder = e.is_dir()
                    yield f"{path.rstrip('/')}/{e.name}", 0 if folder else e.stat().st_size, folder
    else:
        for info in filesystem.get_file_info(pafs.FileSelector(path)):
            if not hidden(info.base_name):
                folder = info.type == pafs.FileType.Directory
                yield info.path, 0 if folder else info.size, folder


def _opened(glob: str, filesystem: pafs.FileSystem | None, whole: bool) -> Callable:
    """Replaces folders by what they hold, one level or ``whole`` trees; of files only those of the pattern go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matches = re.compile(glob_pattern(glob)).fullmatch
        rows: list[tuple[str, int, bool]] = []
        for batch in batches:
            given = zip(batch["path"], batch["length"], batch["folder"])
            for path, length, folder in given:
                if not folder:
                    rows.append((path, length, False))
                # Open folders of this tree: names only, never the files in them.
                waiting = [path] if folder else []
                while waiting:
                    for child in children(waiting.pop(), filesystem):
                        if child[2] and whole:
                            waiting.append(child[0])
                        elif child[2] or matches(child[0].rsplit("/", 1)[-1]):
                            rows.append(child)
                        if len(rows) >= BATCH:
                            yield pd.DataFrame(rows, columns=["path", "length", "folder"])
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["path", "length", "folder"])

    return run


def walked(spark: SparkSession, roots: list[tuple[str, bool]], glob: str, filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """(path, length) of the files below ``roots`` whose names match; the driver holds the roots alone.

    The folders of the first levels are dealt out to tasks one by one, so a tree
    is walked by as many tasks as it has folders at that depth.  Files that are
    roots must match too.  A folder that goes away meanwhile fails the job.
    """
    matches = re.compile(glob_pattern(glob)).fullmatch
    first = [(p, os.stat(p).st_size if filesystem is None and not folder else 0, folder) for p, folder in roots]
    if filesystem is not None:
        first = [(p, filesystem.get_file_info(p).size or 0, folder) for p, _, folder in first]
    rows = spark.createDataFrame([r for r in first if r[2] or matches(r[0].rsplit("/", 1)[-1])], ROWS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for level in range(LEVELS + 1):
        rows = rows.repartition(tasks, "path").mapInPandas(_opened(glob, filesystem, level == LEVELS), ROWS)
    return rows.select("path", "length")


def _header(path: str, folder: bool, filesystem: pafs.FileSystem) -> str:
    """First line that isn't blank: of the file, or of the folder's first file that has one."""
    files = sorted(i.path for i in filesystem.get_file_info(pafs.FileSelector(path)) if i.is_file and not hidden(i.base_name)) if folder else [path]
    for file in files:
        with filesystem.open_input_stream(file) as stream:
            text = b""
            while block := stream.read(1 << 16):
                text = (text + block).lstrip(b"\r\n")
                if b"\n" in text:
                    break
            line = text.split(b"\n", 1)[0].decode("utf-8-sig", "replace").strip("\r")
            if line:
                return line
    return ""


def headers(spark: SparkSession, candidates: list[tuple[str, bool]], filesystem: pafs.FileSystem | None = None) -> DataFrame:
    """(place, columns) of comma-separated candidates, by their place in the list: one job, of each only the first line."""
    rows = spark.createDataFrame([(i, p, folder) for i, (p, folder) in enumerate(candidates)], "place int, path string, folder boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage = filesystem or pafs.LocalFileSystem()
        for batch in batches:
            lines = [_header(p, folder, storage) for p, folder in zip(batch["path"], batch["folder"])]
            yield pd.DataFrame({"place": batch["place"], "columns": [next(csv.reader([line]), []) for line in lines]})

    tasks = min(len(candidates), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(tasks, 1), F.col("place")).mapInPandas(run, "place int, columns array<string>")
