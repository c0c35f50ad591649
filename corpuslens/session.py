"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "corpuslens") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a folder under the session's warehouse is
    used, which executors must reach anyway to store tables: on a cluster the
    warehouse must be shared too.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if root is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        root = f"{warehouse.rstrip('/')}/_work"
    return root


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame, name: str = "cut", compression: str = "snappy", free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table.

    The files survive lost executors, and their known size lets Spark choose
    broadcast joins for small results.  ``free`` deletes what the write
    shuffled as soon as the table is stored, not when the driver next collects
    garbage; nothing else reads these files.
    """
    path = workspace(df.sparkSession, name)
    with _setting(df.sparkSession, _FREE, "true") if free else contextlib.nullcontext():
        df.write.option("compression", compression).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


def _place(spark: SparkSession, path: str):
    """(file system, path) of any storage that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stored_at(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    files, place = _place(spark, path)
    return files.exists(place)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut_lineage`` stored, once nothing reads them any more: neither a table still to be written nor a result."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is not None:
            files, place = _place(table.sparkSession, path)
            files.delete(place, True)
