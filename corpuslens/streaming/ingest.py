"""Resumable ingest of new clips with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import stored_at


def ingest_new(
    spark: SparkSession,
    source: str,
    schema: str,
    out: str,
    checkpoint: str,
    status: Column,
    key: str = "key",
    file_format: str = "parquet",
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Process every job file not yet seen, skip stored keys, append the rest.

    The file source's checkpoint remembers which files were read, and the
    stream's state which keys: per key the least job row and the first and last
    batch time.  A batch emits a key if both times are its own, so no batch
    reads the store.  The rows of one key combine before they are shuffled.  A
    new checkpoint is seeded once with the keys that the store has, as rows of
    time zero in its first batch.  Streams that fill one store must run one
    after another.  A null key counts as a key.

    A batch overwrites its own folder, named after the stream's id and the
    batch, so a retry after a lost executor or driver writes the same rows
    once.  Of rows with one key the least is taken.  State grows with the keys;
    a large store calls for the RocksDB state store provider in the session.
    Returns the stored table, all statuses.
    """

    # An empty first folder gives the store its schema before any batch runs.
    empty = transform(spark.createDataFrame([], schema)).withColumn("status", status)
    empty.write.mode("ignore").parquet(f"{out}/run=none/batch=-1")
    seeds = f"{checkpoint}/known"
    if not stored_at(spark, f"{checkpoint}/metadata"):
        spark.read.parquet(out).select(key).distinct().write.mode("overwrite").parquet(seeds)

    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        rows = transform(batch).withColumn("status", status)
        rows.write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    jobs = spark.readStream.format(file_format).schema(schema).load(source)
    known = spark.readStream.schema(jobs.select(key).schema).parquet(seeds)
    row = F.struct(*jobs.columns)
    arrived = jobs.select(F.col(key).alias("_key"), row.alias("_row"), F.current_timestamp().alias("_at"))
    before = known.select(F.col(key).alias("_key"), F.lit(None).cast(arrived.schema["_row"].dataType).alias("_row"), F.timestamp_seconds(F.lit(0)).alias("_at"))
    seen = arrived.unionByName(before).groupBy("_key").agg(
        F.min("_row").alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    fresh = seen.filter("_first = _last and _row is not null").select("_row.*")
    query = (
        fresh.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def status_log(stored: DataFrame) -> DataFrame:
    return stored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def manifest_rows(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("status").isin("ok", "cached"))
