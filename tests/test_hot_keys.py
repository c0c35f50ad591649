"""No task may hold most rows of a hot key, even without broadcasts."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import identity, pairing, splits
from corpuslens.plans.prefix import running_totals, salted_join, with_group_stats
from corpuslens.sources import sinks, tables
from corpuslens.streaming.ingest import ingest_new


@pytest.fixture
def no_broadcast(spark):
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=60_000):
    key = F.when(F.col("id") % 10 < 8, F.lit(7)).otherwise(F.col("id"))
    return spark.range(n).select("id", key.alias("k"), F.lit("7").alias("s"), (F.col("id") % 97).alias("x"))


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_group_statistics(no_broadcast):
    out = with_group_stats(hot_rows(no_broadcast), ["k"], n=F.count(F.lit(1)))
    assert out.count() == 60_000 and out.filter("k = 7").first()["n"] == 48_000
    assert largest_share(out) < 0.15


def test_null_keys(no_broadcast):
    rows = hot_rows(no_broadcast).withColumn("k", F.when(F.col("k") != 7, F.col("k")))  # four fifths have no key
    side = no_broadcast.range(0, 60_000, 3).select(F.col("id").alias("k"), F.lit(1).alias("found"))
    out = salted_join(rows, side, ["k"], "left")
    plain = rows.join(side, ["k"], "left")
    assert out.count() == 60_000 and out.exceptAll(plain.select(*out.columns)).count() == 0
    assert largest_share(out) < 0.15
    assert salted_join(rows, side, ["k"]).count() == plain.filter("found = 1").count()


def test_ranges_of_a_hot_group(no_broadcast):
    rows = no_broadcast.range(60_000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("x"), F.lit(1).alias("w"))
    rows = rows.withColumn("g", F.when(F.col("x") % 100 != 99, F.col("g")))  # and a null group
    out = running_totals(rows, "x", ["w"], ["g"])
    assert largest_share(out) < 0.15
    hot = out.filter("g = 'hot'").orderBy("x").collect()
    assert [r.w_before for r in hot] == list(range(48_000)) and {r.w_total for r in hot} == {48_000}
    assert [r.w_before for r in out.filter("g is null").orderBy("x").collect()] == list(range(600))


def test_pairs(no_broadcast):
    rows = hot_rows(no_broadcast).select(F.col("id").cast("string").alias("key"), F.col("k").alias("target_id"), (F.col("id") % 10 != 9).cast("int").alias("label"))
    rows = rows.unionByName(no_broadcast.createDataFrame([("real", 7, 0)], rows.schema))
    out = pairing.pair_by_target(rows, "key").filter("fake_key is not null")
    assert out.filter("real_key = 'real'").count() == 48_000
    assert largest_share(out) < 0.15


def test_official_split_and_leakage(no_broadcast):
    rows = hot_rows(no_broadcast).select("id", F.col("k").cast("string").alias("target_id"), F.col("s").alias("source_id"))
    ids = no_broadcast.createDataFrame([("train", "7")], "split string, id string")
    out = splits.official_split(rows, ids)
    assert out.filter("split = 'train'").count() == 48_000
    assert largest_share(out) < 0.15
    both = rows.withColumn("split", F.when(F.col("id") < 10, "train").otherwise("val"))
    leaked = splits.source_leakage(both)
    assert leaked.count() == 59_990
    assert largest_share(leaked) < 0.15


def test_component_step_with_a_hub(no_broadcast):
    edges = no_broadcast.range(1, 40_001).select(F.col("id").alias("u"), F.lit(0).cast("bigint").alias("v"))
    assert largest_share(identity._step(edges, large=True)) < 0.15
    assert identity.components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).filter("component != 0").count() == 0


def test_an_arm_stored_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "arms")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "arm string, n int")
    sinks.append_results(rows, out, ["arm", "n"])
    sinks.append_results(rows.filter("arm = 'a'").withColumn("n", F.lit(5)), out, ["arm", "n"])
    got = spark.read.csv(out, header=True, schema="n int, arm string").select("arm", "n").collect()
    assert sorted(map(tuple, got)) == [("a", 5), ("b", 2)]


def test_a_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    src, out = str(tmp_path / "jobs"), str(tmp_path / "store")

    def drain(state):
        return ingest_new(spark, src, "key string, n int", out, str(tmp_path / state), F.lit("ok"))

    spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, n int").write.mode("append").parquet(src)
    drain("one")
    spark.createDataFrame([("c", 4)], "key string, n int").write.mode("append").parquet(src)
    assert sorted((r.key, r.n) for r in drain("two").collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_nested_split_folders(spark):
    def folder(d, val):
        return [(d, "train", '[["001", "002"]]'), (d, "val", f'[["{val}", "004"]]'), (d, "test", '[["005", "006"]]')]

    files = spark.createDataFrame(folder("/a", "008") + folder("/a/b", "009"), "dir string, split string, text string")
    assert {r.id for r in tables.valid_splits(files).filter("split = 'val'").collect()} == {"009", "004"}
