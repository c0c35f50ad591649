import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import pairing as PR
from corpuslens.operators import sampling as S
from corpuslens.plans import catalog, prefix
from corpuslens.session import cut_lineage


def rows(spark):
    data = [(f"{g}-{y}", str(g), str(g), y) for g in range(9) for y in (0, 1)] + [(f"{g}-1", str(g), str(g), 1) for g in range(9, 14)]
    return spark.createDataFrame(data, "key string, identity_group string, target_id string, label int")


@pytest.mark.parametrize("kind", ["rank", "target"])
def test_pairs_stay_in_one_batch_and_rows_appear_once(spark, kind):
    df = rows(spark)
    pairs = PR.pair_by_rank(df, "key", label="label") if kind == "rank" else PR.pair_by_target(df, "key")
    pairs = pairs.select("real_key", "fake_key")
    matched = [tuple(r) for r in pairs.collect() if r.real_key and r.fake_key]
    assert len(matched) == 9
    orders = set()
    for epoch in range(3):
        plan = PR.batch_plan(pairs, 4, epoch=epoch, drop_last=False).collect()
        assert sorted(r.key for r in plan) == sorted(r.key for r in df.collect())
        batch = {r.key: r.batch for r in plan}
        assert all(batch[a] == batch[b] for a, b in matched)
        assert sorted(set(batch.values())) == list(range(6))  # 23 rows
        assert sum(r.batch == 5 for r in plan) == 3  # the partial batch stays last
        orders.add(tuple(sorted(batch.items())))
    assert len(orders) == 3


def test_drop_last_keeps_full_batches_only(spark):
    plan = PR.batch_plan(PR.pair_by_target(rows(spark), "key"), 4).collect()
    assert len(plan) == 20 and {r.slot for r in plan} == {0, 1, 2, 3}


def test_odd_batch_size_is_rejected(spark):
    with pytest.raises(ValueError, match="even"):
        PR.batch_plan(PR.pair_by_target(rows(spark), "key"), 3)


def test_one_real_serves_many_fakes_and_duplicates_resolve_to_the_largest(spark):
    df = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("f1", "1", 1), ("f2", "1", 1), ("g", "2", 1), ("c", "3", 0)], "key string, target_id string, label int")
    got = {tuple(r) for r in PR.pair_by_target(df, "key").collect()}
    assert got == {("b", "f1"), ("b", "f2"), (None, "g"), ("c", None), ("a", None)}


def test_negative_partner_comes_from_another_group_with_audio(spark):
    df = spark.createDataFrame([(f"k{i}", f"g{i % 3}", int(i % 4 != 0)) for i in range(50)], "key string, grp string, has_audio int")
    info = {r.key: r for r in df.collect()}
    got = PR.negative_partners(df, "key", "grp", "has_audio", 8).collect()
    assert len(got) == 50 and len({r.key for r in got}) == 50
    for r in got:
        if r.source == "cross_identity":
            assert info[r.negative_key].grp != info[r.key].grp and info[r.negative_key].has_audio == 1
        else:
            assert r.negative_key == r.key
    assert {r.source for r in got} == {"cross_identity", "same_clip_shift"}


def test_codes_follow_name_order(spark):
    names = [f"n{i * 37 % 101:03d}" for i in range(101)]
    got = dict(PR.group_codes(spark.createDataFrame([(n,) for n in names * 2], "g string"), "g").collect())
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_dropout_never_empties_a_clip(spark):
    data = [(c, f, c != 0) for c in range(40) for f in range(2)]
    df = spark.createDataFrame(data, "clip int, frame int, valid boolean")
    out = S.frame_dropout(df, "clip", "frame", "valid", p=0.9)
    per = {r.clip: r.n for r in out.groupBy("clip").agg(F.sum(F.col("valid").cast("int")).alias("n")).collect()}
    assert min(per.values()) == 1
    assert out.filter("clip = 0 and valid").first().frame == 0


def test_quota_counts_after_the_filter(spark):
    df = spark.createDataFrame([(i, i % 2, i >= 20) for i in range(60)], "id int, y int, ok boolean")
    got = S.class_quota(df, ["id"], "y", 15, F.col("ok"), "q").collect()
    assert len(got) == 30 and all(r.ok for r in got)


def test_negatives_stay_in_their_training_batch(spark):
    clips = rows(spark).withColumn("has_audio", (F.col("identity_group") % 3 != 0).cast("int"))
    plan = PR.batch_plan(PR.pair_by_rank(clips, "key", label="label"), 4, drop_last=False)
    got = PR.batch_negatives(plan, clips, "key", "identity_group", "has_audio").collect()
    batch = {r.key: r.batch for r in plan.collect()}
    audio = {r.key: r.has_audio for r in clips.collect()}
    assert sorted(r.key for r in got) == sorted(batch)
    for r in got:
        assert r.batch == batch[r.key] == batch[r.negative_key]
        if r.source == "cross_identity":
            assert audio[r.negative_key] == 1 and r.negative_key.split("-")[0] != r.key.split("-")[0]
        else:
            assert r.negative_key == r.key
    crossed = [r.negative_key for r in got if r.source == "cross_identity"]
    assert crossed and len(crossed) == len(set(crossed))


def test_a_batch_of_one_row_keeps_to_itself(spark):
    plan = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (1, 1, "c")], "batch bigint, slot int, key string")
    clips = spark.createDataFrame([(k, k, 1) for k in "abc"], "key string, identity_group string, has_audio int")
    got = {r.key: (r.negative_key, r.source) for r in PR.batch_negatives(plan, clips, "key", "identity_group", "has_audio").collect()}
    assert got == {"a": ("a", "same_clip_shift"), "b": ("c", "cross_identity"), "c": ("b", "cross_identity")}


def odd_rows(spark, repeated=0.0, null=0.0, empty=0.0, hot=0.0):
    draw = random.Random(7)
    data = []
    for i in range(400):
        key = None if draw.random() < null else "" if draw.random() < empty else f"k{draw.randrange(i + 1) if draw.random() < repeated else i}"
        grp = None if draw.random() < null else "g0" if draw.random() < hot else f"g{i % 11}"
        data.append((key, grp, draw.choice([0, 1, 1, 2 if null else 1]), draw.choice([0, 1, 1])))
    return spark.createDataFrame(data, "key string, grp string, label int, has_audio int")


@pytest.mark.parametrize("odd", [{}, {"repeated": 0.2}, {"null": 0.1}, {"empty": 0.01}, {"repeated": 0.1, "null": 0.1, "empty": 0.02, "hot": 0.8}])
def test_a_plan_that_carries_its_columns_gives_the_negatives_of_a_join_on_keys(spark, odd):
    clips, carry = odd_rows(spark, **odd), ["grp", "has_audio"]
    plain = PR.batch_plan(PR.pair_by_rank(clips, "key", "grp", "label"), 8, drop_last=False)
    carried = PR.batch_plan(PR.pair_by_rank(clips, "key", "grp", "label", carry=carry), 8, drop_last=False)
    assert Counter(plain.collect()) == Counter(carried.select(plain.columns).collect())
    got = PR.batch_negatives(carried, clips, "key", "grp", "has_audio")

    info, at, size, want = {}, {}, Counter(), Counter()
    for r in clips.collect():
        if r.key is not None:
            info.setdefault(r.key, []).append(r)
    for r in plain.collect():
        at[r.batch, r.slot] = r.key
        size[r.batch] += 1
    turns = {r.batch: r.turn for r in plain.select("batch", PR.hash_int("turn", 42, F.lit(2**32), "batch").alias("turn")).distinct().collect()}
    for (batch, slot), key in at.items():
        n = size[batch]
        partners = info.get(at[batch, (slot + 1 + turns[batch] % (n - 1)) % n if n > 1 else slot], [])
        for x in info.get(key, []):
            for y in partners or [x]:
                ok = x.grp is not None and y.grp is not None and x.grp != y.grp and y.has_audio == 1
                want[batch, slot, key, y.key if ok else key, "cross_identity" if ok else "same_clip_shift"] += 1
    assert Counter(map(tuple, got.collect())) == want


def order_lines(spark, folder):
    lines = spark.range(20_000).selectExpr(
        "id div 4 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id % 700 AS l_partkey", "id % 90 AS l_suppkey",
        "CASE WHEN id % 3 = 0 THEN 'N' ELSE 'R' END AS l_returnflag", "CAST(id % 50 AS DOUBLE) AS l_quantity",
    )
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return catalog.Tables(spark, str(folder))


def test_rows_of_batch_negatives_are_dealt_once_after_their_places_are_stored(spark, tmp_path):
    tables, before = order_lines(spark, tmp_path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.load()["batch_negatives"].run(tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One for the rows, the others for batch numbers: one to rank them and its totals, one to meet the rows.
    assert plan.count("Exchange hashpartitioning(_raw") == 2
    assert plan.count("Exchange hashpartitioning(") <= 5 and "key#" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Join" in x)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    stored = cut_lineage(spark.range(1000).repartition("id"), "freed", free=True)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and stored.count() == 1000


def test_a_large_table_is_dealt_to_more_tasks_than_configured(spark, monkeypatch):
    clips = rows(spark).withColumn("has_audio", F.lit(1))
    pairs = PR.pair_by_rank(clips, "key", label="label", carry=["identity_group", "has_audio"])
    want = Counter(map(tuple, PR.batch_plan(pairs, 4, drop_last=False).drop("formed").collect()))
    monkeypatch.setattr(prefix, "TASK_ROWS", 1)
    assert prefix.tasks_wanted(spark, 23) == 23
    assert prefix.deal(clips, 23, "key").rdd.getNumPartitions() == 23
    pairs = PR.pair_by_rank(clips, "key", label="label", carry=["identity_group", "has_audio"])
    assert Counter(map(tuple, PR.batch_plan(pairs, 4, drop_last=False).drop("formed").collect())) == want
