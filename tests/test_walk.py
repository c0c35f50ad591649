import gzip

import pyarrow.fs as pafs
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuslens.sources import listing as L
from corpuslens.sources import tables as S
from corpuslens.sources import walk

TREE = {
    "top.mp4": 1,
    "a/one.mp4": 2,
    "a/b/two.mp4": 3,
    "a/b/c/d/e/deep.mp4": 4,
    "a/b/c/d/e/deep.txt": 5,
    "lang=x y/source=s%3A1/part.mp4": 6,
    "_logs/no.mp4": 7,
    "a/.cache/no.mp4": 8,
    "_year=1/yes.mp4": 9,
    "a/_temporary.mp4": 10,
    "a/.hidden.mp4": 11,
    "many.mp4/inside.avi": 12,
}


@pytest.fixture
def tree(tmp_path):
    for name, size in TREE.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
    (tmp_path / "empty" / "er").mkdir(parents=True)
    return tmp_path


def by_spark(spark, root, glob):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(str(root))
    return sorted((r.path.removeprefix("file:"), r.length) for r in rows.select("path", "length").collect())


def listed(df):
    return sorted((r.path, r.length) for r in df.collect())


@pytest.mark.parametrize("glob", ["*.mp4", "*.{mp4,avi}", "?ne.*", "d*p.txt", "none"])
def test_walk_equals_sparks_listing(spark, tree, glob):
    assert listed(L.list_files(spark, str(tree), glob)) == by_spark(spark, tree, glob)


def test_walk_on_a_given_file_system(spark, tree):
    got = L.list_files(spark, str(tree), "*.mp4", pafs.LocalFileSystem())
    assert listed(got) == by_spark(spark, tree, "*.mp4")
    inner = pafs.SubTreeFileSystem(str(tree), pafs.LocalFileSystem())
    assert listed(L.list_files(spark, "a/b", "*.mp4", inner)) == [("a/b/c/d/e/deep.mp4", 4), ("a/b/two.mp4", 3)]
    with pytest.raises(FileNotFoundError):
        L.list_files(spark, "nowhere", "*.mp4", inner)


def test_roots_may_be_files_patterns_or_several(spark, tree):
    assert listed(L.list_files(spark, str(tree / "top.mp4"), "*.mp4")) == [(str(tree / "top.mp4"), 1)]
    assert listed(L.list_files(spark, str(tree / "top.mp4"), "*.avi")) == []
    want = [(str(tree / "a" / "b" / "c" / "d" / "e" / "deep.txt"), 5)]
    assert listed(L.list_files(spark, f"{tree}/[ab]/b", "*.txt")) == want
    two = L.list_files(spark, [str(tree / "a" / "b"), str(tree / "many.mp4")], "*.{avi,txt}")
    assert listed(two) == sorted(want + [(str(tree / "many.mp4" / "inside.avi"), 12)])
    assert listed(L.list_files(spark, str(tree / "empty"), "*")) == []
    with pytest.raises(FileNotFoundError):
        L.list_files(spark, str(tree / "nowhere"), "*")


def test_a_wide_tree_is_walked_by_many_tasks(spark, tmp_path):
    for k in range(64):
        (tmp_path / f"k{k}" / "v").mkdir(parents=True)
        for j in range(3):
            (tmp_path / f"k{k}" / "v" / f"{j}.mp4").write_bytes(b"")
    got = L.list_files(spark, str(tmp_path), "*.mp4")
    tasks = [r[0] for r in got.selectExpr("spark_partition_id() AS t").groupBy("t").count().select("count").collect()]
    assert sum(tasks) == 192 and max(tasks) < 192 / 3


@given(st.lists(st.sampled_from(["mp4", "avi", "a.b", "x+y"]), min_size=1, max_size=3, unique=True), st.sampled_from(["c", "c.d", "e,f"]))
def test_patterns_name_whole_endings(endings, stem):
    import re

    pattern = re.compile(walk.glob_pattern("*.{" + ",".join(endings) + "}"))
    assert all(pattern.fullmatch(f"{stem}.{e}") for e in endings)
    assert not pattern.fullmatch(f"{stem}.{endings[0]}x") and not pattern.fullmatch(stem + endings[0])
    assert re.fullmatch(walk.glob_pattern("e,?"), "e,f")


HEADERS = {
    "blank.csv": "",
    "lines.csv": "\n\nkey,other\n1,2\n",
    "quoted.csv": '"key","a,b"\n1,2\n',
    "marked.csv": "﻿key,method\n1,2\n",
    "late.csv": "key,method,target_id\nk,m,1\n",
    "parts/_SUCCESS": "",
    "parts/part-0.csv": "",
    "parts/part-1.csv": "method,target_id,audio_label\nm,1,0\n",
}


def test_headers_come_from_one_job(spark, tmp_path):
    for name, text in HEADERS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"zipped,method\r\n1,2\r\n"))
    names = ["blank.csv", "late.csv", "lines.csv", "marked.csv", "parts", "quoted.csv", "z.csv.gz"]
    paths = [str(tmp_path / n) for n in names]
    got = {names[r.place]: r["columns"] for r in walk.headers(spark, [(p, p.endswith("parts")) for p in paths]).collect()}
    assert got == {
        "blank.csv": [], "late.csv": ["key", "method", "target_id"], "lines.csv": ["key", "other"], "marked.csv": ["key", "method"],
        "parts": ["method", "target_id", "audio_label"], "quoted.csv": ["key", "a,b"], "z.csv.gz": ["zipped", "method"],
    }
    assert S.pick_by_header(spark, paths, ["method", "target_id"]) == str(tmp_path / "late.csv")
    assert S.pick_by_header(spark, paths, ["audio_label"]) == str(tmp_path / "parts")
    assert S.pick_by_header(spark, paths, ["zipped"], pafs.LocalFileSystem()) == str(tmp_path / "z.csv.gz")
    for missing in ([], paths[:1]):
        with pytest.raises(FileNotFoundError):
            S.pick_by_header(spark, missing, ["key"])


def test_fifty_candidates_make_one_job(spark, tmp_path):
    paths = [str(tmp_path / f"m{k:02}.csv") for k in range(50)]
    for k, p in enumerate(paths):
        open(p, "w").write(f"key,c{k}\n" + "1,2\n" * 100)
    spark.sparkContext.setJobGroup("sniff", "headers of fifty manifests")
    assert S.pick_by_header(spark, paths, ["key", "c37"]) == paths[37]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sniff")
    spark.sparkContext._jsc.sc().clearJobGroup()
    # Spark's adaptive plan shows one action as one job for each of its stages.
    assert len(jobs) <= 3
