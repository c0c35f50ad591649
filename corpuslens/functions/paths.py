"""What a media path says about its clip: category, label, key, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.numeric import c

# --- fixed values -----------------------------------------------------------
CATEGORIES = [
    "RealVideo-RealAudio",
    "RealVideo-FakeAudio",
    "FakeVideo-RealAudio",
    "FakeVideo-FakeAudio",
]
CATEGORY_CODES = {
    "RealVideo-RealAudio": "RVRA",
    "RealVideo-FakeAudio": "RVFA",
    "FakeVideo-RealAudio": "FVRA",
    "FakeVideo-FakeAudio": "FVFA",
    "Unknown": "UNK",
}
LABELLED_FOLDERS = {"Celeb-real": 0, "YouTube-real": 0, "Celeb-synthesis": 1}
IDENTITY_PATTERN = r"(id\d+)"
# --- end of fixed values ----------------------------------------------------


def unix_path(path: Column | str) -> Column:
    return F.replace(c(path), F.lit("\\"), F.lit("/"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(c(path), "/", -1)


def parent_name(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.split(unix_path(path), "/"), F.lit(-2)), F.lit(""))


def stem(path: Column | str) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(unix_path(path)), r"(?<=[^.])\.[^.]*$", "")


def mentions_any(path: Column | str, tokens: Sequence[str]) -> Column:
    low = F.lower(c(path))
    hit = F.lit(False)
    for t in tokens:
        hit = hit | low.contains(t)
    return hit


def category(path: Column | str) -> Column:
    """First category name the path contains, else ``Unknown``."""
    low = F.lower(unix_path(path))
    found = [F.when(low.contains(name.lower()), F.lit(name)) for name in CATEGORIES]
    return F.coalesce(*found, F.lit("Unknown"))


def clip_label(path: Column | str) -> Column:
    """0 real, 1 fake; an unknown category is real only if its file name says so."""
    cat = category(path)
    base = F.lower(base_name(path))
    named_real = base.contains("real") & ~base.contains("fake")
    return F.when(cat == CATEGORIES[0], 0).when(cat != "Unknown", 1).when(named_real, 0).otherwise(1)


def video_label(cat: Column | str) -> Column:
    return F.lower(c(cat)).contains("fakevideo").cast("int")


def audio_label(cat: Column | str) -> Column:
    return F.lower(c(cat)).contains("fakeaudio").cast("int")


def any_fake(video: Column | str, audio: Column | str) -> Column:
    return F.least(F.greatest(c(video) + c(audio), F.lit(0)), F.lit(1))


def category_of(video: Column | str, audio: Column | str) -> Column:
    """Category name of two binary decisions."""
    v = F.when(c(video) == 1, "FakeVideo").otherwise("RealVideo")
    a = F.when(c(audio) == 1, "FakeAudio").otherwise("RealAudio")
    return F.concat(v, F.lit("-"), a)


def category_code(cat: Column | str) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in CATEGORY_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, c(cat)), F.lit("UNK"))


def sample_key(cat: Column | str, group: Column | str, path: Column | str) -> Column:
    """Collision-resistant clip key: code, group, text before the first dot, path hash."""
    head = F.substring_index(base_name(path), ".", 1)
    return F.concat_ws("_", category_code(cat), c(group), head, F.substring(F.md5(unix_path(path)), 1, 8))


def number_runs(path: Column | str) -> Column:
    return F.regexp_extract_all(stem(path), F.lit(r"(\d+)"), 1)


def target_id(path: Column | str) -> Column:
    """First digit run of the file name, or the whole stem when it has none."""
    return F.coalesce(F.try_element_at(number_runs(path), F.lit(1)), stem(path))


def source_id(path: Column | str) -> Column:
    return F.try_element_at(number_runs(path), F.lit(2))


def identity_tokens(path: Column | str) -> Column:
    """Sorted distinct id tokens of parent folder and file name, else the folder."""
    parent = F.lower(parent_name(path))
    base = F.lower(base_name(unix_path(path)))
    ids = F.array_sort(
        F.array_union(
            F.regexp_extract_all(parent, F.lit(IDENTITY_PATTERN), 1),
            F.regexp_extract_all(base, F.lit(IDENTITY_PATTERN), 1),
        )
    )
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.concat(F.lit("folder::"), parent)))


def pair_tokens(path: Column | str) -> Column:
    """Sorted distinct identity tokens of a target/source file name."""
    ids = F.array_compact(F.array(target_id(path), source_id(path)))
    return F.array_sort(F.array_distinct(F.transform(ids, lambda i: F.concat(F.lit("ff::"), i))))


def folder_label(path: Column | str) -> Column:
    """Label given by a labelled folder anywhere in the path, else NULL."""
    p = unix_path(path)
    return F.coalesce(*[F.when(p.contains(f"/{f}/"), F.lit(y)) for f, y in LABELLED_FOLDERS.items()])
