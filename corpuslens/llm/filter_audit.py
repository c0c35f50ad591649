"""How filters overlap, by truth-table survival words and carry-save positional popcounts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import LAST_ID, chunks
from corpuslens.session import cut_lineage

# The filters, in the order of their bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

SUBSETS = 1 << len(FILTERS)
HELD_PARTS = 4096  # parts a task counts before it hands its counts on

#: Bit s of word f: a document that fails the filters of mask f survives the subset s, as no filter is in both.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of some 32-bit words have each bit set.

    Carry-save adders turn three words of one weight into a sum word of that
    weight and a carry word of twice the weight, for all triples and all 32
    bits at once, until two words at most are left of each weight.
    """
    counts = np.zeros(32, np.int64)
    weight, now = 1, words.astype(np.uint32, copy=False)
    while len(now):
        carries = [now[:0]]
        while len(now) > 2:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            now = np.concatenate([half ^ c, now[3 * third :]])
        for word in now.tolist():
            counts += weight * ((word >> np.arange(32)) & 1)
        now, weight = np.concatenate(carries), weight * 2
    return counts


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, part, mask, digest) of whole texts; the mask lacks the last filter, which other texts decide."""
    for frame in chunks(frames):
        masks, digests = [], []
        for text in frame["text"]:
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()  # at ASCII white space
            n, distinct = len(words), len(set(words))
            masks.append(
                (n < LEAST_WORDS)
                | (100 * distinct < LEAST_DISTINCT * n) << 1
                | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
                | (len(raw.translate(None, MARKS)) < len(raw)) << 3
            )
            digests.append(hashlib.sha256(raw).digest())
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "part": frame["part"].to_numpy(), "mask": masks, "digest": digests})


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, survivors, good, toxic): for each subset the documents, good ones and toxic ones that survive it."""
    held: dict[str, np.ndarray] = {}

    def rows() -> pd.DataFrame:
        table = {"part": list(held)}
        for k, name in enumerate(("survivors", "good", "toxic")):
            table[name] = [c[k] for c in held.values()]
        return pd.DataFrame(table)

    for frame in frames:
        words = SURVIVAL[frame["mask"].to_numpy()]
        part, names = pd.factorize(frame["part"])
        order = np.argsort(part, kind="stable")
        limits = np.searchsorted(part[order], np.arange(len(names) + 1))
        good, toxic = frame["good"].to_numpy(bool), frame["toxic"].to_numpy(bool)
        for p, name in enumerate(names):
            mine = order[limits[p] : limits[p + 1]]
            counts = held.setdefault(name, np.zeros((3, SUBSETS), np.int64))
            for k, chosen in enumerate((mine, mine[good[mine]], mine[toxic[mine]])):
                counts[k] += positional_popcount(words[chosen])
        if len(held) >= HELD_PARTS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _orders() -> pd.DataFrame:
    """(filter_order, step, filter, before, after) of all orders; before and after are sets of filters as masks."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[g] for g in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return pd.DataFrame(rows, columns=["filter_order", "step", "filter", "before", "after"])


def _audited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All orders and steps of each part, read off the subsets' survivors."""
    orders, n = _orders(), len(FILTERS)
    f, before, after = (orders[c].to_numpy() for c in ("filter", "before", "after"))
    alone, whole = 1 << f, SUBSETS - 1
    shares = np.zeros((n, SUBSETS), np.int64)  # in how many orders a subset stands before a filter
    for g in range(n):
        for s in range(SUBSETS):
            if not s >> g & 1:
                k = s.bit_count()
                shares[g, s] = factorial(k) * factorial(n - 1 - k)
    sets = np.arange(SUBSETS)
    for frame in frames:
        for part, survivors, good, toxic in zip(frame["part"], frame["survivors"], frame["good"], frame["toxic"], strict=True):
            s, g, t = np.asarray(survivors), np.asarray(good), np.asarray(toxic)
            removed = s[before] - s[after]
            shapley = np.array([(shares[k] * (s - s[sets | 1 << k])).sum() for k in range(n)])
            yield pd.DataFrame({
                "part": part, "filter_order": orders["filter_order"], "step": orders["step"], "kept": s[after], "removed": removed,
                "redundant": s[0] - s[alone] - removed, "unique_fails": s[whole ^ alone] - s[whole],
                "good_lost": g[before] - g[after], "toxic_lost": t[before] - t[after], "shapley": shapley[f],
            })


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, survivors, good, toxic): arrays of counts by subset of the filters, bit i of an index for filter i."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    judged = cut_lineage(slim.mapInPandas(_judged, "id bigint, part string, mask int, digest binary"), "judged")
    # The first document of each text is named with its id, so that a text of very many copies makes no hot key.
    first = judged.groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = judged.join(first, ["id", "digest"], "left").join(marks, "id", "left").select(
        "part",
        F.when(F.col("_first"), F.col("mask")).otherwise(F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
    )
    partial = known.mapInPandas(_counted, "part string, survivors array<bigint>, good array<bigint>, toxic array<bigint>")
    kinds = ("survivors", "good", "toxic")
    sums = [F.sum(F.get(c, F.lit(s))).alias(f"_{c}{s}") for c in kinds for s in range(SUBSETS)]
    return partial.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"_{c}{s}") for s in range(SUBSETS)]).alias(c) for c in kinds])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each of the 120 orders, per part: 600 rows for each source.

    A document becomes a word with a bit for every subset of the filters: set
    if it survives them all.  The number of documents of a part that survive
    each subset, counted by ``positional_popcount`` inside the tasks, is all
    that any order and step needs.  Filters: A fewer than 200 words, B fewer
    than half of the words distinct, C more than 2 % capitals A-Z among the
    code points, D one of ``#$%&*|``, E the text of a document with a smaller
    doc_id anywhere in the table.

    Columns: part (the source, null as the empty string), filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (a
    sum over all orders).  A null text is the empty text.  A null doc_id comes
    after all others and has no label; rows equal in doc_id and text don't
    fail E for each other, and each counts.  A doc_id with several label rows
    is good, or toxic, if one of them says so.  An empty table gives no rows;
    other columns aren't read.
    """
    kinds = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return survivors(docs, labels).mapInPandas(_audited, f"part string, filter_order string, step int, {kinds}")
