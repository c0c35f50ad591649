"""Benchmark decontamination by the exact weighted similarity of item-sized windows, with their SimHash distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.text import LAST_ID, identified
from corpuslens.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
SENT_SHINGLES = 250_000  # rare shingles of items sent to all tasks at once, some 10 MB


def _words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, size: int) -> Column:
    """The runs of ``size`` words of an array, as strings."""
    n = F.size(words) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(F.col(words), i, size), " "))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def _fingerprints(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, print): bit b is set if more of the shingles of ``words`` have bit b than not."""
    h = rows.select(*by, F.explode(_shingles("words", size)).alias("_shingle")).withColumn("_h", F.xxhash64("_shingle"))
    signed = [F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_b{b}") for b in range(64)]
    sums = h.groupBy(*by).agg(*signed)
    bits = F.array(*[F.when(F.col(f"_b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b in range(64)])
    return sums.select(*by, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)).alias("print"))


def _runs(words: str, at: str, size: int) -> Column:
    """Hash of the ``size`` words from place ``at``."""
    return F.xxhash64(*[F.get(F.col(words), F.col(at) + j) for j in range(size)])


def _places(docs: DataFrame, size: int, *more: str) -> DataFrame:
    """(id, key, length, _i, _h): every run of ``size`` words, by its first word's place."""
    length = F.size("words")
    rows = docs.filter(length >= size).select("id", "key", "words", *more, length.alias("length"), F.explode(F.sequence(F.lit(0), length - size)).alias("_i"))
    return rows.select("id", "key", *more, "length", "_i", _runs("words", "_i", size).alias("_h"))


def _wanted(items: DataFrame, size: int, similarity: float) -> DataFrame:
    """(item, n, _h, _w, _rare): the shingles of items with their weights; the rare ones find the documents.

    An item of weight m and a window 0.8 alike share 0.8 * m at least, so of
    any shingles of the item that weigh more than the rest together one is in
    the window.  Those that fewest items hold are chosen: a sentence that all
    items share finds nothing by itself.
    """
    parts = items.select("item", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("_q"))
    weighed = parts.select("item", "n", _runs("words", "_q", size).alias("_h")).groupBy("item", "n", "_h").agg(F.count(F.lit(1)).cast("int").alias("_w"))
    held = weighed.groupBy("_h").agg(F.count(F.lit(1)).alias("_items"))
    rarest = W.partitionBy("item").orderBy("_items", "_h").rowsBetween(W.unboundedPreceding, -1)
    total = F.col("n") - size + 1
    missing = total - F.ceil(similarity * total - 1e-9)
    before = F.coalesce(F.sum("_w").over(rarest), F.lit(0))
    return weighed.join(held, "_h").select("item", "n", "_h", "_w", (before <= missing).alias("_rare"))


def _best_windows(docs: DataFrame, items: DataFrame, size: int, similarity: float, sent_shingles: int) -> DataFrame:
    """(id, key, item, at, similarity): the best window of a document for each item it holds.

    Shingles of documents meet the rare ones of items (``_wanted``) by 64-bit
    hash, which gives the pairs (document, item) that can match; only for them
    all shingles of the item are met.  Of a shingle with weight w in the item,
    the first w places in a window count; so a place counts for the windows
    that reach it and start after the place w before it: a run of ``at``.
    Where most runs overlap is the best window.  All windows are compared, each
    exactly, and the work is that of sorting the places met.  Up to
    ``sent_shingles`` rare shingles are sent to all tasks; more are joined as
    Spark sees fit.
    """
    wanted = cut_lineage(_wanted(items, size, similarity), "wanted")
    rare = wanted.filter("_rare").select("item", "_h")
    if rare.count() <= sent_shingles:
        rare = F.broadcast(rare)
    # A set, as equal rows are one document.
    worded = docs.select("id", "key", _words().alias("words"))
    held = _places(worded, size).join(rare, "_h").groupBy("id", "key").agg(F.collect_set("item").alias("items"))
    # Stored, so that Spark knows its size and shuffles texts only where it is too large to send.
    held = cut_lineage(held, "held")
    known = docs.join(held, ["id", "key"]).dropDuplicates(["id", "key"]).select("id", "key", _words().alias("words"), "items")
    places = _places(known, size, "items").select("id", "key", "length", "_i", "_h", F.explode("items").alias("item"))
    met = places.join(wanted.drop("_rare"), ["item", "_h"]).groupBy("id", "key", "length", "item", "n").agg(
        F.collect_list(F.struct("_h", "_i", "_w")).alias("_places")
    )
    width = F.least("n", "length")
    totals = F.col("n") + width - 2 * size + 2
    enough = met.filter(F.size("_places") >= F.ceil(totals * similarity / (1 + similarity) - 1e-9))
    placed = enough.withColumn("_places", F.sort_array("_places"))

    def interval(x: Column, k: Column) -> Column:
        before = F.get(F.col("_places"), k - x["_w"])  # null if out of the array
        after = F.when(before["_h"] == x["_h"], before["_i"] + 1).otherwise(0)
        low = F.greatest(F.lit(0), after, x["_i"] - (width - size))
        return F.struct(low.alias("low"), F.least(x["_i"], F.col("length") - width).alias("high"))

    runs = placed.select("id", "key", "item", totals.alias("_totals"), F.transform("_places", interval).alias("_runs"))
    ends = runs.withColumn("_runs", F.filter("_runs", lambda r: r["low"] <= r["high"])).withColumn("_ends", F.sort_array(F.concat(
        F.transform("_runs", lambda r: F.struct(r["low"].alias("at"), F.lit(1).alias("step"))),
        F.transform("_runs", lambda r: F.struct((r["high"] + 1).alias("at"), F.lit(-1).alias("step"))),
    )))

    def sweep(a: Column, e: Column) -> Column:
        now = a["now"] + e["step"]
        more = now > a["common"]
        return F.struct(
            now.alias("now"), F.when(more, now).otherwise(a["common"]).alias("common"), F.when(more, e["at"]).otherwise(a["at"]).alias("at")
        )

    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("common"), F.lit(0).alias("at"))
    top = ends.select("id", "key", "item", "_totals", F.aggregate("_ends", none, sweep).alias("_top"))
    like = F.col("_top.common") / (F.col("_totals") - F.col("_top.common"))
    return top.select("id", "key", "item", F.col("_top.at").alias("at"), like.alias("similarity")).filter(F.col("similarity") >= similarity)


def _itemized(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n, item, size)"""
    items = benchmark.select("item_id", _words().alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    # An item_id with several texts is as many items.
    items = items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    return cut_lineage(items.withColumn("size", F.least(F.lit(SHINGLE), F.col("n"))), "items")


def _sizes(items: DataFrame) -> list[int]:
    return sorted(r[0] for r in items.select("size").distinct().limit(SHINGLE).collect())


def _found(docs: DataFrame, items: DataFrame, similarity: float, sent_shingles: int) -> DataFrame | None:
    """``_best_windows`` of all items; None if there are no items."""
    found = None
    for size in _sizes(items):
        part = _best_windows(identified(docs), items.filter(F.col("size") == size), size, similarity, sent_shingles)
        found = part if found is None else found.unionByName(part)
    return found


def matches(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, sent_shingles: int = SENT_SHINGLES
) -> DataFrame:
    """(doc_id, key, item_id, at, distance, similarity): the best window of a document for each item it holds.

    Words are lower-cased runs of letters and digits; shingles have five words,
    an item of fewer words is one shingle; weights are numbers of occurrences,
    and the similarity of a window and an item is the sum of the lesser weights
    over the sum of the greater ones.  A window is as long as its item, or the
    whole of a shorter document, and may start anywhere; see ``_best_windows``
    for the search.  ``distance`` is the Hamming distance of the SimHash
    fingerprints of the window and the item; it decides nothing.

    Null and wordless texts and items match nothing; a null doc_id is kept as
    null; ``key`` is a hash of the text, for tables where doc_ids repeat; equal
    rows give one match; the smallest ``at`` wins ties.  The benchmark may be
    of any size.
    """
    items = _itemized(benchmark)
    found = _found(docs, items, similarity, sent_shingles)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, key bigint, item_id bigint, at int, distance int, similarity double")
    found = cut_lineage(found, "windows")
    texts = identified(docs).join(found, ["id", "key"])
    out = None
    for size in _sizes(items):
        prints = _fingerprints(items.filter(F.col("size") == size), ["item", "item_id", "n"], size).withColumnRenamed("print", "_print")
        held = texts.join(prints, "item")
        held = held.withColumn("words", F.slice(_words(), F.col("at") + 1, F.col("n")))
        # Equal rows of documents add up to the same signs.
        part = _fingerprints(held, ["id", "key", "item", "item_id", "at", "similarity", "_print"], size)
        out = part if out is None else out.unionByName(part)
    return out.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "key", "item_id", "at",
        F.bit_count(F.col("print").bitwiseXOR(F.col("_print"))).alias("distance"), "similarity",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with their own columns."""
    found = _found(docs, _itemized(benchmark), SIMILARITY, SENT_SHINGLES)
    if found is None:
        return docs
    bad = cut_lineage(found.select(F.col("id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct(), "contaminated")
    given = [F.col(f"_given.{c}") for c in docs.columns]
    packed = docs.select(
        F.struct(*docs.columns).alias("_given"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_key")
    )
    kept = packed.join(bad, (F.col("_id") == F.col("_bad_id")) & (F.col("_key") == F.col("_bad_key")), "left_anti")
    return kept.select(*given)
