"""Near duplicates by DartMinHash signatures of weighted word shingles."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import LAST_ID, chunks, given_id, identified, mix, scan
from corpuslens.operators.identity import components
from corpuslens.session import cut_lineage, discard

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4  # a pair 0.8 alike shares no band with probability 3e-6
SMALL_BUCKET = 16  # members; all pairs of such a bucket are compared at once
FIRST_REPRESENTATIVES = 2  # members of a larger bucket that are compared with all others in the first round
MORE_REPRESENTATIVES = 16  # times as many in each later round
GROUPS = 32  # of shingles, for the bound on what two texts have in common
KEPT_SHINGLES = 400_000  # about 100 MB

_SEED = np.uint64(0xD1B54A32D192ED03)
_UNIT = 1.0 / (1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def _region(number: int) -> tuple[float, float]:
    """Ranks are cut at 0, 1/4, 1/2, 1, 2, 4, 8, 16, 32, 48, 64, ...: few regions for any text, few darts in each."""
    cuts = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
    return (cuts[number], cuts[number + 1]) if number < 7 else (16.0 * (number - 6), 16.0 * (number - 5))


def _poisson_limits(mean: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2, ... darts, up to where doubles end."""
    terms = [math.exp(-mean)]
    for k in range(1, 100):
        terms.append(terms[-1] * mean / k)
    return np.cumsum(terms)


def earliest_darts(
    doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """(dart, rank) arrays of shape (n_docs, size): the earliest dart of each coordinate.

    Darts fall on (element, weight, rank) with one per unit of volume on
    average; where they fall depends on the element alone.  A document owns
    the darts below its elements' weights, so two documents agree in a
    coordinate with probability sum(min) / sum(max) of their weights.  Ranks
    are thrown up to t / total weight, which gives t = k ln k + 2 k darts, and
    up to twice as high for documents that still lack a coordinate.
    """
    best = np.full(n_docs * size, np.inf)
    dart = np.zeros(n_docs * size, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    wanted = size * math.log(size) + 2 * size
    limit = np.where(total > 0, wanted / np.maximum(total, 1), 0.0)
    # One unit cell per unit of weight: cell c of an element is the same in every document.
    cell_of = np.repeat(np.arange(len(element)), weight)
    cell_doc = doc[cell_of]
    number = np.arange(len(cell_of)) - np.repeat(np.cumsum(weight) - weight, weight)
    cell = mix(element[cell_of] + _SEED * (number.astype(np.uint64) + np.uint64(1)))
    low_limit = np.zeros(n_docs)  # up to here all darts have been thrown
    while True:
        region = 0
        left = np.flatnonzero(limit[cell_doc] > 0)  # cells whose document reaches this region
        while len(left):
            low, high = _region(region)
            here = left[low_limit[cell_doc[left]] < high]
            left = left[limit[cell_doc[left]] > high]
            h = mix(cell[here] ^ mix(np.array([2 * region + 3], np.uint64)))
            count = np.searchsorted(_poisson_limits(high - low), _uniform(h), "right")
            owner = np.repeat(here, count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            thrown = mix(np.repeat(h, count) + _SEED * (nth.astype(np.uint64) + np.uint64(1)))
            rank = low + (high - low) * _uniform(mix(thrown ^ _SEED))
            slot = cell_doc[owner] * size + (mix(thrown + _SEED) % np.uint64(size)).astype(np.int64)
            ok = np.flatnonzero(rank < limit[cell_doc[owner]])
            ok = ok[np.argsort(-rank[ok], kind="stable")]  # the earliest is written last
            ok = ok[rank[ok] < best[slot[ok]]]
            best[slot[ok]], dart[slot[ok]] = rank[ok], thrown[ok]
            region += 1
        lacking = np.isinf(best.reshape(n_docs, size)).any(1) & (total > 0)
        if not lacking.any():
            return dart.reshape(n_docs, size), best.reshape(n_docs, size)
        low_limit = limit
        limit = np.where(lacking, limit * 2, 0.0)


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle hash, weight), sorted: five lower-cased words, or all words of a shorter text."""
    words = scan(texts, lower=True)
    hashes = words.hashes()
    runs, whole = words.runs(hashes, SHINGLE)
    doc, element = words.doc[: len(runs)][whole], runs[whole]
    count = np.diff(words.first)
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        a, b = words.first[d], words.first[d + 1]
        h = np.uint64(b - a)
        for x in hashes[a:b]:
            h = mix(np.array([h ^ x]))[0]
        doc, element = np.append(doc, d), np.append(element, h)
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return doc[at], element[at], np.diff(np.append(at, len(doc)))


def _signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, key, total weight, bands) of texts with words; bands are hashes of ROWS coordinates each."""
    for frame in chunks(frames):
        doc, element, weight = weighted_shingles(frame["text"].tolist())
        if not len(doc):
            continue
        used, doc = np.unique(doc, return_inverse=True)
        dart, _ = earliest_darts(doc, element, weight, len(used), BANDS * ROWS)
        parts = dart.reshape(len(used), BANDS, ROWS)
        key = np.zeros((len(used), BANDS), np.uint64)
        for r in range(ROWS):
            key = mix(key + parts[:, :, r])
        total = np.bincount(doc, weight, len(used)).astype(np.int64)
        names = {c: frame[c].to_numpy()[used] for c in ("id", "key")}
        yield pd.DataFrame(names | {"total": total, "bands": list(key.view(np.int64))})


def _shingle_counts(text: str) -> Counter:
    # The same words as scan() makes.
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if len(words) < SHINGLE:
        return Counter([tuple(words)])
    return Counter(zip(*[words[j:] for j in range(SHINGLE)], strict=False))


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (a.total() + b.total() - common)


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) of pairs that are alike enough; the shingles of texts just seen are kept, up to KEPT_SHINGLES of them."""
    kept, held = {}, 0

    def shingles(number: int, text: str) -> Counter:
        nonlocal held
        if number not in kept:
            if held > KEPT_SHINGLES:
                kept.clear()
                held = 0
            kept[number] = _shingle_counts(text)
            held += len(kept[number])
        return kept[number]

    for frame in frames:
        keep = [
            weighted_similarity(shingles(a, text_a), shingles(b, text_b)) >= SIMILARITY
            for a, b, text_a, text_b in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True)
        ]
        yield frame.loc[keep, ["a", "b"]]


def _shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, class, total, shingle, weight) of whole texts."""
    for frame in chunks(frames):
        doc, element, weight = weighted_shingles(frame["text"].tolist())
        columns = {c: frame[c].to_numpy()[doc] for c in ("id", "class", "total")}
        yield pd.DataFrame(columns | {"shingle": element.view(np.int64), "weight": weight})


def _enough(common: Column, totals: Column) -> Column:
    """Whether texts of these total weights together can be alike enough with that much in common."""
    # A thousandth of a shingle, so that rounding drops no link.
    return common + 0.001 >= SIMILARITY / (1 + SIMILARITY) * totals


def _may_link(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members that a member of another class can be alike enough to, with what bounds their overlaps.

    Linked texts of total weights x and y have SIMILARITY / (1 + SIMILARITY) *
    (x + y) in common, or more, and y is at least SIMILARITY * x and the least
    total of the bucket.  So a text leaves a bucket if its shingles that occur
    in another class too weigh less: it has too many edits of its own.  Those
    shingles are dealt into GROUPS by hash; ``_g<i>`` is their weight in each.
    """
    ids = cut_lineage(members.select("id", "class", "total").distinct(), "open_ids")
    rows = texts.join(ids, "id").select("id", "class", "total", "text")
    rows = cut_lineage(rows.mapInPandas(_shingled, "id bigint, class bigint, total bigint, shingle bigint, weight bigint"), "shingles")
    spread = rows.groupBy("shingle").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).filter("_low != _high")
    group = F.pmod(F.xxhash64("shingle"), F.lit(GROUPS))
    common = rows.join(spread.select("shingle"), "shingle").withColumn("_group", group).groupBy("id", "total").agg(
        F.sum("weight").alias("_common"), *[F.sum(F.when(F.col("_group") == g, F.col("weight")).otherwise(0)).cast("int").alias(f"_g{g}") for g in range(GROUPS)]
    )
    common = cut_lineage(common.filter(F.col("_common") + 0.001 >= SIMILARITY * F.col("total")).drop("total"), "common")
    discard(rows, ids)
    least = members.groupBy("bucket").agg(F.min("total").alias("_least"))
    partner = F.greatest(F.col("_least"), SIMILARITY * F.col("total"))
    fit = members.join(common, "id").join(least, "bucket").filter(_enough(F.col("_common"), F.col("total") + partner))
    out = cut_lineage(fit.drop("_common", "_least"), "open_rows")
    discard(common)
    return out


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their texts."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    checked = both.sortWithinPartitions("a").select("a", "b", "text_a", "text_b")
    return checked.mapInPandas(_verified, "a bigint, b bigint")


def _leaders(members: DataFrame, slices: int, columns: list[str]) -> DataFrame:
    """At most ``slices`` members of each bucket, those of the most links first; columns as <name>_a."""
    by = F.struct("degree", F.xxhash64("id", F.lit(1)), *columns)
    best = members.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(slices)).alias("_slice")).agg(F.max(by).alias("_a"))
    return best.select("bucket", *[F.col(f"_a.{c}").alias(f"{c}_a") for c in columns])


def _links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, class) of linked texts, from members (bucket, id, total, n), n the members of the bucket.

    A bucket of SMALL_BUCKET members is compared whole.  A larger one is taken
    in rounds: a few members are compared with the members of other classes
    there; then classes grow along the links found.  Members of one class need
    no comparison any more, and those with most links so far are asked first,
    because what many texts resemble joins the rest.  The rounds end when
    every bucket is of one class or all its members have been asked; so no
    link between classes is missed.  From the second round on, texts that
    can't have another link go first (``_may_link``), and two texts become a
    pair only if the lesser weights of their shared groups of shingles add up
    to what a link needs.  Both bounds are exact, so a bucket of many texts
    that are a little less alike isn't paired out.
    """
    texts = texts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    texts = cut_lineage(texts, "texts", "zstd")
    # The similarity can't be above the ratio of the total weights.
    may = F.least("total", "total_a") >= SIMILARITY * F.greatest("total", "total_a")
    pair = [F.least("id_a", "id").alias("a"), F.greatest("id_a", "id").alias("b")]

    small = F.col("n") <= SMALL_BUCKET
    large = cut_lineage(members.filter(~small).drop("n"), "large")
    some = not large.isEmpty()
    whole = members.filter(small).select("bucket", "id", "total")
    asking = whole.select("bucket", F.col("id").alias("id_a"), F.col("total").alias("total_a"))
    pairs = whole.join(asking, "bucket").filter((F.col("id") < F.col("id_a")) & may).select(*pair)
    asked = None
    if some:
        fresh = large.withColumn("degree", F.lit(0).cast("bigint"))
        asked = cut_lineage(_leaders(fresh, FIRST_REPRESENTATIVES, ["id", "total"]), "asked")
        pairs = pairs.unionByName(large.join(asked, "bucket").filter((F.col("id") != F.col("id_a")) & may).select(*pair))
    pairs = cut_lineage(pairs.distinct(), "pairs")
    links = cut_lineage(_checked(pairs, texts), "links")
    discard(pairs)
    slices, classes = FIRST_REPRESENTATIVES, None
    while True:
        degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        linked = components(links).select(F.col("token").alias("id"), F.col("component").alias("class"))
        old, classes = classes, cut_lineage(linked.join(degrees, "id"), "classes")
        discard(old)
        while some:
            now = large.join(classes, "id", "left").withColumns(
                {"class": F.coalesce("class", F.col("id")), "degree": F.coalesce("degree", F.lit(0))}
            )
            # A member asked earlier has met all others, so only the rest goes on.
            rest = now.join(asked.select("bucket", F.col("id_a").alias("id")), ["bucket", "id"], "left_anti")
            rest = cut_lineage(rest, "rest")
            mixed = rest.groupBy("bucket").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).filter("_low != _high")
            members = _may_link(rest.join(mixed.select("bucket"), "bucket"), texts)
            discard(rest, large, asked)
            slices *= MORE_REPRESENTATIVES
            weights = [f"_g{g}" for g in range(GROUPS)]
            large = members.select("bucket", "id", "total")
            asked = cut_lineage(_leaders(members, slices, ["id", "class", "total", *weights]), "asked")
            if asked.isEmpty():
                some = False
                break
            shared = sum((F.least(g, f"{g}_a") for g in weights), F.lit(0))
            met = members.join(asked, "bucket").filter(
                (F.col("class") != F.col("class_a")) & may & _enough(shared, F.col("total") + F.col("total_a"))
            )
            pairs = cut_lineage(met.select(*pair).distinct(), "pairs")
            found = cut_lineage(_checked(pairs, texts), "links")
            discard(pairs)
            large = cut_lineage(large, "large")
            discard(members)
            if not found.isEmpty():
                more = cut_lineage(links.unionByName(found), "links")
                discard(links, found)
                links = more
                break
            discard(found)
        if not some:
            break
    discard(texts)
    return classes.select("id", "class")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(id, key, class, kept): a row per distinct (doc_id, text), with the class it is in; see ``near_duplicates``."""
    rows = identified(docs)
    # Equal texts are one element from here on, however many copies there are.
    content = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.md5("text"))
    copies = cut_lineage(rows.select("id", "key", content.alias("content")).distinct(), "copies")
    firsts = cut_lineage(copies.filter("content is not null").groupBy("content").agg(F.min(F.struct("id", "key")).alias("f")).select("content", "f.id", "f.key"), "firsts")
    # A doc_id may stand for several texts; inside, each distinct text has a number of its own.
    coded = cut_lineage(firsts.withColumn("code", F.monotonically_increasing_id()), "coded")
    discard(firsts)
    codes = coded.select("id", "key", "code")
    signed = rows.mapInPandas(_signed, "id bigint, key bigint, total bigint, bands array<bigint>")
    signed = signed.join(codes, ["id", "key"]).select(F.col("code").alias("id"), "total", "bands").dropDuplicates(["id"])
    banded = signed.select("id", "total", F.posexplode("bands").alias("band", "value"))
    banded = cut_lineage(banded.select("id", "total", F.xxhash64("band", "value").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(banded.join(cut_lineage(shared, "shared"), "bucket"), "members")
    discard(banded)
    classes = _links(members, rows.join(codes, ["id", "key"]).select(F.col("code").alias("id"), "text"))
    discard(members)
    linked = coded.join(classes.withColumnRenamed("id", "code"), "code", "left").select(
        "content", "id", "key", F.coalesce("class", "code").alias("_class")
    )
    lowest = cut_lineage(linked.groupBy("_class").agg(F.min(F.struct("id", "key")).alias("_f")).select("_class", F.col("_f.id").alias("class"), F.col("_f.key").alias("first_key")), "lowest")
    named = cut_lineage(linked.join(lowest, "_class").select("content", "class", "first_key"), "named")
    discard(lowest, coded)
    out = copies.join(named, "content", "left")
    kept = F.col("class").isNull() | ((F.col("id") == F.col("class")) & (F.col("key") == F.col("first_key")))
    return out.select("id", "key", F.coalesce("class", "id").alias("class"), kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept), a row per document; near duplicates share class_id, the smallest doc_id among them.

    Two texts are linked if their multisets of five-word shingles (lower-cased
    words between ASCII white space; a shorter text is one shingle) have a
    weighted Jaccard similarity of 0.8 or more; classes are the connected
    texts.  Candidates come from bands of DartMinHash signatures, and each link
    is checked on the texts.  ``kept`` marks one document of each class, that
    of the smallest doc_id.  Equal texts are one class whatever their number.
    A null or wordless text is in no class but its document's own.  Rows equal
    in doc_id and text are one document and one row.  A null doc_id comes
    after all others, and stays null as a class_id.  Other columns aren't
    read; an empty table gives no rows.
    """
    classes = near_duplicate_classes(docs)
    return classes.select(given_id().alias("doc_id"), given_id("class").alias("class_id"), "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates, with its own columns; of rows equal in doc_id and text one stays."""
    kept = near_duplicate_classes(docs).filter("kept").select(F.col("id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    kept = cut_lineage(kept, "kept")
    packed = docs.select(
        F.struct(*docs.columns).alias("_given"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_id"), F.xxhash64("text").alias("_key")
    )
    names = packed.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id", "_key")
    twice = cut_lineage(names, "twice")
    stay = packed.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    given = [F.col(f"_given.{c}") for c in docs.columns]
    if twice.isEmpty():
        return stay.select(*given)
    once = stay.join(twice, ["_id", "_key"], "left_anti").select("_given")
    # Of repeated rows the least stays, so that a retry keeps the same one.
    least = stay.join(twice, ["_id", "_key"]).groupBy("_id", "_key").agg(F.min("_given").alias("_given")).select("_given")
    return once.unionByName(least).select(*given)
