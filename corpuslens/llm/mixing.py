"""Mixing sources to target weights by whole copies and one seeded coin per document, drawn systematically."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.hashing import tag_hash, uniform
from corpuslens.llm.order import numbered
from corpuslens.llm.text import word_count
from corpuslens.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0  # no source, and no document, is taken more often than this


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources get the weights in order of code points, null last, over and over.
    Together the targets are as large as all sources; none is above ``most``
    times its source, and what that cuts off is shared again by weight.  The
    table of sources stays distributed: each round is one sum over it, and
    there is a round for each set of sources that reach their limit.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_rank")
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    table = cut_lineage(ranked.select("source", "source_size", by_rank.alias("_w")), "sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        # A source is at its limit as soon as its part of a share reaches it; shares only grow.
        at_limit = F.col("_w") * F.lit(share) >= limit
        n, used, open_weight = table.agg(
            F.sum(at_limit.cast("bigint")), F.sum(F.when(at_limit, F.col("source_size"))), F.sum(F.when(~at_limit, F.col("_w")))
        ).first()
        if n is None or n == full or not open_weight:
            break
        full, share = n, (total - most * (used or 0)) / open_weight
    return table.select("source", "source_size", F.least(F.col("_w") * F.lit(share), limit).alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_gone``, ``_name``, ``_id`` and ``_key``: the source, doc_id and text of a row, none of them null."""
    return docs.withColumns({
        "_gone": F.col("source").isNull(), "_name": F.coalesce("source", F.lit("")),
        "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_key": F.coalesce(F.md5("text"), F.lit("")),
    })


_UNIT = ["_gone", "_name", "_id", "_key"]


def copies(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """(_gone, _name, _id, _key, _source_size, _target, _copies) from rows (_gone, _name, _id, _key, _size).

    A source's rate is its target over its size.  Rows equal in source, doc_id
    and text are one unit and get equal copies: floor(rate), and one more with
    the rest as its probability.  The coins of a source aren't independent:
    its units stand in order of size (ties by a seeded hash), and unit k gets
    the copy if floor((k + 1) rest + u) is above floor(k rest + u), where u in
    [0, 1) is a seeded hash of the source.  For each unit alone that is a coin
    with probability ``rest``; together they take the source's target to
    within the size of its largest unit.  Reruns agree.
    """
    units = sized.groupBy(*_UNIT).agg((F.max("_size") * F.count(F.lit(1))).alias("_size"))
    units = units.withColumn("_h", tag_hash("mix", seed, "_id", "_key"))
    placed = numbered(units, [F.col(c) for c in ("_gone", "_name", "_size", "_h", "_id", "_key")], "_place")
    source = F.when(~F.col("_gone"), F.col("_name"))
    per_source = placed.groupBy("_gone", "_name").agg(F.sum("_size").alias("source_size"), F.min("_place").alias("_first"))
    per_source = cut_lineage(per_source.withColumn("source", source), "per-source")
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    known = targets.select(F.col("source").isNull().alias("_gone"), F.coalesce("source", F.lit("")).alias("_name"), F.col("target").alias("_target"))
    known = cut_lineage(per_source.drop("source").join(known, ["_gone", "_name"]), "targets")
    # Targets are a stored table, so Spark broadcasts it if small and else splits a hot source.
    rated = placed.join(known, ["_gone", "_name"]).withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("_target") / F.col("source_size")).otherwise(0.0)
    )
    rest, k = F.col("_rate") - F.floor("_rate"), F.col("_place") - F.col("_first")
    offset = uniform("mix-offset", seed, F.col("_gone").cast("string"), "_name")
    more = F.floor((k + 1) * rest + offset) - F.floor(k * rest + offset)
    return rated.select(*_UNIT, F.col("source_size").alias("_source_size"), "_target", (F.floor("_rate") + more).cast("int").alias("_copies"))


def _sized(docs: DataFrame) -> DataFrame:
    slim = _keyed(docs.select("doc_id", "source", "text")).withColumn("_size", word_count())
    return cut_lineage(slim.select("doc_id", *_UNIT, "_size"), "sized")


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row per document; see ``copies``.

    Null and wordless texts have size 0 and follow their source's rate;
    sources without words have rate 0; null is a source like others.  An empty
    table gives no rows; other columns aren't read.
    """
    sized = _sized(docs)
    return sized.join(copies(sized, weights, most, seed), _UNIT).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    taken = cut_lineage(copies(_sized(docs), weights, most, seed).filter("_copies > 0").select(*_UNIT, "_copies"), "taken")
    packed = _keyed(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_given"))).select("_given", *_UNIT)
    repeated = packed.join(taken, _UNIT).select("_given", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"))
    return repeated.select(*[F.col(f"_given.{c}") for c in docs.columns])
