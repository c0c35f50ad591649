"""Ordered running totals and ranks without a single-task window.

An ``ORDER BY`` window with no partition sends the whole table to one task,
and one partitioned by a skewed key sends that key to one task.  Both helpers
here first map every row to an order-preserving bucket, total the buckets (a
table bounded by the bucket count), and run the real window inside
(group, bucket), where a row count is about 1 / buckets of the table however
the groups are skewed.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.hashing import hash_uint, tag_hash
from corpuslens.session import cut_lineage, discard

_MIN_SIDE, _MAX_SIDE = 6, 64  # 36 .. 4096 buckets
TASK_ROWS = 1_000_000  # some 0.4 GB where a task sorts them twice


def bucket_side(spark: SparkSession) -> int:
    """Side of the two-level cut grid, sized from the configured parallelism."""
    want = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(_MIN_SIDE, min(_MAX_SIDE, math.isqrt(want - 1) + 1))


def cut_points(df: DataFrame, order: str, side: int, min_rows: int) -> Column:
    """Approximate quantile cuts as a scalar subquery (at most side**2 - 1 values).

    A table too small to fill that many buckets with ``min_rows`` rows gets
    every m-th cut only.  Returned as struct(fine, coarse) so a lookup costs
    2 * side comparisons.
    """
    n = side * side
    q = F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)
    step = F.greatest(F.lit(1), F.ceil(F.lit(n * min_rows) / F.greatest(F.count(order), F.lit(1))))
    cuts = df.agg(q.alias("all"), step.cast("int").alias("step"))
    kept = F.filter("all", lambda v, i: F.pmod(i + 1, F.col("step")) == 0)
    coarse = F.filter("fine", lambda v, i: i % side == side - 1)
    return cuts.select(kept.alias("fine")).select(F.struct("fine", coarse.alias("coarse")).alias("cuts")).scalar()


def group_cuts(df: DataFrame, by: Sequence[str], order: str, side: int, min_rows: int) -> DataFrame:
    """(by, _cuts): quantile cuts, as in :func:`cut_points`, of every group above 1 / side**2 of the rows.

    A group gets cuts in proportion to its rows, so all groups together have
    at most twice side**2 and their table may be broadcast; one too small for
    two pieces of ``min_rows`` rows is not cut.
    """
    n = side * side
    big = big_groups(df, by, n).filter(F.col("n_total") >= 2 * min_rows)
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    rows = df.select(*by, order).join(F.broadcast(big.select(*keys, "n_total", "_pieces")), same)
    q = F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)
    cuts = rows.groupBy(*by).agg(q.alias("all"), F.max("n_total").alias("_n"), F.max("_pieces").alias("_p"))
    step = F.greatest(F.ceil(F.lit(n) / F.col("_p")), F.ceil(F.lit(n * min_rows) / F.col("_n"))).cast("int")
    cuts = cuts.withColumn("step", step).select(*by, F.filter("all", lambda v, i: F.pmod(i + 1, F.col("step")) == 0).alias("fine"))
    coarse = F.filter("fine", lambda v, i: i % side == side - 1)
    return cuts.select(*by, F.struct("fine", coarse.alias("coarse")).alias("_cuts"))


def cut_bucket(x: Column, cuts: Column, side: int, inclusive: bool = False) -> Column:
    """Number of cut points below x (or up to x), found in two short scans."""

    def passed(v: Column) -> Column:
        return v <= x if inclusive else v < x

    hi = F.size(F.filter(cuts["coarse"], passed))
    lo = F.size(F.filter(F.slice(cuts["fine"], hi * side + 1, side - 1), passed))
    return (hi * side + lo).cast("int")


def with_cut_places(df: DataFrame, x: str, cuts: str, side: int) -> DataFrame:
    """``df`` with ``_below``, the number of cut points below x, and ``_same``, of those equal to it; both 0 where there are no cuts.

    Both are generated from one nested expression, because plain columns
    would be scanned again wherever they are used.
    """
    at, fine = F.col(x), F.col(cuts)["fine"]

    def below(v: Column) -> Column:
        return v < at

    def place(b: Column) -> Column:
        equal = F.when(F.get(fine, b) == at, cut_bucket(at, F.col(cuts), side, inclusive=True) - b)
        return F.struct(b.alias("_below"), F.coalesce(equal, F.lit(0)).cast("int").alias("_same"))

    high = F.array(F.size(F.filter(F.col(cuts)["coarse"], below)))
    count = F.transform(high, lambda h: (h * side + F.size(F.filter(F.slice(fine, h * side + 1, side - 1), below))).cast("int"))
    none = F.struct(F.lit(0).alias("_below"), F.lit(0).alias("_same"))
    found = F.when(F.col(cuts).isNull(), none).otherwise(F.get(F.transform(count, place), F.lit(0)))
    return df.select(*df.columns, F.inline(F.array(found)))


def bucket_starts(df: DataFrame, by: Sequence[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per (by, bucket): what came before it, and the group totals."""
    totals = df.groupBy(*by, bucket).agg(*[v.alias(k) for k, v in sums.items()])
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    out = [*[F.col(c) for c in by], F.col(bucket)]
    for k in sums:
        out += [
            F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}_start"),
            F.sum(k).over(whole).alias(f"{k}_total"),
        ]
    return totals.select(*out)


def running_totals(table: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_before`` (strictly lower ``order``) and ``<c>_total`` per group.

    ``table`` must hold one row per (by, order); aggregate ties first.  It is
    computed once and stored, then dealt into ranges of (by, order), so that a
    small group lies in one range and a big one in several.  Inside a range a
    window does the work; only groups that several ranges hold, fewer than
    twice the ranges, need what lies in the others, so their table may be
    broadcast.
    """
    by = list(by)
    once = cut_lineage(table, "scores")
    # Range bounds are sampled, so the ranges are written down too.
    ranged = cut_lineage(once.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    discard(once)
    parts = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    several = parts.withColumn("_ranges", F.count(F.lit(1)).over(group)).select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), "_ranges",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_start") for s in sums],
        *[F.sum(s).over(group).alias(f"_{s}_all") for s in sums],
    ).filter("_ranges > 1").drop("_ranges")
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = ranged.join(F.broadcast(several), same, "left")
    whole = W.partitionBy(*by, "_range")
    inside = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    for s in sums:
        joined = joined.withColumns({
            f"{s}_before": F.coalesce(f"_{s}_start", F.lit(0)) + F.coalesce(F.sum(s).over(inside), F.lit(0)),
            f"{s}_total": F.coalesce(F.col(f"_{s}_all"), F.sum(s).over(whole)),
        })
    return joined.select(*table.columns, *[c for s in sums for c in (f"{s}_before", f"{s}_total")])


def tasks_wanted(spark: SparkSession, rows: int = 0) -> int:
    """Into how many tasks a table is dealt: as configured, or more where a task would sort above ``TASK_ROWS`` of so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def deal(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of so many rows, dealt by columns; only a number of tasks that is not the configured one is fixed."""
    tasks, spark = tasks_wanted(df.sparkSession, rows), df.sparkSession
    return df.repartition(*by) if tasks == tasks_wanted(spark) else df.repartition(tasks, *by)


def pieces_wanted(spark: SparkSession, rows: int = 0) -> int:
    """Into how many pieces a whole table is cut; a group gets its share."""
    return max(32, min(10_000, 4 * tasks_wanted(spark, rows)))


def big_groups(df: DataFrame, by: Sequence[str], pieces: int) -> DataFrame:
    """(by, n_total, _pieces) of groups above 1 / pieces of the rows.

    There can be fewer than ``pieces`` such groups, so the result may be
    broadcast whatever the table's size.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    total = sizes.agg(F.sum("n_total")).scalar()
    big = sizes.withColumn("_all", total).filter(F.col("n_total") * pieces > F.col("_all"))
    return big.select(*by, "n_total", F.ceil(F.col("n_total") * pieces / F.col("_all")).alias("_pieces"))


def bucketed_rank(
    df: DataFrame,
    bucket: Callable[[Column], Column],
    order: Sequence[Column],
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    keep_below: Column | None = None,
    bounded: bool = False,
    rows: int = 0,
) -> DataFrame:
    """Exact 1-based rank per group.

    Only groups above 1 / pieces of the rows are cut up: ``bucket(pieces)``
    must be monotone in ``order`` (``bounded`` says it yields at most that many
    values).  Their buckets are counted first and start where the earlier ones
    end; every other group is one piece already.  All rows then shuffle once,
    by (group, bucket), and rank inside it.

    ``keep_below`` (an expression over ``n_total``, the group size, and ``by``)
    keeps ranks up to that number; buckets wholly above it are dropped before
    the shuffle.  ``rows``, the number of rows if it is known, gives a large
    table more pieces and tasks than are configured.
    """
    by, pieces = list(by), pieces_wanted(df.sparkSession, rows)
    if by:
        tagged = df.join(F.broadcast(big_groups(df, by, pieces).drop("n_total")), by, "left")
        tagged = tagged.withColumn(
            "_bucket", F.when(F.col("_pieces").isNull(), F.lit(-1)).otherwise(bucket(F.col("_pieces"))).cast("bigint")
        )
        cut = tagged.filter("_pieces is not null")
    else:
        tagged = cut = df.withColumn("_bucket", bucket(F.lit(pieces)).cast("bigint"))
    starts = bucket_starts(cut, by, "_bucket", {"n": F.count(F.lit(1))})
    if keep_below is not None:
        starts = starts.withColumn("_drop", F.col("_n_start") >= keep_below.cast("bigint"))
    # Hash buckets: at most two per piece over all big groups together.
    joined = tagged.join(F.broadcast(starts) if bounded else starts, [*by, "_bucket"], "left")
    if keep_below is not None:
        joined = joined.filter(~F.coalesce("_drop", F.lit(False))).drop("_drop")
    inside = W.partitionBy(*by, "_bucket")
    # Dealt here and not by the window, which would also deal what it orders by.
    joined = deal(joined, rows, *by, "_bucket")
    out = joined.withColumn(
        rank, (F.coalesce("_n_start", F.lit(0)) + F.row_number().over(inside.orderBy(*order))).cast("bigint")
    )
    if keep_below is not None or total:
        out = out.withColumn("n_total", F.coalesce("n_total", F.count(F.lit(1)).over(inside)))
    if keep_below is not None:
        out = out.filter(F.col(rank) <= keep_below.cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("n_total"))
    return out.drop("_bucket", "_pieces", "_n_start", "n_total")


def seeded_rank(
    df: DataFrame,
    key: Sequence[str],
    tag: str,
    seed: int,
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    keep_below: Column | None = None,
    rows: int = 0,
) -> DataFrame:
    """Rank rows in seeded-shuffle order (md5 of tag, seed and key).

    The md5 text is made again after the shuffle, which would else be mostly
    of such texts.
    """
    h = tag_hash(tag, seed, *key)
    order = [h, *[F.col(k) for k in key]]
    return bucketed_rank(df, lambda n: _md5_bucket(h, n), order, by, rank, total, keep_below, bounded=True, rows=rows)


def _md5_bucket(h: Column, n: Column) -> Column:
    return F.floor(hash_uint(h) / F.lit(4294967296.0) * n)


def hash_rank(
    df: DataFrame, h: str, key: Sequence[str], by: Sequence[str] = (), rank: str = "rank", total: str | None = None,
    keep_below: Column | None = None,
) -> DataFrame:
    """Rank rows by an md5 text column, ``key`` breaking ties."""

    return bucketed_rank(df, lambda n: _md5_bucket(F.col(h), n), [F.col(h), *[F.col(k) for k in key]], by, rank, total, keep_below, bounded=True)


def salted_join(rows: DataFrame, side: DataFrame, by: Sequence[str], how: str = "inner", count: str | None = None) -> DataFrame:
    """Join ``rows`` with ``side``, which has at most one row per ``by``, so that no task gets all rows of a hot key.

    Rows of a key above 1 / pieces of the table get a salt from a hash of the
    whole row, and the key's side row is repeated once per salt.  There are
    fewer such keys than pieces, so their table may be broadcast, and the side
    grows by fewer rows than pieces.  Rows with a null in ``by`` have no
    partner, as in any join; a left join deals them out by the hash alone.
    ``count`` names a column of ``side`` that holds the number of rows per
    key; it saves a count and is dropped.
    """
    by, pieces = list(by), pieces_wanted(rows.sparkSession)
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in by])
    if count:
        total = side.agg(F.sum(count)).scalar()
        share = F.col(count) * pieces / F.col("_all")
        big = side.withColumn("_all", total).filter(share > 1).select(*by, F.ceil(share).alias("_pieces"))
        side = side.drop(count)
    else:
        big = big_groups(rows.filter(known), by, pieces).select(*by, "_pieces")
    big = F.broadcast(big)
    whole = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind])
    salted = rows.withColumn("_whole", whole).join(big, by, "left")
    salt = F.when(known, F.coalesce(F.pmod("_whole", F.col("_pieces")), F.lit(0))).otherwise(F.col("_whole"))
    salted = salted.withColumn("_salt", salt).drop("_pieces", "_whole")
    spread = side.join(big, by, "left")
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return salted.join(spread, [*by, "_salt"], how).drop("_salt")


def with_group_stats(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates by aggregate-and-join instead of a window.

    The aggregate combines map-side, and rows of a hot group are salted over
    many tasks; a window could do neither.
    """
    stats = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()], F.count(F.lit(1)).alias("_rows"))
    return salted_join(df, stats, by, "left", count="_rows")
