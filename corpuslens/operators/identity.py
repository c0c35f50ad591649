"""Identity groups: connected components over tokens that share a clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.plans.prefix import salted_join
from corpuslens.session import cut_lineage, discard

TASK_EDGES = 250_000  # edges that one task may resolve, some 50 MB


def token_edges(clips: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Star edges per clip: first token to every token (itself included).

    The self edge keeps clips with one token in the result.
    """
    first = F.element_at(tokens, 1)
    return clips.select(first.alias("a"), F.explode(tokens).alias("b")).distinct()


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) edges with v <= u.

    Large: every neighbour above u is linked to the smallest node u knows.
    Small: u and its smaller neighbours are linked to the smallest of them.
    The minimum is a combined aggregate joined back, so a hub's neighbour list
    is never gathered in one place.
    """
    if large:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    else:
        sym = edges
    low = sym.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    linked = salted_join(sym, low, ["u"], count="_n")
    low = low.drop("_n")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _labels(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """(u, v) with v the smallest token that u is connected to, for all tokens but the smallest of each component."""
    codes, tokens = pd.factorize(pd.concat([u, v], ignore_index=True), sort=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(tokens))
    while True:
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while (further := hooked[hooked]).tolist() != hooked.tolist():
            hooked = further
        if (hooked == label).all():
            break
        label = hooked
    moved = np.flatnonzero(label != np.arange(len(tokens)))
    return pd.DataFrame({"u": tokens[moved], "v": tokens[label[moved]]})


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges as stars on its smallest tokens: no more edges than tokens, and the same components."""
    for frame in frames:
        yield _labels(frame["u"], frame["v"])


def _resolved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = list(frames)
    if whole:
        edges = pd.concat(whole, ignore_index=True)
        yield _labels(edges["u"], edges["v"])


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))
    ).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(token, component) for undirected (a, b) edges; label = smallest token.

    Every batch of edges is contracted to stars in its task before the first
    shuffle.  As long as more than ``task_edges`` edges are left, large-star
    and small-star alternate until the edge set stops changing, which takes
    about log(n) rounds; what is left below that bound is resolved in one
    task.  Each round is written to the shared folder, so lineage stays one
    round deep and survives lost executors, and the round before is deleted.
    """
    base = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    kind = base.schema.simpleString()[len("struct<") : -1]
    cur, seen = base.filter("u != v"), None
    for _ in range(max_rounds):
        made = cut_lineage(cur.mapInPandas(_contracted, kind).distinct() if seen is None else _step(_step(cur, large=True), large=False))
        discard(*([cur] if seen is not None else []))
        cur, sig = made, _signature(made)
        if sig == seen:
            break
        seen = sig
        if sig[0] <= task_edges:
            cur = cut_lineage(cur.coalesce(1).mapInPandas(_resolved, kind))
            discard(made)
            break
    else:
        raise RuntimeError("components did not converge")
    nodes = base.select(F.explode(F.array("u", "v")).alias("token")).distinct()
    return nodes.join(cur.withColumnRenamed("u", "token"), "token", "left").select(
        "token", F.coalesce("v", "token").alias("component")
    )


def identity_groups(clips: DataFrame, tokens: str = "tokens", name: str = "identity_group") -> DataFrame:
    """``clips`` with the identity group of their first token."""
    label = components(token_edges(clips, tokens)).withColumnRenamed("component", name)
    tagged = clips.withColumn("token", F.element_at(tokens, 1))
    return salted_join(tagged, label, ["token"], "left").drop("token")


def component_stats(clips: DataFrame, group: str = "identity_group") -> DataFrame:
    """Number of groups, rows, and the share of rows in the largest group."""
    sizes = clips.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_rows"),
        F.max("n").alias("largest"),
        (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("largest_share"),
    )
