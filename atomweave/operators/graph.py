"""Connected components of an edge table, for any graph size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from atomweave.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable vertex for each vertex of ``edges(src, dst)``: returns ``(vertex, component)``.

    Alternates large-star and small-star contraction; each round hangs vertices nearer to the smallest of their
    neighbours until the edge set no longer changes. Every round is written to the shared folder. Self loops, repeated
    edges and null ends are ignored; an empty table gives an empty result. Edges that still change after ``max_rounds``
    are an error (the number of rounds grows with the logarithm of the graph).
    """
    links = (
        edges.select("src", "dst")
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    links = cut(links, "edges")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        told = Observation()  # the state comes with the write, not by a second job
        links = cut(small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        state = told.get
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    up = links.groupBy("u").agg(F.min("v").alias("v"))
    return up.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        up.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )


def labelled_components(edges: DataFrame, identity: Column, compose: Callable[[Column, Column], Column], inverse: Callable[[Column], Column], max_rounds: int = 200) -> DataFrame:
    """Components of ``edges(src, dst, label)`` that carry each vertex' state relative to its root: ``(vertex, component, label)``.

    A label says how the state of ``src`` follows from that of ``dst``: ``state(src) = compose(state(dst), label)``. States are
    any group: offsets under addition, rotations under composition. The contraction is that of ``connected_components``; a
    link that is hung elsewhere takes the labels on its way along, so the number of rounds doesn't grow with the length of
    paths. The root, the smallest vertex, has the state ``identity``. Where two ways between vertices disagree (a
    component that meets its own image) there is no one answer: the smaller label of two parallel links stays, so reruns agree.
    Self loops and null ends are ignored; an empty table gives an empty result.
    """
    ends = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    down = F.col("src") > F.col("dst")
    links = ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), F.when(down, F.col("label")).otherwise(inverse(F.col("label"))).alias("g"))
    once = lambda df: df.groupBy("u", "v").agg(F.min("g").alias("g"))
    links = cut(once(links), "labelled-edges")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), inverse(F.col("g")).alias("g")))
        low = both.groupBy("u").agg(F.min(F.struct("v", "g")).alias("m"))
        lower = F.col("m.v") < F.col("u")
        back = inverse(F.col("g"))
        large = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = once(large.select(F.col("v").alias("u"), F.when(lower, F.col("m.v")).otherwise(F.col("u")).alias("v"), F.when(lower, compose(F.col("m.g"), back)).otherwise(back).alias("g")))
        low = large.groupBy("u").agg(F.min(F.struct("v", "g")).alias("m"))
        moved = F.struct("v", F.col("m.v").alias("to"), compose(F.col("m.g"), back).alias("g"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m.v").alias("to"), F.col("m.g").alias("g")), moved)).alias("e"))
        small = once(small.where(F.col("e.v") != F.col("e.to")).select(F.col("e.v").alias("u"), F.col("e.to").alias("v"), F.col("e.g").alias("g")))
        told = Observation()
        links = cut(small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "labelled-edges")
        state = told.get
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"), identity.alias("label"))
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component"), F.col("g").alias("label")).unionByName(roots)
