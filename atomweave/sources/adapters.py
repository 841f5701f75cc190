"""Particle frames and documents made from relational tables by plain arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(p: int, q: int, r: int):
    n = F.col("l_partkey") * p + F.col("l_linenumber").cast("long") * q + F.col("l_orderkey") * r
    return (n % 10007).cast("double") / F.lit(10007.0) * F.lit(BOX)


def atoms(spark: SparkSession, sf_dir: str, frame: int | None = None) -> DataFrame:
    """``(frame, id, type, x, y, z)``: one particle per order and line number, in the frame of its first year of shipping."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    lines = lines.agg(F.min("l_partkey").alias("l_partkey"), F.min(F.year("l_shipdate")).alias("frame"))
    if frame is not None:
        lines = lines.where(F.col("frame") == frame)
    return lines.select(
        "frame",
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").cast("int").alias("type"),
        _coordinate(7919, 104729, 31).alias("x"),
        _coordinate(6101, 15485, 97).alias("y"),
        _coordinate(3571, 32452, 53).alias("z"),
    )


#: The same rows in DuckDB SQL.
ATOMS_SQL = """
SELECT frame, l_orderkey * 8 + l_linenumber AS id, l_linenumber AS type,
  CAST((l_partkey * 7919 + CAST(l_linenumber AS BIGINT) * 104729 + l_orderkey * 31) % 10007 AS DOUBLE) / 10007e0 * 2e1 AS x,
  CAST((l_partkey * 6101 + CAST(l_linenumber AS BIGINT) * 15485 + l_orderkey * 97) % 10007 AS DOUBLE) / 10007e0 * 2e1 AS y,
  CAST((l_partkey * 3571 + CAST(l_linenumber AS BIGINT) * 32452 + l_orderkey * 53) % 10007 AS DOUBLE) / 10007e0 * 2e1 AS z
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(year(l_shipdate)) AS frame FROM lineitem GROUP BY 1, 2)"""


#: Atoms of a layer in the crystals below, and layers between their twin planes.
LAYER, LAMELLA = 16, 6


def crystal_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame, id, x, y, z)``: an order is a lattice site, its key says which, with a small shift by its customer.

    Four frames of layers of 16 atoms that fill up along z: 0 cubic close-packed, 1 hexagonal close-packed, 2 body-centred,
    3 cubic close-packed with a twin plane every sixth layer. Close-packed atoms are 1 apart.
    """
    key = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    site = F.floor(F.col("o_orderkey") / 4)
    rows = key.select((F.col("o_orderkey") % 4).cast("int").alias("frame"), F.col("o_orderkey").alias("id"), "o_custkey", F.floor(site / LAYER).alias("l"), (site % LAYER).alias("r"))
    fold = F.col("l") % (2 * LAMELLA)
    stack = F.when(F.col("frame") == 0, F.col("l")).when(F.col("frame") == 1, F.col("l") % 2).otherwise(F.least(fold, 2 * LAMELLA - fold)) % 3
    rows = rows.withColumn("o", stack.cast("double"))
    r = F.col("r")
    half, cell = (r % 2).cast("double") * 0.5, F.floor(r / 2)
    close = [(cell % 4) + half + F.col("o") * 0.5, (F.floor(cell / 4) + half) * F.sqrt(F.lit(3.0)) + F.col("o") * F.sqrt(F.lit(3.0)) / 6.0, F.col("l") * F.sqrt(F.lit(2.0) / 3.0)]
    body = [(r % 4) + (F.col("l") % 2) * 0.5, F.floor(r / 4) + (F.col("l") % 2) * 0.5, F.col("l") * 0.5]
    shift = lambda p: ((F.col("o_custkey") * p) % 101).cast("double") / 101.0 * 0.01
    xyz = [F.when(F.col("frame") == 2, b).otherwise(c) + shift(p) for b, c, p in zip(body, close, (7, 11, 13))]
    return rows.select("frame", "id", *[v.cast("double").alias(c) for v, c in zip(xyz, "xyz")])


#: The same sites in DuckDB SQL, with their layers and stacking; ``type`` and ``cluster`` follow from those of their neighbours.
CRYSTAL_SQL = f"""
SELECT frame, id, l, r, CASE WHEN frame = 0 THEN l % 3 WHEN frame = 1 THEN l % 2 ELSE least(l % {2 * LAMELLA}, {2 * LAMELLA} - l % {2 * LAMELLA}) % 3 END AS o
FROM (SELECT CAST(o_orderkey % 4 AS INT) AS frame, o_orderkey AS id, o_orderkey // 4 // {LAYER} AS l, o_orderkey // 4 % {LAYER} AS r FROM orders GROUP BY o_orderkey)"""


def crystal_cells(frames: DataFrame) -> DataFrame:
    """Cells of ``crystal_atoms``: periodic along x and y, open along z."""
    width, depth = F.when(F.col("frame") == 2, 4.0).otherwise(4.0), F.when(F.col("frame") == 2, 4.0).otherwise(2.0 * F.sqrt(F.lit(3.0)))
    tall = frames.groupBy("frame").agg((F.max("z") + 10.0).alias("tall"))
    zero = F.lit(0.0)
    return tall.select("frame", F.array(width, zero, zero).alias("a"), F.array(zero, depth, zero).alias("b"), F.array(zero, zero, "tall").alias("c"), F.array(zero, zero, zero).alias("origin"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("pbc"))


def cube_cells(frames: DataFrame, size: float = BOX) -> DataFrame:
    """One periodic cube per frame of ``frames(frame)``."""
    edge = lambda i: F.array(*[F.lit(size if k == i else 0.0) for k in range(3)])
    return frames.select("frame").distinct().select(
        "frame", edge(0).alias("a"), edge(1).alias("b"), edge(2).alias("c"), F.array(*[F.lit(0.0)] * 3).alias("origin"), F.array(*[F.lit(True)] * 3).alias("pbc")
    )
