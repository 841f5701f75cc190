"""Ranks and running sums of large ordered groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.session import cut, shuffle_width


def running_sum(df: DataFrame, value: str, keys: list[str], chunk: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows of the same ``keys`` that come before this row.

    Rows are ordered by ``chunk`` and then by ``order``; chunks spread a large group over many tasks. Only one total
    per chunk is summed in a window over the group, so that window has as many rows as the group has chunks.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_chunk_total"))
    before = F.sum("_chunk_total").over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*keys, chunk, F.coalesce(before, F.lit(0)).alias("_chunk_start"))
    named = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, chunk])], "_chunk_start")
    same = None
    for i, k in enumerate([*keys, chunk]):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    within = F.sum(value).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("_within", F.coalesce(within, F.lit(0)))
        .join(named, same)
        .withColumn(out, F.col("_within") + F.col("_chunk_start"))
        .drop("_within", "_chunk_start", *[f"_k{i}" for i in range(len(keys) + 1)])
    )


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``, the row's number from 1 in ``order``, without a task that holds all rows.

    Rows are dealt into ranges of the order, which are written so that they stay the same; each range is numbered by
    itself and starts after the rows of those before it. Columns of the input with a leading underscore must not be
    ``_range`` or ``_before``.
    """
    ranges = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    ranges = cut(ranges, "ranges")
    counts = ranges.groupBy("_range").count()
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(out, own).join(F.broadcast(starts), "_range").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_range", "_before")
