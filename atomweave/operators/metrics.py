"""Time buckets, activity, counters and job rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.functions.scalars import percent_change, week_key


def metric_buckets(rows: DataFrame, ts: str, now: Column, keys: list[str]) -> DataFrame:
    """Total, this and the previous month's counts and their change per key, up to ``now`` (UTC)."""
    month = F.date_trunc("month", now)
    before = F.add_months(month, -1).cast("timestamp")
    t = F.col(ts)
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(t >= month).alias("this_month"), F.count_if((t >= before) & (t < month)).alias("last_month"))
    return out.withColumn("change", percent_change(F.col("this_month"), F.col("last_month")))


def weekly_counts(rows: DataFrame, ts: str, keys: list[str], weeks: int = 12) -> DataFrame:
    """Counts per Monday week, of the last weeks that occur in the table."""
    counts = rows.groupBy(week_key(F.col(ts)).alias("week"), *keys).agg(F.count("*").alias("n"))
    last = counts.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    return counts.join(F.broadcast(last), "week")


def merge_series(series: list[DataFrame], names: list[str], label: str, value: str) -> DataFrame:
    """One row per label of any series, one column per series, 0 where it has none."""
    every = None
    for name, s in zip(names, series):
        one = s.select(F.col(label), F.lit(name).alias("series"), F.col(value).alias("v"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(label).pivot("series", names).agg(F.sum("v")).fillna(0, names)


def daily_activity(rows: DataFrame, since: Column | None = None) -> DataFrame:
    """Per date of ``rows(date, activity array, minutes_online)``: all activity and minutes, ascending."""
    if since is not None:
        rows = rows.where(F.col("date") >= since)
    return rows.groupBy("date").agg(F.flatten(F.collect_list("activity")).alias("activity"), F.sum("minutes_online").alias("minutes_online")).orderBy("date")


def sum_by_cluster(rows: DataFrame, key: str, value: str, default: str = "main-cluster") -> DataFrame:
    return rows.groupBy(F.coalesce(key, F.lit(default)).alias(key)).agg(F.sum(value).alias(value))


def counter_rates(samples: DataFrame, server: str, ts: str, counters: list[str]) -> DataFrame:
    """Per-second rates against the server's previous sample, never negative, 0 for its first."""
    w = Window.partitionBy(server).orderBy(ts)
    seconds = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6
    rate = lambda c: F.coalesce(F.greatest(F.lit(0.0), F.try_divide((F.col(c) - F.lag(c).over(w)).cast("double"), seconds)), F.lit(0.0))
    return samples.select("*", *[rate(c).alias(f"{c}_rate") for c in counters])


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def folded_status(status: Column) -> Column:
    """Of a group's statuses: running if any runs or waits, completed if all are, failed if all are, else partial."""
    running = F.bool_or(status.isin("running", "queued", "retrying"))
    return F.when(running, "running").when(F.bool_and(status == "completed"), "completed").when(F.bool_and(status == "failed"), "failed").otherwise("partial")


def job_rollup(jobs: DataFrame) -> DataFrame:
    """``jobs(job_id, trajectory, timestep, status, ts)``: latest status of each job, then frames, then trajectories."""
    latest = jobs.groupBy("job_id").agg(F.max_by(F.struct("trajectory", "timestep", "status"), "ts").alias("j")).select("job_id", "j.*")
    frames = latest.groupBy("trajectory", "timestep").agg(F.count("*").alias("n_jobs"), folded_status(F.col("status")).alias("status"), F.count_if(F.col("status") == "completed").alias("n_done"))
    return frames


def progress(done: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``totals(key, total)`` with the number of distinct finished items and whether that is all of them."""
    counted = done.groupBy(key).agg(F.count_distinct("item").alias("completed"))
    out = totals.join(counted, key, "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    return out.withColumn("finished", F.col("completed") >= F.col("total"))
