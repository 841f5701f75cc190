"""Streaming queries, run over the event files to their end into Parquet in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.session import shared_dir
from atomweave.streaming import flows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """Run a streaming DataFrame over what is there now and return its output."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def r1_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that the watermark has closed."""
    out = drained(flows.windowed_counts(_stream(spark, sf_dir), size="1 hour"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES["r1_windowed_counts"] = r1_windowed_counts
ORACLES["r1_windowed_counts"] = """
WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, n, total FROM w
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


def r4_counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("server"), "ts", F.col("value").alias("counter"))
    out = drained(flows.counter_rates(samples))
    return out.select(F.col("server").cast("long").alias("user_id"), F.unix_micros("ts").alias("at"), F.round("rate", 6).alias("rate"))


QUERIES["r4_counter_rates"] = r4_counter_rates
ORACLES["r4_counter_rates"] = """
WITH s AS (SELECT user_id, ts, value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, epoch_us(ts) AS at, round(CASE WHEN pt IS NULL THEN 0e0 ELSE greatest(0e0, (value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 1e6)) END, 6) AS rate FROM s"""


def r6_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups connect a user, errors disconnect them."""
    kind = F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "disconnect")
    events = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), kind.alias("kind"), "ts").where("kind is not null")
    return drained(flows.presence_minutes(events)).select(F.col("user").cast("long").alias("user_id"), F.col("day").cast("string").alias("day"), "minutes")


QUERIES["r6_presence"] = r6_presence
ORACLES["r6_presence"] = """
WITH e AS (SELECT user_id, ts, event_type = 'error' AS bye FROM events WHERE event_type IN ('signup', 'error')),
g AS (SELECT *, coalesce(sum(CAST(bye AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
p AS (SELECT user_id, part, min(ts) FILTER (WHERE NOT bye) AS since, max(ts) FILTER (WHERE bye) AS until FROM g GROUP BY 1, 2)
SELECT user_id, CAST(CAST(until AS DATE) AS VARCHAR) AS day, CAST(ceil((epoch_us(until) - epoch_us(since)) / 6e7) AS BIGINT) AS minutes FROM p WHERE since IS NOT NULL AND until IS NOT NULL"""
