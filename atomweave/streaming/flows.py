"""Streaming forms of metric sampling, sessions, presence and parked work.

Each function takes streaming DataFrames and returns one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark don't count."""
    held = events.withWatermark(ts, late)
    return held.groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", key, "n", "total")


def recent(samples: DataFrame, ts: str = "ts", minutes: int = 15, every: str = "1 minute", late: str = "24 hours") -> DataFrame:
    """Sliding history: averages over the last minutes, once per slide; samples are retained for a day."""
    held = samples.withWatermark(ts, late)
    return held.groupBy(F.window(ts, f"{minutes} minutes", every), "server").agg(F.avg("value").alias("avg_value"), F.count("*").alias("n")).select("window.end", "server", "avg_value", "n")


def counter_rates(samples: DataFrame) -> DataFrame:
    """``samples(server, ts, counter)`` to per-second rates against the server's previous sample, kept in state.

    Rates are never negative; a server's first sample has rate 0; samples not after the last one are skipped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("ts")
        out = []
        for ts, value in zip(rows["ts"], rows["counter"]):
            now = ts.value // 1000
            if last_ts is not None and now <= last_ts:
                continue
            rate = 0.0 if last_ts is None else max(0.0, (value - last) / ((now - last_ts) / 1e6))
            out.append((key[0], ts, rate))
            last_ts, last = now, float(value)
        if last_ts is not None:
            state.update((last_ts, last))
        yield pd.DataFrame(out, columns=["server", "ts", "rate"])

    return samples.groupBy("server").applyInPandasWithState(step, "server string, ts timestamp, rate double", "last_ts long, last double", "append", GroupStateTimeout.NoTimeout)


def latest_with_heartbeat(samples: DataFrame, expiry_ms: int = 15_000, late: str = "0 seconds") -> DataFrame:
    """``samples(server, ts, value)``: each server's latest sample as it changes.

    A server is reported as ``expired`` once the watermark (the latest time of all servers less ``late``) is ``expiry_ms``
    past its last sample. Event time decides, so a run over what is there ends and a replay gives the same rows.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, value = state.get
            state.remove()
            yield pd.DataFrame([(key[0], value, True)], columns=["server", "value", "expired"])
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        ts, value = rows["ts"].iloc[-1].value // 1000, float(rows["value"].iloc[-1])
        if state.exists and state.get[0] > ts:
            ts, value = state.get
        state.update((ts, value))
        state.setTimeoutTimestamp(max(ts // 1000 + expiry_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], value, False)], columns=["server", "value", "expired"])

    held = samples.withWatermark("ts", late).groupBy("server")
    return held.applyInPandasWithState(step, "server string, value double, expired boolean", "ts long, value double", "update", GroupStateTimeout.EventTimeTimeout)


def session_completions(jobs: DataFrame, keep_ms: int = 7 * 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """``jobs(session_id, kind, count, ts)``: ``open`` rows set a session's remaining jobs, ``done`` rows take one away.

    A session is reported once, when nothing remains; early ``done`` rows wait for the opening. State ends with the
    session or when the watermark is a week past its last row.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, done, last = state.get if state.exists else (-1, 0, 0)
        for part in parts:
            for kind, count, ts in zip(part["kind"], part["count"], part["ts"]):
                last = max(last, ts.value // 1_000_000)
                if kind == "open":
                    total = max(total, 0) + int(count)
                else:
                    done += int(count)
        if 0 <= total <= done:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], total)], columns=["session_id", "jobs"])
        else:
            state.update((total, done, last))
            state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))

    held = jobs.withWatermark("ts", late).groupBy("session_id")
    return held.applyInPandasWithState(step, "session_id string, jobs long", "total long, done long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def presence_minutes(events: DataFrame) -> DataFrame:
    """``events(user, kind, ts)``: whole minutes, rounded up, between a connect and the next disconnect, by its day."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for kind, ts in zip(rows["kind"], rows["ts"]):
            now = ts.value // 1000
            if kind == "connect":
                since = now if since is None else since
            elif since is not None:
                out.append((key[0], ts.date(), -(-(now - since) // 60_000_000)))
                since = None
        if since is not None:
            state.update((since,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user", "day", "minutes"])

    return events.groupBy("user").applyInPandasWithState(step, "user string, day date, minutes long", "since long", "append", GroupStateTimeout.NoTimeout)


def ready_jobs(jobs: DataFrame, uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Jobs that wait for their frame's upload: an inner stream-stream join within the watermark, in either order.

    ``jobs(job_id, trajectory, timestep, job_ts)``, ``uploads(trajectory, timestep, upload_ts)``.
    """
    j, u = jobs.withWatermark("job_ts", late).alias("j"), uploads.withWatermark("upload_ts", late).alias("u")
    near = F.expr(f"j.job_ts between u.upload_ts - interval {late} and u.upload_ts + interval {late}")
    same = (F.col("j.trajectory") == F.col("u.trajectory")) & (F.col("j.timestep") == F.col("u.timestep"))
    return j.join(u, same & near).select("j.job_id", "j.trajectory", "j.timestep", F.greatest("j.job_ts", "u.upload_ts").alias("ready_ts"))


def status_feed(snapshot: DataFrame, write, team: str = "team", most: int = 1000, keep: int = 50):
    """A ``foreachBatch`` function for subscribers of job states: the snapshot first, then what changes.

    ``snapshot(team, job_id, status, ts)`` is a table as of now, batches have the same columns. The first batch that the
    function gets hands the snapshot's rows on before its own, after a restart too, when subscribers start anew; a batch that
    failed there sends it again. Of a batch's changes the last of each job counts; a team with
    more than ``most`` of them gets the ``keep`` latest only, as a client reloads after a burst. ``write(rows)`` takes a
    DataFrame of ``team, job_id, status, ts, kind``.
    """
    columns = [team, "job_id", "status", "ts"]
    greeted: list[int] = []

    def send(batch: DataFrame, number: int) -> None:
        if not greeted:
            write(snapshot.select(*columns, F.lit("snapshot").alias("kind")))
            greeted.append(number)
        write(burst(batch.select(*columns), team, most, keep).select(*columns, F.lit("change").alias("kind")))

    return send


def burst(changes: DataFrame, team: str = "team", most: int = 1000, keep: int = 50) -> DataFrame:
    """Each job's last change; of a team with more than ``most`` changed jobs the ``keep`` latest."""
    last = changes.groupBy(team, "job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
    counted = last.groupBy(team).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(team).orderBy(F.desc("ts"), "job_id")
    crowded = last.join(counted.where(F.col("_n") > most), team).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    return last.join(counted.where(F.col("_n") <= most), team).drop("_n").unionByName(crowded.drop("_n", "_r"))


def upsert_batches(path: str, keys: list[str], version: str):
    """A ``foreachBatch`` function that keeps a keyed table under ``path``, one folder per batch, the last one whole.

    Replaying a batch gives the same table again, so a restart from the checkpoint loses and doubles nothing. Of the
    batches before, the one that a replay starts from stays; older folders go once the new one is written.
    """
    from atomweave.operators.documents import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
        older = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(jvm_path) if "=" in s.getPath().getName()] if fs.exists(jvm_path) else []
        older = [n for n in older if n < number]
        new = upsert(spark.read.parquet(f"{path}/batch={max(older)}"), batch, keys, version) if older else batch
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for n in sorted(older)[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}"), True)

    return write
