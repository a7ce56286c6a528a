"""Arriving batches: heartbeats and file metadata folded into state tables, logs appended.

State is a bucketed table (``sources.store``). A micro-batch reads and writes the buckets that its keys fall in and publishes them by one
manifest that names the batch, so a batch that is run again after a failure changes nothing twice, and what it writes goes with what it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions import scalars as S
from larkspur.operators import state
from larkspur.sources import store


def fold(stream: DataFrame, start: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], folder: str, keys: tuple[str, ...], groups: int = 64, kept: int = 2) -> DataFrame:
    """The state table after all that is available: start, merged with each micro-batch in turn. A later call on the same folder goes on from the state that the last one left; start and groups count only in the first.

    merge takes rows of the state and of a batch and may look at rows with equal keys only. A batch that was published is left out if the stream
    hands it over again. The last kept states can be read; choose groups so that a bucket fits a task.
    """
    spark = stream.sparkSession
    if store.snapshot(spark, folder) is None:
        store.create(start, folder, keys, groups, keys, {"batch": -1})

    def step(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        now = store.snapshot(session, folder)
        if now.note["batch"] < n:
            batch = batch.persist()  # its buckets first, then its rows
            store.rewrite(session, now, lambda old: merge(old, batch), store.touched(batch, now), keys, {"batch": n})
            batch.unpersist()
            store.vacuum(session, folder, kept)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read(spark, store.snapshot(spark, folder)).drop("bucket")


def files(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stream_heartbeats(stream: DataFrame, devices: DataFrame, folder: str) -> DataFrame:
    """Devices after all heartbeats; ordered by event time, so a late beat does not move last_seen_at back."""
    return fold(stream, devices, state.fold_heartbeats, folder, ("device_code",))


def stream_file_index(stream: DataFrame, current: DataFrame, folder: str) -> DataFrame:
    """The file index after all metadata batches; within a batch the last by seq wins, a later batch over an earlier one."""
    return fold(stream, current, state.merge_file_index, folder, ("device_code", "full_path"))


def stream_logs(stream: DataFrame, folder: str) -> DataFrame:
    """Logs with normalised levels, appended by date; no state."""
    out = stream.withColumn("level", S.norm_level("level")).withColumn("day", F.to_date("created_at"))
    q = out.writeStream.format("parquet").partitionBy("day").option("path", f"{folder}/logs").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/logs")


def stream_offline(stream: DataFrame, folder: str, minutes: int, late: str = "1 hour") -> DataFrame:
    """T4: (device_code, online_at, offline_at, beats) of each session of heartbeats that is over: a device falls silent for minutes at offline_at, and its next session brings it back. A session is given out once the watermark, late behind the newest beat, has passed its end; beats behind the watermark are left out."""
    session = F.session_window("ts", f"{minutes} minutes")
    out = stream.withWatermark("ts", late).groupBy("device_code", session).agg(F.count(F.lit(1)).alias("beats"))
    out = out.select("device_code", F.col("session_window.start").alias("online_at"), F.col("session_window.end").alias("offline_at"), "beats")
    q = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{folder}/alerts")


ALERT = "device_code string, at timestamp, status string"


def alerts(beats: DataFrame, minutes: int, late: str = "10 seconds") -> DataFrame:
    """T4 by timers, a stream of (device_code, at, status) from beats (device_code, ts): online at the first beat and at every beat after a silence longer than minutes, offline when a silence has become longer than minutes.

    Each device has a timer at its newest beat plus minutes. It goes off once the watermark (late behind the newest beat of all devices) has passed it, so an alert comes about late after it is due, whether the device
    is heard again or not. Beats behind the watermark are left out; others may come in any order within a micro-batch. A device that is offline holds no state.
    """
    gap = minutes * 60_000_000

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        found: list[tuple[int, str]] = []
        if held.hasTimedOut:
            found.append((last + gap, "offline"))
            last = None
        else:
            for at in np.sort(np.concatenate([f["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for f in frames])).tolist():
                if last is not None and at > last + gap:
                    found.append((last + gap, "offline"))
                    last = None
                if last is None:
                    found.append((at, "online"))
                last = at if last is None else max(last, at)
            if last + gap < held.getCurrentWatermarkMs() * 1000:
                found.append((last + gap, "offline"))
                last = None
        if last is None:
            if held.exists:
                held.remove()
        else:
            held.update((last,))
            held.setTimeoutTimestamp(-(-(last + gap) // 1000))
        at, status = zip(*found, strict=True) if found else ((), ())
        yield pd.DataFrame({"device_code": [key[0]] * len(found), "at": np.array(at, dtype="datetime64[us]"), "status": list(status)})

    marked = beats.select("device_code", "ts").where("device_code is not null and ts is not null").withWatermark("ts", late)
    return marked.groupBy("device_code").applyInPandasWithState(step, ALERT, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_alerts(stream: DataFrame, folder: str, minutes: int, late: str = "10 seconds") -> DataFrame:
    """All alerts that the beats available so far give, written to folder; a later call goes on from there."""
    q = alerts(stream, minutes, late).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(ALERT).parquet(f"{folder}/alerts")
