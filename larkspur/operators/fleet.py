"""Fleet reports: versions, dispatch, newest rows of each device, request timelines, import progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S


def newest_active(agent_versions: DataFrame) -> DataFrame:
    """One row: the newest active agent version."""
    return agent_versions.where("is_active").agg(F.max_by("version", F.struct("created_at", "version")).alias("newest"))


def device_update_status(devices: DataFrame, agent_versions: DataFrame, as_of: str, minutes: int = 2) -> DataFrame:
    """Devices against the newest active agent version."""
    out = devices.crossJoin(F.broadcast(newest_active(agent_versions)))
    name = F.when(F.trim("nickname") == "", F.col("device_code")).otherwise(F.col("nickname"))
    return out.select("device_code", name.alias("display_name"), "agent_version", S.version_status("agent_version", "newest").alias("update_status"), S.online("last_seen_at", as_of, minutes).alias("online"))


def version_summary(devices: DataFrame, agent_versions: DataFrame, as_of: str, minutes: int = 2) -> DataFrame:
    """A4: (kind, name, n): totals by update status and online, and devices by version."""
    d = device_update_status(devices, agent_versions, as_of, minutes)
    v = F.when(F.trim("agent_version") == "", "unknown").otherwise(F.trim("agent_version"))
    each = F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.when(F.col("online"), "online").otherwise("offline").alias("name")), F.struct(F.lit("status").alias("kind"), F.col("update_status").alias("name")), F.struct(F.lit("version").alias("kind"), v.alias("name"))))
    return d.select(each.alias("e")).groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))


def dispatch_commands(requests: DataFrame, commands: DataFrame, n: int = 5) -> DataFrame:
    """The oldest n pending of each kind for each device, file requests first. requests: id, device_code, request_type, status, requested_at."""
    upload = F.when(F.col("request_type").isin("multiple", "folder"), "UPLOAD_ZIP").otherwise("UPLOAD_FILE")
    r = requests.where("status = 'pending'").select(F.lit(0).alias("source"), "id", "device_code", upload.alias("command_type"), "requested_at")
    c = commands.where("status = 'pending'").select(F.lit(1).alias("source"), "id", "device_code", "command_type", "requested_at")
    w = Window.partitionBy("device_code", "source").orderBy("requested_at", "id")
    return r.unionByName(c).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def active_commands(commands: DataFrame) -> DataFrame:
    """The newest open command of each device and type."""
    open_ = commands.where(F.col("status").isin("pending", "sent_to_agent"))
    return open_.groupBy("device_code", "command_type").agg(F.max_by("id", F.struct("requested_at", "id")).alias("id"), F.count(F.lit(1)).alias("open_count"))


def admit_commands(commands: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, device_code, command_type, requested_at) with outcome and twin: a duplicate names the open command of its device and type, or the request of this batch before it; others are admitted."""
    keys = ["device_code", "command_type"]
    w = Window.partitionBy(*keys).orderBy("requested_at", "request_id")
    first = F.first("request_id").over(w)
    out = requests.withColumn("_first", first).join(active_commands(commands).select(*keys, F.col("id").alias("_open")), keys, "left")
    twin = F.coalesce("_open", F.when(F.col("_first") != F.col("request_id"), F.col("_first")))
    return out.withColumn("twin", twin).withColumn("outcome", F.when(F.col("twin").isNull(), "admitted").otherwise("duplicate")).drop("_first", "_open")


def recent_per_device(rows: DataFrame, n: int, ts: str = "created_at") -> DataFrame:
    """The newest n rows of each device; the group limit is pushed below the shuffle."""
    w = Window.partitionBy("device_code").orderBy(F.desc(ts), F.desc("id"))
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def request_timeline(logs: DataFrame) -> DataFrame:
    """Log rows of each request, oldest first, with the seconds since the row before."""
    w = Window.partitionBy("request_id").orderBy("created_at", "id")
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lag("created_at").over(w).cast("timestamp"))
    return logs.withColumn("position", F.row_number().over(w)).withColumn("step_micros", F.coalesce(seconds, F.lit(0).cast("long")))


def import_progress(snapshots: DataFrame) -> DataFrame:
    """Percent, files a second, bytes a second and seconds left between counter snapshots of a job; -1 where there was no progress."""
    w = Window.partitionBy("job_id").orderBy("taken_at", "uploaded_count")
    seconds = (F.unix_micros(F.col("taken_at").cast("timestamp")) - F.unix_micros(F.lag("taken_at").over(w).cast("timestamp"))) / 1e6
    files, size = F.col("uploaded_count") - F.lag("uploaded_count").over(w), F.col("uploaded_bytes") - F.lag("uploaded_bytes").over(w)
    out = snapshots.withColumns({"_s": seconds, "_f": files, "_b": size})
    moving = (F.col("_s") > 0) & (F.col("_f") > 0)
    none = F.lit(-1.0)
    percent = F.floor((F.col("uploaded_count").cast("long") * 20_000 + F.col("indexed_count")) / (F.col("indexed_count") * 2)) / 100.0
    rate = lambda x: F.when(moving, F.round(x / F.col("_s"), 4)).otherwise(none)
    eta = F.when(moving, F.round((F.col("indexed_count") - F.col("uploaded_count")) * F.col("_s") / F.col("_f"), 2)).otherwise(none)
    return out.select("job_id", "taken_at", "uploaded_count", percent.alias("percent"), rate(F.col("_f")).alias("files_s"), rate(F.col("_b")).alias("bytes_s"), eta.alias("eta_s"))


def silent_gaps(beats: DataFrame, minutes: int, as_of: str) -> DataFrame:
    """T4 in batch form: (device_code, offline_at, online_at) of each silence longer than minutes; online_at is as_of if the silence still lasts then."""
    w = Window.partitionBy("device_code").orderBy("ts")
    gap: Column = F.expr(f"interval {minutes} minutes")
    nxt = F.coalesce(F.lead("ts").over(w), S.ntz(as_of))
    out = beats.select("device_code", "ts").distinct().withColumn("next_ts", nxt)
    return out.where(F.col("next_ts") > F.col("ts") + gap).select("device_code", (F.col("ts") + gap).alias("offline_at"), F.col("next_ts").alias("online_at"))
