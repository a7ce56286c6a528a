"""Catalogue operators: filters, policy, exclusions, lookups, listings and breakdowns. Whole tables in, whole tables out."""

from __future__ import annotations

import functools
import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S

SOURCE_TYPES = ("automatic_upload", "old_user_data")


def validate_filter(spec: dict[str, Any]) -> dict[str, Any]:
    """Raise ValueError before any job runs."""
    if spec.get("source_type") and spec["source_type"].lower() not in SOURCE_TYPES:
        raise ValueError("unknown source type")
    low, high = spec.get("min_size"), spec.get("max_size")
    if any(x is not None and x < 0 for x in (low, high)):
        raise ValueError("sizes are not negative")
    if low is not None and high is not None and low > high:
        raise ValueError("min_size is above max_size")
    if spec.get("modified_after") and spec.get("modified_before") and spec["modified_after"] > spec["modified_before"]:
        raise ValueError("modified_after is after modified_before")
    return spec


def document_filter(documents: DataFrame, versions: DataFrame, sources: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Documents that meet spec. Each version condition may be met by another version; they are aggregated at once."""
    spec = validate_filter(spec)
    out = documents if spec.get("include_deleted") else documents.where(~F.col("is_deleted"))
    if device := spec.get("device_code"):
        out = out.where(F.col("device_code") == device.upper())
    if (department := spec.get("department")) is not None:
        out = out.where(F.col("department") == department)
    for name in ("classification", "source_type"):
        if spec.get(name):
            out = out.where(F.lower(name) == spec[name].lower())
    if name := spec.get("name"):
        out = out.where(S.contains_ci("display_name", name))
    tests: list[Column] = []
    if ext := spec.get("extension"):
        tests.append(F.lower("file_extension") == ("." + ext.lstrip(".").lower()))
    if status := spec.get("extraction_status"):
        tests.append(F.col("extraction_status") == status.lower())
    if (n := spec.get("min_size")) is not None:
        tests.append(F.col("size_bytes") >= n)
    if (n := spec.get("max_size")) is not None:
        tests.append(F.col("size_bytes") <= n)
    if t := spec.get("modified_after"):
        tests.append(F.col("source_modified_at") >= S.ntz(t))
    if t := spec.get("modified_before"):
        tests.append(F.col("source_modified_at") <= S.ntz(t))
    if tests:
        met = versions.groupBy("document_id").agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"t{k}") for k, t in enumerate(tests)))
        for k in range(len(tests)):
            met = met.where(F.col(f"t{k}"))
        out = out.join(met.select("document_id"), "document_id", "left_semi")
    if path := spec.get("path"):
        found = sources.where(S.contains_ci("full_path", path)).select(F.col("id").alias("source_record_id"))
        out = out.join(found, "source_record_id", "left_semi")
    return out


def policy_classify(files: DataFrame, extensions: list[str], max_size: int, part_size: int, enabled: bool = True) -> DataFrame:
    """Files of the policy's extensions with status and reason; the first rule that applies wins."""
    if not enabled or not extensions:
        raise ValueError("the policy is disabled or has no extensions")
    size = F.col("size_bytes")
    reason = F.when(size <= 0, "empty").when(size > max_size, "over limit").when(size > part_size * 10_000, "too many parts").otherwise("")
    kept = files.where(S.norm_ext("extension").isin(*(("." + e.strip().lstrip(".").lower()) for e in extensions)))
    return kept.withColumn("reason", reason).withColumn("policy_status", F.when(F.col("reason") == "", "indexed").otherwise("skipped"))


def normalize_policy(extensions: list[str], max_size: int) -> list[str]:
    """The extensions as they are stored; raises ValueError if the policy may not be written."""
    out = sorted({"." + e.strip().lstrip(".").lower() for e in extensions if e.strip().lstrip(".")})
    if not out or len(out) > 500 or any(len(e) > 32 for e in out) or max_size <= 0:
        raise ValueError("a policy has 1 to 500 extensions of 32 characters at most, and a positive size limit")
    return out


def exclude_files(files: DataFrame, exclusions: DataFrame, skip_dot_folders: bool = True) -> DataFrame:
    """Files that no active exclusion of their device applies to. Distinct directories are tested, by equality of their ancestors."""
    rules = exclusions.where("is_active").select("device_code", "exclusion_type", F.lower(F.regexp_replace(F.trim("value"), r"[\\/]+$", "")).alias("v")).where("v <> ''")
    is_name = (F.col("exclusion_type") == "folder_name") | ((F.col("exclusion_type") == "folder_path") & ~F.col("v").rlike(r"[\\/:]"))
    names = rules.where(is_name).select("device_code", F.col("v").alias("name")).distinct()
    paths = rules.where((F.col("exclusion_type") == "folder_path") & ~is_name).select("device_code", F.col("v").alias("path")).distinct()
    exts = rules.where("exclusion_type = 'file_extension'").select("device_code", F.concat(F.lit("."), F.regexp_replace("v", r"^\.+", "")).alias("ext")).distinct()
    folders = files.select("device_code", "directory_path").distinct().select("device_code", "directory_path", F.explode(S.ancestors(F.lower("directory_path"))).alias("path"))
    folders = folders.withColumn("name", F.substring_index("path", "\\", -1))
    bad = folders.join(paths, ["device_code", "path"], "left_semi").unionByName(folders.join(names, ["device_code", "name"], "left_semi"))
    if skip_dot_folders:
        bad = bad.unionByName(folders.where(F.startswith("name", F.lit("."))))
    kept = files.join(bad.select("device_code", "directory_path").distinct(), ["device_code", "directory_path"], "left_anti")
    kept = kept.where(~F.startswith("file_name", F.lit("."))).withColumn("ext", F.lower("extension"))
    return kept.join(exts, ["device_code", "ext"], "left_anti").drop("ext")


#: Other names of the exclusion types.
EXCLUSION_NAMES = {
    "folder_path": ("excludedfolders", "excluded_folder", "excluded_folders", "folder", "folder_path", "path"),
    "folder_name": ("excludedfoldernames", "excluded_folder_name", "excluded_folder_names", "folder_name", "name"),
    "file_extension": ("excludedfileextensions", "excluded_file_extension", "excluded_file_extensions", "file_extension", "extension"),
}


def exclusion_type(name: Column) -> Column:
    """P5: the type that a name stands for, case and - or _ aside; null if none."""
    plain = F.translate(F.lower(F.trim(name)), "-", "_")
    return F.coalesce(*(F.when(plain.isin(*names), kind) for kind, names in EXCLUSION_NAMES.items()))


def exclusion_sets(exclusions: DataFrame, defaults: dict[str, list[str]]) -> DataFrame:
    """P5: (device_code, exclusion_type, ordinal, value): active exclusions and the defaults, cleaned, distinct ignoring case, ordered. Types may go by their other names; unknown ones are left out."""
    spark = exclusions.sparkSession
    base = spark.createDataFrame([(k, v) for k, vs in defaults.items() for v in vs], "exclusion_type string, value string")
    devices = exclusions.select("device_code").distinct()
    both = exclusions.where("is_active").select("device_code", "exclusion_type", "value").unionByName(devices.crossJoin(F.broadcast(base)).select("device_code", "exclusion_type", "value"))
    both = both.withColumn("exclusion_type", exclusion_type(F.col("exclusion_type"))).where("exclusion_type IS NOT NULL")
    clean = F.regexp_replace(F.trim("value"), r"[\\/]+$", "")
    clean = F.when(F.col("exclusion_type") == "file_extension", S.norm_ext(clean)).otherwise(clean)
    both = both.withColumn("value", clean).where("value <> ''")
    one = both.groupBy("device_code", "exclusion_type", F.lower("value").alias("k")).agg(F.min("value").alias("value"))
    order = Window.partitionBy("device_code", "exclusion_type").orderBy("k")
    return one.select("device_code", "exclusion_type", F.row_number().over(order).alias("ordinal"), "value")


def upload_candidates(files: DataFrame, extensions: list[str], as_of: str) -> DataFrame:
    """Live files of these extensions whose size or time changed since their last upload and whose back-off is over."""
    last, now = F.col("last_attempt_at"), S.ntz(as_of)
    waited = lambda text: last < now - F.expr(f"interval {text}")
    n = F.col("attempt_count")
    due = (n == 0) | last.isNull() | ((n <= 2) & waited("15 minutes")) | ((n <= 4) & waited("2 hours")) | ((n <= 7) & waited("12 hours")) | waited("7 days")
    changed = ~F.coalesce((F.col("uploaded_size_bytes") == F.col("size_bytes")) & (F.col("uploaded_updated_at") == F.col("updated_at")), F.lit(False))
    return files.where(~F.col("is_deleted") & F.lower("extension").isin(*extensions) & changed & due)


def verify_identity(jobs: DataFrame, max_size: int) -> DataFrame:
    """Jobs with code and disposition (ok, retry or reject) of the first check that fails.

    Columns: is_deleted, job_version_id, job_etag, job_sha, job_size, got_version_id, got_etag, got_sha, got_size.
    """
    bare = lambda name: F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), '"', ""))
    job, got = F.coalesce("job_version_id", F.lit("")), F.coalesce("got_version_id", F.lit(""))
    code = (
        F.when(F.col("is_deleted"), "document_deleted")
        .when((job == "") & (got == ""), "source_version_identity_missing")
        .when((job != "") & (job != got), "source_version_mismatch")
        .when((bare("job_etag") != "") & (bare("job_etag") != bare("got_etag")), "source_etag_mismatch")
        .when((bare("job_sha") != "") & (bare("job_sha") != bare("got_sha")), "checksum_mismatch")
        .when(F.col("got_size") > max_size, "source_too_large")
        .when(F.col("job_size") != F.col("got_size"), "source_size_mismatch")
        .otherwise("ok")
    )
    reject = F.col("code").isin("document_deleted", "checksum_mismatch", "source_too_large")
    return jobs.withColumn("code", code).withColumn("disposition", F.when(F.col("code") == "ok", "ok").when(reject, "reject").otherwise("retry"))


def validate_sources(sources: DataFrame) -> DataFrame:
    """P10: sources with reason: blank if good, else why the row is set aside."""
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    reason = (
        F.when(F.col("id").isNull(), "missing id").when(blank("file_name"), "blank file name").when(blank("object_key"), "blank object key")
        .when(F.col("size_bytes") <= 0, "empty").when(~blank("sha256") & ~F.col("sha256").rlike("^[0-9A-Fa-f]{64}$"), "bad sha").otherwise("")
    )
    return sources.withColumn("reason", reason)


def search_file_index(files: DataFrame, text: str, device: str | None = None, extension: str | None = None, include_deleted: bool = True) -> DataFrame:
    """Files whose name or path holds text, with case; for a device without case, directories too."""
    if device is None:
        return files.where(F.contains("file_name", F.lit(text)) | F.contains("full_path", F.lit(text)))
    out = files.where((F.col("device_code") == device) & (S.contains_ci("file_name", text) | S.contains_ci("full_path", text) | S.contains_ci("directory_path", text)))
    out = out.where(F.lower("extension") == extension) if extension else out
    return out if include_deleted else out.where(~F.col("is_deleted"))


def source_paths(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with source_path, blank if the source is missing."""
    paths = sources.select("source_type", F.col("id").alias("source_record_id"), "full_path")
    return documents.join(paths, ["source_type", "source_record_id"], "left").withColumn("source_path", F.coalesce("full_path", F.lit(""))).drop("full_path")


def device_rollup(devices: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Devices with documents, versions and bytes of their live documents; each grain is aggregated before the join."""
    live = documents.where(~F.col("is_deleted"))
    docs = live.groupBy("device_code").agg(F.count(F.lit(1)).alias("documents"))
    per_doc = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    byte = live.join(per_doc, "document_id").groupBy("device_code").agg(F.sum("n").alias("versions"), F.sum("b").alias("bytes"))
    out = devices.join(docs, "device_code", "left").join(byte, "device_code", "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0).cast("long")) for k in ("documents", "versions", "bytes")})


def pending_parts(plan: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Parts of the plan that are not stored."""
    return plan.join(uploaded.select("upload_id", "part_number"), ["upload_id", "part_number"], "left_anti")


def part_plan(uploads: DataFrame) -> DataFrame:
    """(upload_id, part_number, part_offset, part_length) of every part."""
    n = uploads.select("upload_id", "size_bytes", "part_size", F.explode(F.sequence(F.lit(1).cast("long"), S.part_count("size_bytes", "part_size"))).alias("part_number"))
    offset = (F.col("part_number") - 1) * F.col("part_size")
    return n.select("upload_id", "part_number", offset.alias("part_offset"), F.least("part_size", F.col("size_bytes") - offset).cast("long").alias("part_length"))


def backfill_candidates(sources: DataFrame, documents: DataFrame, versions: DataFrame, jobs: DataFrame, pipeline: str, budget: int) -> DataFrame:
    """Completed sources, whose key is (source_type, id), without a matching version that has a job of the pipeline; blank ids, tags and hashes of a source match any. The first budget, uploads before imports."""
    v, wanted = versions.alias("v"), ("object_key", "size_bytes", "modified_at", "object_version_id", "etag", "sha256")
    s = sources.where("status = 'completed'")
    # What each document's source asks of its versions is found first, so that versions move at most once, and as ids from then on.
    asked = documents.select("document_id", "source_type", F.col("source_record_id").alias("id")).join(s.select("source_type", "id", F.struct(*wanted).alias("_s")), ["source_type", "id"])
    asked = asked.select(F.col("document_id").alias("_document"), F.col("source_type").alias("_type"), F.col("id").alias("_id"), "_s")
    wild = lambda name: (F.col(f"_s.{name}") == "") | (F.col(f"_s.{name}") == F.col(f"v.{name}"))
    same = [F.col("v.document_id") == F.col("_document"), F.col("_s.object_key") == F.col("v.object_key"), F.col("_s.size_bytes") == F.col("v.size_bytes"), F.col("_s.modified_at") == F.col("v.source_modified_at")]
    same += [wild(name) for name in ("object_version_id", "etag", "sha256")]
    match = F.coalesce(functools.reduce(lambda x, y: x & y, same[1:]), F.lit(False))  # no keys of the join: versions that are dealt by their document stay where they are
    found = v.join(asked, same[0]).where(match).select("v.version_id", F.col("_type").alias("source_type"), F.col("_id").alias("id"))
    have = found.join(jobs.where(F.col("pipeline_version") == pipeline).select("version_id").distinct(), "version_id")  # a semi-join would be moved before the other join, where versions are wide
    missing = s.join(have, ["source_type", "id"], "left_anti").withColumn("priority", F.when(F.col("source_type") == "automatic_upload", 0).otherwise(1))
    top = missing.orderBy("priority", "updated_at", "id").limit(budget)
    return top.withColumn("position", F.row_number().over(Window.orderBy("priority", "updated_at", "id")))


def reconcile_storage(versions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Versions with storage_status: no_key, missing, size_mismatch or ok."""
    have = inventory.select("object_key", F.col("size_bytes").alias("stored_size"))
    status = F.when(F.trim("object_key") == "", "no_key").when(F.col("stored_size").isNull(), "missing").when(F.col("stored_size") != F.col("size_bytes"), "size_mismatch").otherwise("ok")
    return versions.join(have, "object_key", "left").withColumn("storage_status", status)


def due_log_devices(devices: DataFrame, commands: DataFrame, as_of: str, window_minutes: int, cutoff: str, n: int | None) -> DataFrame:
    """The first n devices (all, if n is None) by code that were seen within the window and have no log request open or since cutoff."""
    busy = commands.where("command_type = 'REQUEST_LOGS'").where(F.col("status").isin("pending", "sent_to_agent") | (F.col("requested_at") > S.ntz(cutoff)))
    seen = devices.where("is_active").where(S.online("last_seen_at", as_of, window_minutes)).withColumn("k", F.upper("device_code"))
    return seen.join(busy.select(F.upper("device_code").alias("k")).distinct(), "k", "left_anti").drop("k").orderBy("device_code").limit(n) if n is not None else seen.join(busy.select(F.upper("device_code").alias("k")).distinct(), "k", "left_anti").drop("k")


BREAKDOWNS = {"extension": ("file_extension", "(none)"), "device": ("device_code", "(unknown)"), "department": ("department", "(unassigned)"), "source_type": ("source_type", "(unknown)")}


def storage_stats(documents: DataFrame, versions: DataFrame, top: int = 25, sources: DataFrame | None = None, spec: dict[str, Any] | None = None, parts: int | None = None) -> DataFrame:
    """A1: (breakdown, rank, key, documents, versions, bytes) of the documents that meet spec (P1; live ones if there is none): totals, and the top keys by bytes of each breakdown, from one scan. documents, with or without versions, are counted in the total only. With parts, versions meet documents in so many tasks."""
    docs = document_filter(documents, versions, sources, spec or {})
    deal = lambda df, *by: df.repartition(parts, *by) if parts else df
    rows = deal(versions.select("document_id", F.lower("file_extension").alias("file_extension"), "size_bytes"), "document_id").join(deal(docs.select("document_id", "device_code", "department", "source_type"), "document_id"), "document_id")
    each = F.array(F.struct(F.lit("total").alias("breakdown"), F.lit("").alias("key")), *(F.struct(F.lit(b).alias("breakdown"), F.col(k).alias("key")) for b, (k, _) in BREAKDOWNS.items()))
    out = rows.select("size_bytes", F.explode(each).alias("e")).groupBy("e.breakdown", "e.key").agg(F.count(F.lit(1)).alias("versions"), F.sum("size_bytes").alias("bytes"))  # the keys of all breakdowns together would be nearly as many as rows
    label = F.col("key")
    for b, (_, none) in BREAKDOWNS.items():
        label = F.when((F.col("breakdown") == b) & (F.trim("key") == ""), none).otherwise(label)
    rank = F.row_number().over(Window.partitionBy("breakdown").orderBy(F.desc("bytes"), "key"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n_documents"))))
    return out.select("breakdown", "rank", label.alias("key"), F.when(F.col("breakdown") == "total", F.col("n_documents")).alias("documents"), "versions", "bytes")


def extraction_overview(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """A2: (kind, status, n) of jobs and versions; jobs that are queued, running or dead letters are counted even if there are none."""
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    named = jobs.sparkSession.createDataFrame([("job", s, 0) for s in ("queued", "running", "dead_letter")], "kind string, status string, n long")
    return count(jobs, "job", "status").unionByName(count(versions, "version", "extraction_status")).unionByName(named).groupBy("kind", "status").agg(F.sum("n").alias("n"))


def device_summary(devices: DataFrame, documents: DataFrame, versions: DataFrame, as_of: str, minutes: int = 2, status: str | None = None, inactive: bool = False) -> DataFrame:
    """A3: devices (active ones, unless inactive) with status online or offline, documents, versions and bytes; with status, those of it: another than online and offline gives none. To be listed by summary_order()."""
    out = device_rollup(devices if inactive else devices.where("is_active"), documents, versions)
    out = out.withColumn("status", F.when(S.online("last_seen_at", as_of, minutes), "online").otherwise("offline"))
    return out if status is None else out.where(F.col("status") == status.lower())


def file_metadata(versions: DataFrame, documents: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Versions with their document's name, the content type that holds (detected, else declared), and their derivatives by kind and ordinal, each with a file name: the version's without its extension, kind and ordinal."""
    x = derivatives.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("kind", "ordinal"))).alias("list"))
    out = versions.join(documents.select("document_id", "display_name"), "document_id").join(x, "version_id", "left")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    names = F.transform("list", lambda e: F.concat_ws("-", stem, e["kind"], e["ordinal"].cast("string")))
    kind = F.when(F.trim("detected_content_type") != "", F.col("detected_content_type")).otherwise(F.col("declared_content_type"))
    return out.withColumn("derivatives", F.coalesce(names, F.array().cast("array<string>"))).withColumn("content_type", kind).drop("list")


def summary_order() -> list[Column]:
    """The order of A3: seen or registered last first."""
    return [F.coalesce("last_seen_at", "registered_at").desc_nulls_last(), F.asc("device_code")]


def import_user_breakdown(files: DataFrame) -> DataFrame:
    """A5: counts and bytes by job, user folder and device."""
    has = lambda *s: F.col("status").isin(*s)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size_bytes"))), F.lit(0).cast("long"))
    kept = ~has("skipped")
    return files.groupBy("import_job_id", "user_folder", "device_code").agg(
        F.count_if(kept).alias("indexed_files"), size(kept).alias("indexed_bytes"), F.count_if(has("completed")).alias("completed_files"), size(has("completed")).alias("completed_bytes"),
        F.count_if(has("failed", "missing")).alias("failed_files"), F.count_if(has("skipped")).alias("skipped_files"),
    )


def import_job_rollup(files: DataFrame) -> DataFrame:
    """Counters of each import job, and its final status when nothing is left to do."""
    has = lambda *s: F.col("status").isin(*s)
    out = files.groupBy("import_job_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(has("completed")).alias("completed"),
        F.count_if(has("failed", "missing")).alias("failed"), F.count_if(has("skipped")).alias("skipped"), F.count_if(has("indexed", "uploading")).alias("open"),
    )
    return out.withColumn("final_status", F.when(F.col("open") > 0, "").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def scan_summary(scanned: DataFrame, extensions: list[str], max_size: int) -> DataFrame:
    """Files, bytes, skipped and ignored (by extension) of each user folder."""
    kept = S.norm_ext("extension").isin(*extensions)
    ok = kept & (F.col("size_bytes") > 0) & (F.col("size_bytes") <= max_size)
    return scanned.groupBy("user_folder").agg(
        F.count_if(ok).alias("files"), F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0).cast("long")).alias("bytes"), F.count_if(kept & ~ok).alias("skipped"), F.count_if(~kept).alias("ignored")
    )


def folder_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Each folder against its last run: failed, stopped, new N, done_skipped or done. current: root, folder, files; history: root, folder, files, failed, skipped, stopped."""
    h = history.select("root", "folder", F.col("files").alias("old_files"), "failed", "skipped", "stopped")
    new = F.col("files") - F.coalesce("old_files", F.lit(0))
    state = F.when(F.col("failed") > 0, "failed").when(F.col("stopped"), "stopped").when(new > 0, F.concat(F.lit("new "), new.cast("string"))).when(F.col("skipped") > 0, "done_skipped").otherwise("done")
    return current.join(h, ["root", "folder"], "left").withColumn("state", state).withColumn("fully_done", F.col("state").isin("done", "done_skipped"))


def document_detail(documents: DataFrame, versions: DataFrame, derivatives: DataFrame) -> DataFrame:
    """A10: documents with their versions, newest first, each with its distinct derivative kinds."""
    kinds = derivatives.groupBy("version_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    v = versions.join(kinds, "version_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    item = F.struct((-F.col("version_number")).alias("order"), "version_number", "version_id", "file_name", "size_bytes", "extraction_status", "kinds")
    return documents.join(v.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("versions")), "document_id", "left")


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version of each document, by aggregation."""
    fields = [c for c in versions.columns if c != "document_id"]
    return versions.groupBy("document_id").agg(F.max_by(F.struct(*fields), "version_number").alias("v")).select("document_id", "v.*")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """K1: rows offset to offset + limit in order (which ends in a unique key), with total_count, position and next_offset (null on the last page)."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    rows = df.orderBy(*order).limit(offset + limit)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("position") >= offset)
    rows = rows.crossJoin(F.broadcast(total))
    return rows.withColumn("next_offset", F.when(F.col("total_count") > offset + limit, F.lit(offset + limit)).cast("long"))


def after(df: DataFrame, order: list[tuple[str, bool]], key: str | None) -> DataFrame:
    """K1: the rows that come after a continuation key in order, a list of (column, descending) that ends in a unique column; all rows if key is null. Nulls come first ascending and last descending."""
    if key is None:
        return df
    known = json.loads(key)
    past, same = F.lit(False), F.lit(True)
    for name, descending in order:
        c, v = F.col(name), F.lit(known.get(name)).cast(df.schema[name].dataType)
        if known.get(name) is None:
            step = F.lit(False) if descending else c.isNotNull()
        else:
            step = (c < v) | c.isNull() if descending else c > v
        past, same = past | (same & step), same & c.eqNullSafe(v)
    return df.where(past)


def seek_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, key: str | None = None) -> DataFrame:
    """K1 by continuation: the first limit rows after key, each with the key that goes on after it (of the last row: the next page). A top-k over the rows after the key, however deep the page; rows that arrive before the key shift nothing."""
    rows = after(df, order, key).orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in order)).limit(limit)
    return rows.withColumn("continuation", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c, _ in order))))


SORTS = {"updated": "updated_at", "created": "created_at", "name": "display_name", "size": "max_size"}


def listing_order(sort: str = "updated", descending: bool = True) -> list[tuple[str, bool]]:
    """K2: the order of a listing, for seek_page."""
    return [(SORTS[sort], descending), ("document_id", False)]


def list_documents(documents: DataFrame, versions: DataFrame, sources: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """K2: filtered documents with what a listing shows, in no order; page and seek_page cut pages from it."""
    docs = document_filter(documents, versions, sources, spec)
    item = F.struct("file_name", "file_extension", "size_bytes", "extraction_status", "source_modified_at")
    per = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("version_count"), F.max("size_bytes").alias("max_size"), F.max_by(item, "version_number").alias("v"))
    out = source_paths(docs, sources).join(per, "document_id", "left")
    return out.select(
        "document_id", "display_name", "created_at", "updated_at", "source_path", F.coalesce("version_count", F.lit(0).cast("long")).alias("version_count"), F.coalesce("max_size", F.lit(0).cast("long")).alias("max_size"),
        F.coalesce("v.file_name", "display_name").alias("file_name"), F.coalesce("v.file_extension", F.lit("")).alias("file_extension"),
        F.coalesce("v.size_bytes", F.lit(0).cast("long")).alias("size_bytes"), F.coalesce("v.extraction_status", F.lit("none")).alias("extraction_status"), F.col("v.source_modified_at").alias("modified_at"),
    )


def recent_failures(jobs: DataFrame, versions: DataFrame, n: int) -> DataFrame:
    """K3: the n newest jobs that failed or carry an error."""
    bad = jobs.where(F.col("status").isin("dead_letter", "retry_wait") | (F.col("error_code") != ""))
    return bad.join(versions.select("version_id", "document_id", "file_name"), "version_id").orderBy(F.desc("updated_at"), "job_id").limit(n)


def sync_batches(files: DataFrame, size: int, id_column: str = "seq") -> DataFrame:
    """K4: pending files with batch, in id order, size to a batch, by device."""
    files = files.where("sync_status = 'pending'")
    w = Window.partitionBy("device_code").orderBy(id_column)
    return files.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def claimable_import_files(files: DataFrame, n: int, as_of: str | None = None) -> DataFrame:
    """K5: the first n files of each job that are open and whose lease, if any, is over."""
    free = F.lit(True) if "lease_until" not in files.columns else F.col("lease_until").isNull() | (F.col("lease_until") <= S.ntz(as_of))
    w = Window.partitionBy("import_job_id").orderBy("user_folder", "full_path", "id")
    return files.where(F.col("status").isin("indexed", "uploading") & free).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def list_import_files(files: DataFrame, folder: str | None, status: str | None, text: str | None) -> DataFrame:
    """K6: import files that meet all given conditions."""
    for name, value in (("user_folder", folder), ("status", status)):
        if value:
            files = files.where(F.col(name) == value)
    return files.where(S.contains_ci("file_name", text) | S.contains_ci("relative_path", text)) if text else files


def attach_document_ids(feed: DataFrame, documents: DataFrame) -> DataFrame:
    """Feed (id, source_type, ...) with the document made of each row, null if there is none."""
    docs = documents.select("source_type", F.col("source_record_id").alias("id"), "document_id")
    return feed.join(docs, ["source_type", "id"], "left")


FEED_ORDER = [("at", True), ("id", False), ("source_type", False)]


def ingestion_feed(sources: DataFrame, documents: DataFrame, source: str | None = None, device: str | None = None, status: str | None = None) -> DataFrame:
    """O1: both kinds of source in one shape with the document made of each, in no order; newest first by FEED_ORDER, paged with total by page or by seek_page. Filters: kind of source and status in lower case, device in upper case; blank ones do not filter."""
    feed = sources.select("id", "source_type", "device_code", "file_name", "size_bytes", "status", F.col("updated_at").alias("at"))
    for column, value in (("source_type", (source or "").strip().lower()), ("device_code", (device or "").strip().upper()), ("status", (status or "").strip().lower())):
        if value:
            feed = feed.where(F.col(column) == value)
    return attach_document_ids(feed, documents)


def distinct_paths(requests: DataFrame, column: str = "requested_paths_json", most: int = 200) -> DataFrame:
    """O3: requests with paths (trimmed, not blank, distinct) and error if there are more than most."""
    paths = F.array_distinct(F.filter(F.transform(F.from_json(column, "array<string>"), lambda p: F.trim(p)), lambda p: p != ""))
    return requests.withColumn("paths", F.coalesce(paths, F.array().cast("array<string>"))).withColumn("error", F.when(F.size("paths") > most, "too many paths").otherwise(""))
