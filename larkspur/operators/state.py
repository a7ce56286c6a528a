"""Merges and transitions of state tables: the current table and a change set in, the new table out. Applying a change set twice gives what applying it once gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scalars as S


def newest(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The row of each key that comes last by order, by aggregation."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*keys, "r.*")


def merge_file_index(current: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("device_code", "full_path")) -> DataFrame:
    """M1: blank paths are dropped, the last of a batch wins (by seq), all fields are overwritten, untouched rows stay. current has one row a key, without nulls; a current that is bucketed by the keys is not shuffled."""
    new = newest(batch.where(F.trim(keys[1]) != ""), [*keys], "seq")
    c = current.select(*keys, F.struct(*(x for x in current.columns if x not in keys)).alias("_old"))
    b = new.select(*keys, F.struct(*(x for x in current.columns if x not in keys)).alias("_new"))
    return c.join(b, [*keys], "full_outer").select(*keys, F.coalesce("_new", "_old").alias("r")).select(*keys, "r.*").select(*current.columns)


#: Fields whose change makes a scanned file pending again.
WATCHED = ("directory_path", "file_name", "extension", "size_bytes", "created_at", "updated_at")


def merge_scan(current: DataFrame, scan: DataFrame) -> DataFrame:
    """M2: upsert of a scan: pending if a watched field changed or the row was deleted; attempts start anew if size or time changed; last_seen always moves."""
    keys = ["device_code", "full_path"]
    c = current.select(*keys, F.struct(*(x for x in current.columns if x not in keys)).alias("c"))
    s = newest(scan, keys, "seq").select(*keys, F.struct(*(x for x in scan.columns if x not in keys)).alias("s"))
    both = c.join(s, keys, "full_outer")
    same = F.lit(True)
    for f in WATCHED:
        same = same & F.col(f"c.{f}").eqNullSafe(F.col(f"s.{f}"))
    content = F.col("c.size_bytes").eqNullSafe(F.col("s.size_bytes")) & F.col("c.updated_at").eqNullSafe(F.col("s.updated_at"))
    gone, new = F.col("s").isNull(), F.col("c").isNull()
    keep = lambda f: F.when(gone, F.col(f"c.{f}")).otherwise(F.col(f"s.{f}")).alias(f)
    status = F.when(gone, F.col("c.sync_status")).when(new | ~same | F.col("c.is_deleted"), "pending").otherwise(F.col("c.sync_status"))
    attempts = F.when(gone, F.col("c.attempt_count")).when(new | ~content, 0).otherwise(F.col("c.attempt_count"))
    deleted = F.when(gone, F.col("c.is_deleted")).otherwise(F.lit(False))
    return both.select(*keys, *(keep(f) for f in WATCHED), status.alias("sync_status"), attempts.cast("int").alias("attempt_count"), deleted.alias("is_deleted"), keep("last_seen"))


def mark_missing(current: DataFrame, gone: DataFrame) -> DataFrame:
    """M3: files not found are deleted, pending and missing."""
    g = gone.select("device_code", "full_path").distinct().withColumn("_gone", F.lit(True))
    out = current.join(g, ["device_code", "full_path"], "left")
    hit = F.col("_gone").isNotNull()
    return out.withColumns({"is_deleted": hit | F.col("is_deleted"), "sync_status": F.when(hit, "pending").otherwise(F.col("sync_status")), "upload_status": F.when(hit, "missing").otherwise(F.col("upload_status"))}).drop("_gone")


def decide_uploads(current: DataFrame, incoming: DataFrame, archive: bool = False) -> DataFrame:
    """M4: skip, resume or start for each incoming file, and whether an open upload is aborted.

    The same revision has equal size and time, and equal hashes where both are known. Files of an archive go by
    (import_job_id, full_path), and an aborted one with an open upload resumes.
    """
    keys = ["import_job_id", "full_path"] if archive else ["device_code", "path_identity"]
    c = current.select(*keys, F.struct("size_bytes", "modified_at", "sha256", "status", "multipart_id").alias("c"))
    out = incoming.join(c, keys, "left")
    sha = (F.col("sha256") == "") | (F.col("c.sha256") == "") | (F.lower("sha256") == F.lower("c.sha256"))
    same = F.col("c").isNotNull() & F.col("c.size_bytes").eqNullSafe(F.col("size_bytes")) & F.col("c.modified_at").eqNullSafe(F.col("modified_at")) & sha
    open_ = F.coalesce(F.trim("c.multipart_id") != "", F.lit(False))
    goes_on = F.lit(True) if archive else F.col("c.status") != "aborted"
    decision = F.when(same & (F.col("c.status") == "completed"), "skip").when(same & goes_on & open_, "resume").otherwise("start")
    return out.withColumn("decision", decision).withColumn("abort_open", (F.col("decision") == "start") & open_).drop("c")


def validate_parts(plan: DataFrame, actual: DataFrame) -> DataFrame:
    """M5: (upload_id, error) of each planned upload: blank if all parts are there with their sizes, else the first violation."""
    p = plan.select("upload_id", "part_number", F.col("part_length").alias("want"))
    a = actual.select("upload_id", "part_number", F.col("part_length").alias("got"))
    both = p.join(a, ["upload_id", "part_number"], "full_outer")
    violation = F.when(F.col("want").isNull(), "unexpected").when(F.col("got").isNull(), "missing").when(F.col("want") != F.col("got"), "size")
    item = F.when(violation.isNotNull(), F.struct("part_number", violation.alias("what")))
    out = both.groupBy("upload_id").agg(F.min(item).alias("v"), F.count("want").alias("n_want"), F.count("got").alias("n_got"))
    error = F.when(F.col("n_want") != F.col("n_got"), "part_count").when(F.col("v").isNotNull(), F.concat(F.col("v.what"), F.lit(" "), F.col("v.part_number").cast("string"))).otherwise("")
    return out.where("n_want > 0").select("upload_id", error.alias("error"))


def ensure_documents(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """M6: one document for each (type, record): device and name refreshed, new ones unclassified; new ids are hashes of the key."""
    keys = ["source_type", "source_record_id"]
    s = sources.select("source_type", F.col("id").alias("source_record_id"), F.struct("device_code", "file_name").alias("s"))
    out = documents.select(*keys, F.struct("document_id", "device_code", "display_name", "classification", "department").alias("d")).join(s, keys, "full_outer")
    pick = lambda new, old: F.coalesce(F.col(f"s.{new}"), F.col(f"d.{old}")).alias(old)
    return out.select(
        F.coalesce(F.col("d.document_id").cast("string"), F.sha2(F.concat_ws(":", *keys), 256)).alias("document_id"), *keys, pick("device_code", "device_code"), pick("file_name", "display_name"),
        F.coalesce("d.classification", F.lit("unclassified")).alias("classification"), F.coalesce("d.department", F.lit("")).alias("department"),
    )


def assign_versions(sources: DataFrame, versions: DataFrame) -> DataFrame:
    """New versions of documents: keys not seen get the next numbers, in time order. sources: document_id, source_version_key, modified_at, sha256, size_bytes; versions: document_id, source_version_key, version_number."""
    fresh = sources.join(versions.select("document_id", "source_version_key"), ["document_id", "source_version_key"], "left_anti")
    fresh = newest(fresh, ["document_id", "source_version_key"], "modified_at")
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("last"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("modified_at", "source_version_key"))
    out = fresh.join(last, "document_id", "left")
    return out.withColumn("version_number", (F.coalesce("last", F.lit(0)) + n).cast("int")).drop("last")


def fill_hashes(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Existing versions with a missing hash filled from their source; sha_conflict tells where both are known and differ, and nothing is overwritten."""
    s = sources.select("document_id", "source_version_key", F.lower("sha256").alias("new_sha"))
    out = versions.join(s, ["document_id", "source_version_key"], "left")
    new = F.coalesce("new_sha", F.lit(""))
    conflict = (F.col("sha256") != "") & (new != "") & (F.lower("sha256") != new)
    return out.withColumn("sha_conflict", conflict).withColumn("sha256", F.when(F.col("sha256") == "", new).otherwise(F.col("sha256"))).drop("new_sha")


def ensure_jobs(versions: DataFrame, jobs: DataFrame, pipeline: str, extracted: Column) -> DataFrame:
    """M7: the jobs of the pipeline that are missing: completed if the version is extracted by it, else queued; 0 of 5 attempts."""
    have = jobs.where(F.col("pipeline_version") == pipeline).select("version_id").distinct()
    out = versions.join(have, "version_id", "left_anti")
    return out.select("version_id", F.lit(pipeline).alias("pipeline_version"), F.when(extracted, "completed").otherwise("queued").alias("status"), F.lit(0).alias("attempt_count"), F.lit(5).alias("max_attempts"))


def reset_versions(versions: DataFrame, new_jobs: DataFrame) -> DataFrame:
    """M7: versions that got a queued job are queued."""
    fresh = new_jobs.where("status = 'queued'").select("version_id").distinct().withColumn("_new", F.lit(True))
    return versions.join(fresh, "version_id", "left").withColumn("extraction_status", F.when(F.col("_new").isNotNull(), "queued").otherwise(F.col("extraction_status"))).drop("_new")


def fail_versions(versions: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """M8: versions whose job becomes a dead letter by sweep_expired have failed."""
    dead = jobs.where(expired(as_of) & (F.col("attempt_count") >= F.col("max_attempts"))).select("version_id").distinct().withColumn("_dead", F.lit(True))
    return versions.join(dead, "version_id", "left").withColumn("extraction_status", F.when(F.col("_dead").isNotNull(), "failed").otherwise(F.col("extraction_status"))).drop("_dead")


def expired(as_of: str) -> Column:
    return (F.col("status") == "running") & (F.col("lease_until") <= S.ntz(as_of))


def sweep_expired(jobs: DataFrame, as_of: str) -> DataFrame:
    """M8: running jobs whose lease is over and attempts are used up become dead letters."""
    dead = F.coalesce(expired(as_of) & (F.col("attempt_count") >= F.col("max_attempts")), F.lit(False))
    return jobs.withColumn("error_code", F.when(dead, "lease_expired").otherwise(F.col("error_code"))).withColumn("status", F.when(dead, "dead_letter").otherwise(F.col("status")))


def claim_batch(jobs: DataFrame, versions: DataFrame, pipeline: str, extensions: list[str], n: int, as_of: str, owners: int = 1, lease_seconds: int = 300, trusted: bool = False) -> DataFrame:
    """The first n claimable jobs, as they are after the claim, dealt to owners, each lease with a token. A top-k, not a sort of all. trusted: only versions with a version id and a full hash."""
    due = (F.col("status").isin("queued", "retry_wait") & (F.col("next_attempt_at") <= S.ntz(as_of))) | expired(as_of)
    ok = jobs.where((F.col("pipeline_version") == pipeline) & (F.col("attempt_count") < F.col("max_attempts")) & due)
    able = versions.where(F.lower("file_extension").isin(*extensions))
    if trusted:
        able = able.where((F.col("object_version_id") != "") & F.col("sha256").rlike("^[0-9a-fA-F]{64}$"))
    ok = ok.join(able.select("version_id"), "version_id")
    order = [F.desc("priority"), F.asc("next_attempt_at"), F.asc("created_at"), F.asc("job_id")]
    top = ok.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    token = F.sha2(F.concat_ws(":", "job_id", F.col("attempt_count") + 1, F.lit(as_of)), 256)
    lease = {"lease_token": token, "lease_until": S.ntz(as_of) + F.expr(f"interval {lease_seconds} seconds"), "started_at": F.coalesce("started_at", S.ntz(as_of)), "owner": F.col("position") % owners}
    return top.withColumns({"status": F.lit("running"), "attempt_count": F.col("attempt_count") + 1, "error_code": F.lit(""), **lease})


def apply_failures(jobs: DataFrame, failures: DataFrame, as_of: str) -> DataFrame:
    """M9: jobs after failures (job_id, disposition, error, token, and message if there is one); only a failure whose token is the job's applies, one for each job. The job's lease ends with it, so a late completion finds no token; what is not tried again is over at as_of."""
    message = F.col("message") if "message" in failures.columns else F.lit("")
    f = failures.groupBy(F.col("job_id").alias("f_job"), F.col("token").alias("f_token")).agg(F.min(F.struct("disposition", F.col("error").alias("f_error"), message.alias("f_message"))).alias("f"))
    out = jobs.join(f, (F.col("job_id") == F.col("f_job")) & (F.col("lease_token") == F.col("f_token")), "left").select(*jobs.columns, "f_token", "f.*")
    hit = (F.col("status") == "running") & F.col("f_token").isNotNull()
    d = F.col("disposition")
    new = F.when(d == "reject", "rejected").when(d == "dead_letter", "dead_letter").when((d == "release") | (F.col("attempt_count") < F.col("max_attempts")), "retry_wait").otherwise("dead_letter")
    attempts = F.when(hit & (d == "release"), F.greatest(F.col("attempt_count") - 1, F.lit(0))).otherwise(F.col("attempt_count"))
    wait = F.make_dt_interval(secs=S.retry_delay("attempt_count").cast("decimal(18,6)"))
    out = out.withColumn("_new", F.when(hit, new).otherwise(F.col("status")))
    again = F.col("_new") == "retry_wait"
    later = F.when(hit & again, S.ntz(as_of) + wait).when(hit, S.ntz(as_of)).otherwise(F.col("next_attempt_at"))
    kept = lambda c, kind: F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    out = out.withColumns({
        "error_message": F.when(hit, F.col("f_message")).otherwise(kept("error_message", "string")), "completed_at": F.when(hit & ~again, S.ntz(as_of)).when(~hit, kept("completed_at", "timestamp_ntz")),
        "lease_until": F.when(~hit, kept("lease_until", "timestamp_ntz")), "lease_token": F.when(~hit, F.col("lease_token")),
    })
    out = out.withColumn("next_attempt_at", later).withColumn("attempt_count", attempts).withColumn("error_code", F.when(hit, F.col("f_error")).otherwise(F.col("error_code")))
    version = F.when(~hit, "").when(F.col("_new") == "retry_wait", "queued").when(F.col("_new") == "rejected", "rejected").otherwise("failed")
    return out.withColumn("version_status", version).withColumn("status", F.col("_new")).drop("_new", "f_token", "disposition", "f_error", "f_message")


def replace_outputs(sections: DataFrame, new: DataFrame) -> DataFrame:
    """The sections of each (version, pipeline) in new replace the old ones; others stay."""
    keys = ["version_id", "pipeline_version"]
    return sections.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def apply_completions(jobs: DataFrame, versions: DataFrame, sections: DataFrame, derivatives: DataFrame, results: DataFrame, new_sections: DataFrame, new_derivatives: DataFrame, as_of: str, parts: int | None = None) -> dict[str, DataFrame]:
    """The four tables after results (job_id, token, object_version_id, etag, sha256, page_count) whose token is that of a running job with a live lease; outputs of other results are left out.

    The outputs of their (version, pipeline) are replaced, jobs and versions completed, blank version ids and tags filled, hashes set.
    With parts, results meet jobs, and outputs the pairs that are replaced, in so many tasks.
    """
    deal = lambda df, *by: df.repartition(parts, *by) if parts else df
    keys = ["version_id", "pipeline_version"]
    live = jobs.where((F.col("status") == "running") & (F.col("lease_until") > S.ntz(as_of))).select("job_id", F.col("lease_token").alias("token"), *keys)
    one = results.groupBy("job_id", "token").agg(F.min(F.struct("object_version_id", "etag", "sha256", "page_count")).alias("r"))
    done = one.join(live, ["job_id", "token"])
    ids = ("job_id", "token")
    pairs = deal(deal(live, *ids).join(deal(results.select(*ids), *ids), [*ids], "left_semi").select(*keys), *keys)
    replaced = lambda old, new: deal(old, *keys).join(pairs, keys, "left_anti").unionByName(deal(new, *keys).join(pairs, keys, "left_semi").select(*old.columns))
    j = jobs.join(done.select("job_id", F.lit(True).alias("_hit")), "job_id", "left")
    hit = F.col("_hit").isNotNull()
    j = j.withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "error_code": F.when(hit, "").otherwise(F.col("error_code")), "lease_until": F.when(~hit, F.col("lease_until")), "lease_token": F.when(~hit, F.col("lease_token"))}).drop("_hit")
    count = new_sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    last = done.join(count, keys, "left").groupBy("version_id").agg(F.max(F.struct("pipeline_version", F.coalesce("k", F.lit(0).cast("long")).alias("k"), "r")).alias("_n"))  # of several pipelines at once, the last by name
    v = versions.join(last, "version_id", "left")
    hit = F.col("_n").isNotNull()
    fill = lambda c: F.when(hit & (F.col(c) == ""), F.col(f"_n.r.{c}")).otherwise(F.col(c))
    put = lambda c, new: F.when(hit, new).otherwise(F.col(c))
    v = v.withColumns({
        "object_version_id": fill("object_version_id"), "etag": fill("etag"), "sha256": put("sha256", F.col("_n.r.sha256")), "extraction_status": put("extraction_status", F.lit("completed")), "page_count": put("page_count", F.col("_n.r.page_count")),
        "section_count": put("section_count", F.col("_n.k")), "pipeline_version": put("pipeline_version", F.col("_n.pipeline_version")),
    }).drop("_n")
    return {"jobs": j, "versions": v, "sections": replaced(sections, new_sections), "derivatives": replaced(derivatives, new_derivatives)}


def validate_derivatives(derivatives: DataFrame) -> DataFrame:
    """(version_id, pipeline_version, kind, ordinal, problem) of derivatives that may not be stored."""
    keys = ["version_id", "pipeline_version", "kind", "ordinal"]
    twice = derivatives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate ordinal").alias("problem"))
    bad = F.when((F.col("ordinal") < 0) | (F.col("size_bytes") < 0), "negative number").when((F.trim("kind") == "") | (F.length("kind") > 64), "bad kind").when(F.trim("object_key") == "", "no object key")
    bad = bad.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "bad sha")
    return twice.unionByName(derivatives.withColumn("problem", bad).where("problem IS NOT NULL").select(*keys, "problem"))


def validate_outputs(sections: DataFrame, longest: int = 50_000) -> DataFrame:
    """(version_id, pipeline_version, ordinal, problem) of sections that may not be stored."""
    keys = ["version_id", "pipeline_version", "ordinal"]
    twice = sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate ordinal").alias("problem"))
    text = F.length(F.concat("content", "ocr_content"))
    bad = F.when(F.col("ordinal") < 0, "negative ordinal").when(text == 0, "no text").when(text > longest, "too long").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "bad sha")
    bad = bad.when((F.trim("section_type") == "") | (F.length("section_type") > 64), "bad type").when(F.length("heading") > 1000, "long heading").when(F.try_parse_json("locator").isNull(), "bad json")
    return twice.unionByName(sections.withColumn("problem", bad).where("problem IS NOT NULL").select(*keys, "problem"))


def requeue(jobs: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The asked jobs with outcome: refused if running, else queued anew, without lease, error, heartbeat and time of completion."""
    out = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi").withColumn("outcome", F.when(F.col("status") == "running", "refused").otherwise("queued"))
    free = F.col("outcome") == "queued"
    put = {"attempt_count": 0, "error_code": "", "error_message": "", "lease_owner": ""}
    none = ("lease_token", "lease_until", "heartbeat_at", "completed_at")
    out = out.withColumns({c: F.when(free, v).otherwise(F.col(c)) for c, v in put.items() if c in jobs.columns} | {c: F.when(~free, F.col(c)) for c in none if c in jobs.columns})
    return out.withColumns({"status": F.when(free, "queued").otherwise(F.col("status")), "next_attempt_at": F.when(free, S.ntz(as_of)).otherwise(F.col("next_attempt_at"))})


def reset_requeued(versions: DataFrame, requeued: DataFrame) -> DataFrame:
    """Versions after requeue or requeue_versions: those of which a job was queued or created are queued, without error code and message."""
    hit = requeued.where(F.col("outcome") != "refused").select("version_id").distinct().withColumn("_hit", F.lit(True))
    on = F.col("_hit").isNotNull()
    blank = {c: F.when(on, "").otherwise(F.col(c)) for c in ("error_code", "error_message") if c in versions.columns}
    return versions.join(hit, "version_id", "left").withColumns({"extraction_status": F.when(on, "queued").otherwise(F.col("extraction_status")), **blank}).drop("_hit")


def requeue_versions(jobs: DataFrame, versions: DataFrame, ids: DataFrame, as_of: str, pipeline: str) -> DataFrame:
    """(version_id, job_id, pipeline_version, status, attempt_count, error_code, lease_token, lease_until, next_attempt_at, outcome) of the asked versions: refused where a job runs, else their least job queued anew without lease, or a job created under the version's own pipeline (pipeline if blank). Unknown ids have no row."""
    v = versions.join(ids.select("version_id").distinct(), "version_id", "left_semi").select("version_id", F.when(F.trim("pipeline_version") == "", pipeline).otherwise(F.col("pipeline_version")).alias("own"))
    kept = F.struct("job_id", "pipeline_version", "status", "attempt_count", "error_code", "lease_token", "lease_until", "next_attempt_at")
    j = jobs.groupBy("version_id").agg(F.min(F.struct(F.col("status") != "running", kept.alias("kept"))).alias("m")).select("version_id", "m.kept")
    out = v.join(j, "version_id", "left").withColumn("outcome", F.when(F.col("kept").isNull(), "created").when(F.col("kept.status") == "running", "refused").otherwise("queued"))
    put = lambda new, old: F.when(F.col("outcome") == "refused", F.col(f"kept.{old}")).otherwise(new).alias(old)
    return out.select(
        "version_id", F.coalesce(F.col("kept.job_id").cast("string"), F.sha2(F.concat_ws(":", "version_id", "own"), 256)).alias("job_id"), F.coalesce("kept.pipeline_version", "own").alias("pipeline_version"),
        put(F.lit("queued"), "status"), put(F.lit(0), "attempt_count"), put(F.lit(""), "error_code"), put(F.lit(""), "lease_token"), put(F.lit(None), "lease_until"), put(S.ntz(as_of), "next_attempt_at"), "outcome",
    )


def resume_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Import files after their jobs are resumed: failed and missing ones of a job that goes on uploading are indexed again, without error."""
    on = jobs.where("status <> 'completed' AND scan_done").select("import_job_id", F.lit(True).alias("_on"))
    again = F.col("_on").isNotNull() & F.col("status").isin("failed", "missing")
    out = files.join(on, "import_job_id", "left")
    return out.withColumns({"error": F.when(again, "").otherwise(F.col("error")), "status": F.when(again, "indexed").otherwise(F.col("status"))}).drop("_on")


def pause_import(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Import jobs after those asked for are paused; finished ones are left as they are."""
    asked = ids.select("import_job_id").distinct().withColumn("_asked", F.lit(True))
    hit = F.col("_asked").isNotNull() & ~F.col("status").isin("completed", "completed_with_errors")
    return jobs.join(asked, "import_job_id", "left").withColumn("outcome", F.when(F.col("_asked").isNull(), "").when(hit, "paused").otherwise("refused")).withColumn("status", F.when(hit, "paused").otherwise(F.col("status"))).drop("_asked")


def resume_import(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Import jobs (import_job_id, status, scan_done) after resume, with the number of files that are tried again."""
    bad = files.where(F.col("status").isin("failed", "missing")).groupBy("import_job_id").agg(F.count(F.lit(1)).alias("again"))
    out = jobs.join(bad, "import_job_id", "left").withColumn("again", F.coalesce("again", F.lit(0).cast("long")))
    done = F.col("status") == "completed"
    return out.withColumn("outcome", F.when(done, "refused").when(~F.col("scan_done"), "pending").otherwise("uploading")).withColumn("again", F.when(F.col("outcome") == "uploading", F.col("again")).otherwise(0))


def fold_heartbeats(devices: DataFrame, beats: DataFrame) -> DataFrame:
    """Devices after heartbeats: the newest gives host, user, version and last_seen_at; the first one registers a new device; a late one does not move last_seen_at back."""
    b = beats.groupBy("device_code").agg(F.max_by(F.struct("hostname", "username", "agent_version", "ts"), F.struct("ts", "hostname")).alias("b"), F.min("ts").alias("first_ts"))
    d = devices.select("device_code", F.struct("hostname", "username", "agent_version", "last_seen_at", "registered_at").alias("d"))
    newer = F.col("b").isNotNull() & (F.col("d.last_seen_at").isNull() | (F.col("b.ts") >= F.col("d.last_seen_at")))
    pick = lambda new, old: F.when(newer, F.col(f"b.{new}")).otherwise(F.col(f"d.{old}")).alias(old)
    out = d.join(b, "device_code", "full_outer")
    return out.select("device_code", pick("hostname", "hostname"), pick("username", "username"), pick("agent_version", "agent_version"), pick("ts", "last_seen_at"), F.coalesce("d.registered_at", "first_ts").alias("registered_at"))


def index_archive(scan: DataFrame, extensions: list[str], max_size: int, part_size: int) -> DataFrame:
    """Import rows from scanned files; a narrow projection."""
    from larkspur.operators.catalog import policy_classify

    out = policy_classify(scan, extensions, max_size, part_size)
    return out.select(
        "id", S.archive_device("user_folder").alias("device_code"), S.user_folder("relative_path").alias("user_folder"), S.norm_ext("extension").alias("extension"),
        S.object_key("archive", "user_folder", "relative_path").alias("object_key"), S.content_type("extension").alias("content_type"), F.col("policy_status").alias("status"), "reason",
    )


#: The types that a complete result may end, besides the one that removes the agent.
COMPLETABLE = ("START_SCAN", "STOP_SCAN", "START_FILE_UPLOAD", "STOP_FILE_UPLOAD")


def apply_command_results(commands: DataFrame, results: DataFrame, removal: str = "REMOVE_AGENT") -> DataFrame:
    """Commands (with completed_at) after results (command_id, device_code, kind, error, seq, at) in the order of seq: completed is final, else the last failure counts.

    logs and diagnostics complete a command of their own type; complete needs one of five types (removal is the name of the one that removes the agent) and a command that was sent or has failed, be it by an earlier result.
    """
    c = commands.select(F.col("id").alias("command_id"), F.upper("device_code").alias("owner"), "command_type", F.col("status").alias("old"))
    r = results.join(c, "command_id").where(F.upper(F.trim("device_code")) == F.col("owner"))
    failed = F.min(F.when(F.col("kind") == "fail", F.col("seq"))).over(Window.partitionBy("command_id"))
    able = F.col("command_type").isin(removal, *COMPLETABLE) & (F.col("old").isin("sent_to_agent", "failed", "completed") | F.coalesce(F.col("seq") > failed, F.lit(False)))
    done = ((F.col("kind") == "logs") & (F.col("command_type") == "REQUEST_LOGS")) | ((F.col("kind") == "diagnostics") & (F.col("command_type") == "RUN_DIAGNOSTICS")) | ((F.col("kind") == "complete") & able)
    r = r.withColumn("ends", done)
    ok, bad = F.col("ends"), F.col("kind") == "fail"
    f = r.groupBy(F.col("command_id").alias("id")).agg(F.min_by(F.when(ok, F.col("at")), F.when(ok, F.col("seq"))).alias("done_at"), F.bool_or("ends").alias("done"), F.max_by(F.when(bad, F.struct(F.coalesce("error", F.lit("")).alias("error"), "at")), F.when(bad, F.col("seq"))).alias("bad"))
    out = commands.join(f, "id", "left")
    final, done, bad = F.col("status") == "completed", F.coalesce("done", F.lit(False)), F.col("bad").isNotNull()
    pick = lambda kept, ended, failed: F.when(final, kept).when(done, ended).when(bad, failed).otherwise(kept)
    error = pick(F.lit(""), F.lit(""), F.col("bad.error"))
    out = out.withColumns({"error": error, "completed_at": pick(F.col("completed_at"), F.col("done_at"), F.col("bad.at")), "_status": pick(F.col("status"), F.lit("completed"), F.lit("failed"))})
    return out.withColumn("status", F.col("_status")).drop("_status", "done", "done_at", "bad")


def dispatch_requests(requests: DataFrame, as_of: str, n: int = 5) -> DataFrame:
    """File requests after dispatch: the oldest n pending of each device are sent_to_agent, started at as_of."""
    w = Window.partitionBy("device_code", "status").orderBy("requested_at", "id")
    out = requests.withColumn("_n", F.row_number().over(w))
    hit = (F.col("status") == "pending") & (F.col("_n") <= n)
    return out.withColumns({"started_at": F.when(hit, S.ntz(as_of)).otherwise(F.col("started_at")), "status": F.when(hit, "sent_to_agent").otherwise(F.col("status"))}).drop("_n")


def apply_request_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """File requests (with file_name, server_path, completed_at) after results (id, outcome, error, file_name, server_path, at, seq); the last wins. A completed one gets name and path and loses its error; a failed one keeps what it had."""
    r = newest(results, ["id"], "seq").select("id", F.struct("outcome", "error", "file_name", "server_path", "at").alias("r"))
    out = requests.join(r, "id", "left")
    done, any_ = F.coalesce(F.col("r.outcome") == "completed", F.lit(False)), F.col("r").isNotNull()
    status = F.when(done, "completed").when(any_, "failed").otherwise(F.col("status"))
    put = lambda c: F.when(done, F.col(f"r.{c}")).otherwise(F.col(c))
    out = out.withColumns({"file_name": put("file_name"), "server_path": put("server_path"), "completed_at": F.when(any_, F.col("r.at")).otherwise(F.col("completed_at")), "status": status})
    return out.withColumn("error", F.when(F.col("status") == "failed", F.coalesce("r.error", F.lit(""))).otherwise("")).drop("r")


def insert_agent_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New versions (version, created_at, is_active) with outcome: refused if the version exists or came earlier in new, else added. The newest of the added ones that asks to be active is it; the others are not."""
    old = versions.select("version").distinct().withColumn("_old", F.lit(True))
    first = F.row_number().over(Window.partitionBy("version").orderBy("created_at")) == 1
    out = new.withColumn("_first", first).join(old, "version", "left")
    out = out.withColumn("outcome", F.when(F.col("_old").isNotNull() | ~F.col("_first"), "refused").otherwise("added")).drop("_old", "_first")
    asks = F.when((F.col("outcome") == "added") & F.col("is_active"), F.struct("created_at", "version"))
    best = out.agg(F.max(asks).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("is_active", F.coalesce((F.col("outcome") == "added") & (F.col("version") == F.col("_best.version")), F.lit(False))).drop("_best")


def activate_version(versions: DataFrame, version: str) -> DataFrame:
    """Exactly one active version."""
    return versions.withColumn("is_active", F.col("version") == version)
