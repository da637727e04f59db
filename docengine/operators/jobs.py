"""Jobs: content-hash reuse, expiry, status and what an interface answers. `as_of` is always given, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SECONDS, UPLOAD_SECONDS = 7200, 3600


def expired(expires_at: Column, modified: Column, as_of: Column, seconds: int = RESULT_SECONDS) -> Column:
    """At or after expires_at; without one, older than `seconds`."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))
    return F.when(expires_at.isNotNull(), expires_at <= as_of).otherwise(age > seconds)


def parse_expiry(text: Column) -> Column:
    """The time that an ISO text names; without an offset it is in UTC; null for what is no time."""
    t = F.trim(text)
    return F.try_to_timestamp(F.when(t.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z"))))


def progress(step: Column, total: Column, stage: Column) -> Column:
    """progress (percent) and message of a job that has done `step` of `total` parts."""
    done = F.round(step / total * 100, 1).cast("double")
    return F.struct(done.alias("progress"), F.format_string("Processing %s chunk %d/%d", stage, step, total).alias("message"))


def expires_at(as_of: Column, seconds: int = RESULT_SECONDS) -> Column:
    return as_of + F.make_interval(secs=F.lit(seconds))


def reuse(uploads: DataFrame, results: DataFrame, as_of: Column, reuse_failed: bool = False) -> DataFrame:
    """uploads (job_id, sha256) with cached_job and action: "reuse" where a fresh result of the same content exists, else "process".

    Of several, the smallest job_id is reused. delete_job is the job whose files go: the upload's own where another is reused, the smallest with a
    stale result of the same content where it is processed anew. Results: job_id, sha256, status, expires_at.
    """
    fresh = F.coalesce(F.col("expires_at") > as_of, F.lit(False))
    fresh = fresh if reuse_failed else fresh & (F.col("status") == "done")
    first = results.groupBy("sha256").agg(F.min(F.when(fresh, F.col("job_id"))).alias("cached"), F.min(F.when(~fresh, F.col("job_id"))).alias("stale"))
    out = uploads.join(first, "sha256", "left")
    other = F.when(F.col("cached") < F.col("job_id"), F.col("cached"))
    gone = F.when(other.isNotNull(), F.col("job_id")).when(F.col("stale") != F.col("job_id"), F.col("stale"))
    return out.withColumns({"cached_job": other, "action": F.when(other.isNotNull(), "reuse").otherwise("process"), "delete_job": gone}).drop("cached", "stale")


RETRIES, RETRY_SECONDS, RETRYABLE = 2, 10, ("OSError", "MemoryError", "FileNotFoundError", "PermissionError", "ConnectionError", "TimeoutError")


def after_error(error: Column, attempts: Column) -> Column:
    """What follows an error (its type's name) of a job that has been retried `attempts` times: retry for what may pass, fail for all else."""
    return F.when(error.isin(*RETRYABLE) & (attempts < RETRIES), "retry").otherwise("fail")


def soft_limit(seconds: int) -> int:
    """When a job is asked to end before it is ended."""
    return max(30, seconds - 30)


def cancel(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, status "cancelled", was of all of `jobs`, known or not: a cancellation always succeeds. Whoever runs them interrupts by the job's tag."""
    return jobs.select("job_id").distinct().join(states.select("job_id", F.col("state").alias("was")), "job_id", "left").select("job_id", F.lit("cancelled").alias("status"), "was")


def purged(uploads: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    """n, the number of uploads that are purged."""
    return stale_uploads(uploads, as_of, seconds).agg(F.count("*").alias("n"))


def view_status(status_: Column, view: str) -> Column:
    """What a view answers: text and tables say 202 for whatever is neither done, expired nor unknown, a failed job included."""
    if view == "status":
        return F.when(status_ == "unknown", 404).otherwise(200)
    if view in ("text", "tables"):
        return F.when(status_ == "unknown", 404).when(status_ == "expired", 410).when(status_ == "done", 200).otherwise(202)
    return http_status(status_)


def worker_state(state: Column) -> Column:
    low = F.lower(state)
    return F.when(low == "pending", "pending").when(low == "success", "done").when(low == "failure", "failed").otherwise(low)


def status(uploads: DataFrame, states: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """job_id, status, progress of every job any of the three knows: a result first, then the worker's state, then that it was uploaded."""
    r = results.select("job_id", F.col("status").alias("r_status"), expired(F.col("expires_at"), F.col("modified"), as_of).alias("gone"))
    s = states.select("job_id", worker_state(F.col("state")).alias("w_status"), F.col("progress").alias("w_progress"))
    j = uploads.select("job_id", F.lit(True).alias("up")).join(r, "job_id", "full_outer").join(s, "job_id", "full_outer")
    known = F.when(F.col("gone"), "expired").when(F.col("r_status").isNotNull(), F.col("r_status")).when(F.col("up").isNull(), "unknown")
    return j.select(
        "job_id",
        F.coalesce(known, "w_status", F.lit("processing")).alias("status"),
        F.when(F.col("gone"), 0.0).when(F.col("r_status").isNotNull(), 100.0).when(F.col("up").isNull(), 0.0).otherwise(F.coalesce("w_progress", F.lit(5.0))).alias("progress"),
    )


def http_status(status_: Column) -> Column:
    return F.when(status_ == "unknown", 404).when(status_ == "expired", 410).when(status_ == "done", 200).when(status_.isin("processing", "pending"), 202).otherwise(500)


def stale_uploads(uploads: DataFrame, as_of: Column, seconds: int = UPLOAD_SECONDS) -> DataFrame:
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("modified").cast("timestamp"))
    return uploads.where(age > seconds)
