"""Conversion jobs: each operator takes the table and gives the next version of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAVES = ("save_text", "save_result", "save_html", "save_edit")
TERMINAL = ("completed", "failed")


def upgrade_jobs(jobs: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Missing columns added, an empty token made from the id, an empty table mode made text."""
    for name, kind in (defaults or {}).items():
        if name not in jobs.columns:
            jobs = jobs.withColumn(name, F.lit(None).cast(kind))
    full = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return jobs.withColumn("edit_token", F.coalesce(full("edit_token"), F.concat(F.lit("legacy-"), "job_id"))).withColumn(
        "hwpx_table_mode", F.coalesce(full("hwpx_table_mode"), F.lit("text"))
    )


def page_jobs(jobs: DataFrame, limit: int, status: str | None = None, cursor: tuple[str, str] | None = None) -> DataFrame:
    """One page by (created_at, job_id), newest first. ``next_cursor`` of the last row names it if more follow.

    ``cursor`` is (created_at, job_id) of the last row of the page before. Only limit + 1 rows are ranked.
    """
    if status:
        jobs = jobs.where(F.col("status") == status)
    if cursor:
        at, ident = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        jobs = jobs.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("job_id") < ident)))
    order = [F.desc("created_at"), F.desc("job_id")]
    got = jobs.orderBy(*order).limit(limit + 1)
    ranked = got.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    more = F.lead("job_id").over(Window.orderBy("place")).isNotNull()
    return ranked.withColumn("next_cursor", F.when((F.col("place") == limit) & more, F.col("job_id"))).where(F.col("place") <= limit)


def claim_plan(jobs: DataFrame, workers: int, n: int) -> DataFrame:
    """The oldest ``n`` queued jobs dealt out to workers, as they look once claimed."""
    order = ["created_at", "job_id"]
    oldest = jobs.where(F.col("status") == "queued").orderBy(*order).limit(n)
    rank = F.row_number().over(Window.orderBy(*order))
    return oldest.withColumn("worker", (rank - 1) % workers).withColumn("status", F.lit("processing")).withColumn("progress", F.lit(25))


def create_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """U4: jobs and those of ``requests`` that are new. A request id that is not empty makes one job."""
    named = F.coalesce(F.col("client_request_id"), F.lit("")) != ""
    first = Window.partitionBy("client_request_id").orderBy("created_at", "job_id")
    once = requests.where(named).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    known = jobs.where(named).select("client_request_id").distinct()
    fresh = once.join(known, "client_request_id", "left_anti").unionByName(requests.where(~named))
    return jobs.unionByName(fresh.select(*jobs.columns))


def fold_job_events(events: DataFrame) -> DataFrame:
    """Current state of each job from its events, in one aggregate.

    Text and result set completed and clear errors; an edit changes no status; every save adds one to
    the version; a claim is cleared when the job is queued again.
    """
    order = F.struct("ts", "event_id")
    kind = F.col("kind")
    last = lambda value, *kinds: F.max_by(F.when(kind.isin(*kinds), value), F.when(kind.isin(*kinds), order))
    state = last(kind, "create", "claim", "save_text", "save_result", "fail")
    folded = events.groupBy("job_id").agg(
        state.alias("state"),
        F.count_if(kind.isin(*SAVES)).alias("result_version"),
        last(F.col("payload"), "save_text", "save_result").alias("markdown"),
        last(F.col("payload"), "save_html").alias("markdown_html"),
        last(F.col("payload"), "save_edit").alias("edited_markdown"),
        last(F.col("payload"), "fail").alias("last_error"),
        F.max("ts").alias("updated_at"),
    )
    s = F.col("state")
    status = F.when(s == "claim", "processing").when(s == "fail", "failed").when(s.isin("save_text", "save_result"), "completed").otherwise("queued")
    progress = F.when(s == "claim", 25).when(s.isin("fail", "save_text", "save_result"), 100).otherwise(0)
    return folded.select(
        "job_id", status.alias("status"), progress.alias("progress"), "result_version", "markdown", "markdown_html",
        "edited_markdown", F.when(s == "fail", F.col("last_error")).alias("error"), "updated_at",
    )


def save_html(jobs: DataFrame) -> DataFrame:
    """An html variant takes the primary's place only in html mode."""
    html = (F.col("hwpx_table_mode") == "html") & (F.coalesce(F.col("markdown_html"), F.lit("")) != "")
    return jobs.withColumn("markdown", F.when(html, F.col("markdown_html")).otherwise(F.col("markdown")))


def update_status(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """(job_id, new_status, new_progress, new_error) replaces status and error; a null progress keeps the old
    one, and the claim goes when the job is queued."""
    j = jobs.join(updates, "job_id", "left")
    hit = F.col("new_status").isNotNull()
    out = {
        "status": F.coalesce("new_status", "status"),
        "progress": F.coalesce("new_progress", "progress"),
        "error_code": F.when(hit, F.col("new_error")).otherwise(F.col("error_code")),
        "claimed_by": F.when(F.col("new_status") == "queued", F.lit(None)).otherwise(F.col("claimed_by")),
    }
    return j.select(*(out[c].alias(c) if c in out else c for c in jobs.columns))


def recover_incomplete(jobs: DataFrame, code: str = "worker_restarted") -> DataFrame:
    """Queued and processing jobs are queued anew; the error tells of those that were processing."""
    open_ = F.col("status").isin("queued", "processing")
    out = {
        "error_code": F.when(F.col("status") == "processing", code).otherwise(F.col("error_code")),
        "progress": F.when(open_, 0).otherwise(F.col("progress")),
        "claimed_by": F.when(~open_, F.col("claimed_by")),
        "status": F.when(open_, "queued").otherwise(F.col("status")),
    }
    return jobs.select(*(out[c].alias(c) if c in out else c for c in jobs.columns))


def _expired(now: str, hours: int, statuses: tuple[str, ...]):
    days = max(1, -(-hours // 24))
    return F.col("status").isin(*statuses) & (F.col("updated_at") < F.expr(f"timestampadd(DAY, -{days}, timestamp_ntz'{now}')"))


def expire_jobs(jobs: DataFrame, now: str, hours: int = 72, statuses: tuple[str, ...] = TERMINAL) -> tuple[DataFrame, DataFrame]:
    """U8: (kept, deleted); whole days count, at least one."""
    gone = _expired(now, hours, statuses)
    return jobs.where(~gone), jobs.where(gone)


def retry_failed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The named jobs are queued anew without errors."""
    named = ids.select("job_id").distinct().withColumn("__retry", F.lit(True))
    j = jobs.join(named, "job_id", "left")
    retry = F.coalesce("__retry", F.lit(False))
    out = {
        "status": F.when(retry, "queued").otherwise(F.col("status")),
        "progress": F.when(retry, 0).otherwise(F.col("progress")),
        "error_code": F.when(~retry, F.col("error_code")),
    }
    return j.select(*(out[c].alias(c) if c in out else c for c in jobs.columns))


def delete_jobs(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted)."""
    named = ids.select("job_id").distinct()
    return jobs.join(named, "job_id", "left_anti"), jobs.join(named, "job_id", "left_semi")


def reconcile_outcomes(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """A manual outcome takes the place of a sample's automatic ones and closes them."""
    o = overrides.select("sample_id", F.col("outcome").alias("manual"))
    j = rows.join(o, "sample_id", "left")
    return j.withColumn("outcome", F.coalesce("manual", "outcome")).withColumn("final", F.col("manual").isNotNull() | F.col("final")).drop("manual")


def recent_by_user(opened: DataFrame, k: int = 8) -> DataFrame:
    """(user, item, ts): each user's ``k`` items opened last, each once."""
    last = opened.groupBy("user", "item").agg(F.max("ts").alias("ts"))
    rank = Window.partitionBy("user").orderBy(F.desc("ts"), "item")
    return last.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
