"""Quality-control reports: commands, frequencies, failures and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import stored


def command_rows(reports: DataFrame, command: str, schema: str) -> DataFrame:
    """Rows of one command's payloads; entries that are no objects are skipped."""
    payloads = reports.select(F.explode("qc_commands").alias("c")).where(F.col("c.command") == command).select("c.payload")
    rows = payloads.select(F.explode(F.from_json("payload", "array<string>")).alias("entry"))
    return rows.where(F.startswith(F.ltrim("entry"), F.lit("{"))).select(F.from_json("entry", schema).alias("r")).select("r.*")


def review_key() -> Column:
    """K6 as one ascending key: what must be reviewed, then what is worse, then the id."""
    worse = (F.col(c) for c in ("hard_finding_count", "risk_score", "finding_count"))
    keys = (~F.col("review_required"), *(-c for c in worse), F.col("sample_id"))
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys)))


def review_order(queue: DataFrame) -> DataFrame:
    """K6: the review queue in its order."""
    return queue.orderBy(review_key())


def to_review(queue: DataFrame, shown: int = 12) -> DataFrame:
    """K7: the first ``shown`` that must be reviewed; each row carries the count of all."""
    need = queue.where("review_required")
    total = need.agg(F.count(F.lit(1)).alias("total"))
    return need.orderBy(review_key()).limit(shown).crossJoin(total)  # one row


def next_in_queue(queue: DataFrame, current: str) -> DataFrame:
    """The sample after ``current``, or the first where it is unknown or the last. Two top-1 reads, no ranking."""
    keyed = queue.withColumn("__key", review_key())
    at = keyed.where(F.col("sample_id") == current).select(F.col("__key").alias("__at")).limit(1)
    after = keyed.join(F.broadcast(at), F.col("__key") > F.col("__at")).orderBy("__key").limit(1).select("sample_id", F.lit(0).alias("p"))
    first = keyed.orderBy("__key").limit(1).select("sample_id", F.lit(1).alias("p"))
    return after.unionByName(first).orderBy("p").limit(1).select("sample_id")


def queue_progress(queue: DataFrame, batch_col: str) -> DataFrame:
    """Each sample's place and index (from 0) in its batch, and the batch's size.

    The queue is range-sorted by batch and review order and written; a place is the count of the ranges before
    and the number within the range, so a large batch is spread over tasks.
    """
    ranged = stored(queue.withColumn("__key", review_key()).repartitionByRange(batch_col, "__key").withColumn("__range", F.spark_partition_id()), "queue")
    counts = ranged.groupBy(F.col(batch_col).alias("__batch"), F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    batch = Window.partitionBy("__batch")
    before = F.coalesce(F.sum("__n").over(batch.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__batch", "__of", before.alias("__before"), F.sum("__n").over(batch).alias("total"))
    number = F.row_number().over(Window.partitionBy(batch_col, "__range").orderBy("__key"))
    j = ranged.withColumn("__number", number).join(offsets, F.col(batch_col).eqNullSafe(F.col("__batch")) & (F.col("__range") == F.col("__of")))
    place = (F.col("__before") + F.col("__number")).cast("int")
    return j.withColumn("place", place).withColumn("index", place - 1).drop("__key", "__range", "__batch", "__of", "__before", "__number")


def queue_state(queue: DataFrame, batches: DataFrame, batch_col: str) -> DataFrame:
    """(batch, index, total, sample_id, status): where each batch of ``batches`` (batch, index) stands.

    A batch whose index is past its last sample is finished and has no current sample; all others are queued.
    """
    at = queue_progress(queue, batch_col).select(F.col(batch_col).alias("batch"), "index", "sample_id")
    sizes = queue.groupBy(F.col(batch_col).alias("batch")).agg(F.count(F.lit(1)).alias("total"))
    j = batches.join(sizes, "batch", "left").fillna(0, ["total"]).join(at, ["batch", "index"], "left")
    return j.select("batch", "index", "total", "sample_id", F.when(F.col("index") < F.col("total"), "queued").otherwise("finished").alias("status"))


def curated_last(samples: DataFrame) -> DataFrame:
    """By id, the curated ones at the end."""
    return samples.orderBy(F.col("status") == "curated", "sample_id")


def defect_frequency(qc: DataFrame) -> DataFrame:
    """How often each defect class needed a review, most often first."""
    return qc.where("review_required").groupBy("defect_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "defect_class")


def sample_frequency(qc: DataFrame) -> DataFrame:
    """In how many runs each sample needed a review, and the last of them."""
    a = qc.where("review_required").groupBy("sample_id").agg(F.count_distinct("run_date").alias("runs"), F.max("run_date").alias("latest_run"))
    return a.orderBy(F.desc("runs"), "sample_id")


def of_run(qc: DataFrame, run_date: str | None = None) -> DataFrame:
    """Rows of the named run, or of the latest one."""
    if run_date:
        return qc.where(F.col("run_date") == run_date)
    return qc.join(F.broadcast(qc.agg(F.max("run_date").alias("run_date"))), "run_date", "left_semi")


def qc_status(qc: DataFrame, run_date: str | None = None) -> DataFrame:
    """Counts of one run."""
    return of_run(qc, run_date).groupBy("run_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("review_required").alias("review_required_count"),
        F.count_if((F.col("command") == "regression") & ~F.col("passed")).alias("failed_count"),
    )


def qc_failures(qc: DataFrame, risk: int = 8) -> DataFrame:
    """What needs a review, what failed, and what is proposed for a fix, as one tagged table in one pass."""
    tags = F.array_compact(
        F.array(
            F.when((F.col("command") == "triage") & F.col("review_required"), "review"),
            F.when((F.col("command") == "regression") & ~F.col("passed"), "failed"),
            F.when(F.col("risk_score") >= risk, "proposal"),
        )
    )
    return qc.select("run_date", "sample_id", F.explode(tags).alias("kind"))


def evaluate_run(qc: DataFrame) -> DataFrame:
    """Per run the reasons for which it fails, and whether it does."""
    failed = (F.col("command") == "regression") & ~F.col("passed")
    a = qc.groupBy("run_date").agg(F.count_if("review_required").alias("review"), F.count_if(failed).alias("failed"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("review") > 0, F.concat(F.lit("review_required="), F.col("review").cast("string"))),
            F.when(F.col("failed") > 0, F.concat(F.lit("regression_failed="), F.col("failed").cast("string"))),
        )
    )
    return a.select("run_date", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("fails"))


def sample_stage_metrics(attempts: DataFrame) -> DataFrame:
    """A10: a sample's totals by stage, its last decision and its slowest stage (ties: inspect, fix, judge)."""
    a = attempts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.col("inspect_before_ms") + F.col("inspect_after_ms")).alias("inspect_ms"),
        F.sum("fix_ms").alias("fix_ms"),
        F.sum("judge_ms").alias("judge_ms"),
        F.max_by("decision", "attempt").alias("latest_decision"),
    )
    most = F.greatest("inspect_ms", "fix_ms", "judge_ms")
    slowest = F.when(most <= 0, "").when(F.col("inspect_ms") == most, "inspect").when(F.col("fix_ms") == most, "fix").otherwise("judge")
    return a.withColumn("bottleneck_stage", slowest)


def batch_metrics(batches: DataFrame) -> DataFrame:
    """Batches, how many are completed, and the stage with the largest total."""
    a = batches.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.trim(F.coalesce("finished_at", F.lit(""))) != "").alias("completed"),
        F.sum("inspect_ms").alias("i"), F.sum("fix_ms").alias("f"), F.sum("judge_ms").alias("j"),
    )
    most = F.greatest("i", "f", "j")
    stage = F.when(F.coalesce(most, F.lit(0)) <= 0, "").when(F.col("i") == most, "inspect").when(F.col("f") == most, "fix").otherwise("judge")
    return a.select("samples", "completed", stage.alias("slowest_stage"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Passed, deferred and other."""
    o = F.coalesce("outcome", F.lit(""))
    return rows.agg(
        F.count_if(o == "pass").alias("passed"), F.count_if(o.isin("defer", "deferred")).alias("deferred"), F.count_if(~o.isin("pass", "defer", "deferred")).alias("other")
    )
