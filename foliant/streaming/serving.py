"""A day-by-day catalog that requests refresh as they come, and that goes on serving when a refresh fails.

A request asks for one day. Where the freshness rule says so the day is fetched anew: a fetch that comes through
replaces the day's items; one that fails leaves the stored ones, which are served with a mark, or fails the
request when there are none. Each micro-batch is decided as if its requests had come one by one.

What a batch leaves behind is named by its number: its answers and the state of all days after it. A batch that is run
again reads the state before it and writes the same folders anew, so replays change nothing. Items carry the
fetch that brought them; a reader takes those of each day's newest fetch, so that a batch that stops half-way
through leaves no mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.catalog import refresh_due
from foliant.operators.scans import segmented, spaced_picks
from foliant.sources.scratch import exists, forget, new_dir

#: State of a day: the fetch whose items are stored, when it was made and how many items it brought.
DAYS = "day date, last_refreshed_at timestamp, fetch_id long, items long"
ANSWERS = "request_id long, day date, asked_at timestamp, answer string, reason string, last_refreshed_at timestamp, fetch_id long, items long"


def answer_requests(requests: DataFrame, sizes: DataFrame, days: DataFrame, max_age_s: int = 3600) -> DataFrame:
    """The answer to each request, in order of (asked_at, request_id), given the state of all days before.

    ``requests``: request_id, day, asked_at, ok and reason of what a fetch at that time comes to; ``sizes``: fetch_id and
    items, the number of rows that the fetch of a request brings. Answers: refreshed, fresh (nothing was due), stale
    (the fetch failed, stored items are served, with the reason) or failed (it failed and no item is stored).

    Fetches of a day that is not over are at least ``max_age_s`` apart, so each hangs on the one before; these chains
    are followed by pointers. A past day is fetched until it has items, which is a running count.
    """
    had = days.select("day", F.struct(F.col("last_refreshed_at").alias("at"), "fetch_id", "items").alias("had"))
    brings = sizes.select(F.col("fetch_id").alias("request_id"), F.col("items").alias("brings"))
    asked = requests.join(brings, "request_id", "left").join(had, "day", "left")
    asked = asked.select(
        "request_id", "day", "asked_at", "reason", "had", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("brings", F.lit(0)).alias("brings"), (F.col("day") < F.to_date("asked_at")).alias("past")
    )
    open_ok = asked.where(~F.col("past") & F.col("ok"))
    first = open_ok.groupBy("day").agg(F.min("asked_at").alias("first"))
    # A chain starts at the stored fetch, or at a day's first one.
    chain = open_ok.join(first, "day").select("day", "asked_at", (F.col("had").isNull() & (F.col("asked_at") == F.col("first"))).alias("start"))
    before = open_ok.where("had is not null").select("day", F.col("had.at").alias("asked_at"), F.lit(True).alias("start")).distinct()
    picks = spaced_picks(chain.unionByName(before), ["day"], "asked_at", max_age_s, "start")
    at = F.unix_micros("asked_at")
    fetched = open_ok.where(F.col("had").isNull() | (F.col("asked_at") > F.col("had.at"))).withColumn("at", at).join(picks, ["day", "at"], "left_semi")
    fetched = fetched.groupBy("day", "at").agg(F.min("request_id").alias("request_id")).select("request_id", F.lit(True).alias("fetched"))
    order = ["asked_at", "request_id"]
    told = asked.join(fetched, "request_id", "left")
    filled = (F.col("past") & F.col("ok") & (F.col("brings") > 0)).cast("int")
    told = segmented(told, ["day"], order, sums={"filled": filled}, lasts={"open_items": F.when(F.col("fetched"), F.col("brings"))})
    empty = (F.coalesce("open_items", "had.items", F.lit(0)) == 0) & (F.col("filled") == filled)
    refreshed = F.coalesce("fetched", F.lit(False)) | (F.col("past") & F.col("ok") & empty)
    state = F.struct(F.col("asked_at").alias("at"), F.col("request_id").alias("fetch_id"), F.col("brings").alias("items"))
    told = segmented(told.withColumn("refreshed", refreshed), ["day"], order, lasts={"now": F.when(F.col("refreshed"), state)})
    told = told.withColumn("now", F.coalesce("now", "had"))
    due = refresh_due(F.col("day"), F.to_date("asked_at"), F.coalesce("now.items", F.lit(0)), F.col("now.at"), F.col("asked_at"), max_age_s)
    answer = F.when(F.col("refreshed"), "refreshed").when(~due, "fresh").when(F.coalesce("now.items", F.lit(0)) > 0, "stale").otherwise("failed")
    return told.select(
        "request_id", "day", "asked_at", answer.alias("answer"), F.when(answer.isin("stale", "failed"), F.col("reason")).alias("reason"),
        F.col("now.at").alias("last_refreshed_at"), F.col("now.fetch_id").alias("fetch_id"), F.coalesce("now.items", F.lit(0)).cast("long").alias("items"),
    )


def _days(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The state of all days before ``batch_id``; a small table, one row a day."""
    at = f"{path}/days/batch_id={batch_id - 1}"
    return spark.read.schema(DAYS).parquet(at) if exists(spark, at) else spark.createDataFrame([], DAYS)


def serve_catalog_stream(requests: DataFrame, fetches: DataFrame, path: str, checkpoint: str, max_age_s: int = 3600) -> StreamingQuery:
    """Answers, items and the state of days under ``path``, from a stream of requests.

    ``fetches`` has the landed rows of every fetch: fetch_id (the request's id), news_item_id and any more columns.
    """

    def serve(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = new_dir(spark, "requests")
        batch.write.parquet(held)  # the batch is read several times below
        asked = spark.read.schema(batch.schema).parquet(held)
        days = _days(spark, path, batch_id)
        wanted = fetches.join(asked.where("ok").select(F.col("request_id").alias("fetch_id")), "fetch_id", "left_semi")
        sizes = wanted.groupBy("fetch_id").agg(F.count(F.lit(1)).alias("items"))
        answer_requests(asked, sizes, days, max_age_s).write.mode("overwrite").parquet(f"{path}/answers/batch_id={batch_id}")
        answers = spark.read.schema(ANSWERS).parquet(f"{path}/answers/batch_id={batch_id}")
        newest = answers.where("answer = 'refreshed'").groupBy("day").agg(F.max_by(F.struct("last_refreshed_at", "fetch_id", "items"), F.struct("asked_at", "request_id")).alias("s")).select("day", "s.*")
        brought = wanted.join(newest.select("fetch_id", F.col("day").alias("approve_day"), F.col("last_refreshed_at").alias("fetched_at")), "fetch_id")
        brought.write.partitionBy("approve_day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/items")
        after = days.join(newest, "day", "left_anti").unionByName(newest)
        after.write.mode("overwrite").parquet(f"{path}/days/batch_id={batch_id}")
        forget(spark, held)
        forget(spark, f"{path}/days/batch_id={batch_id - 2}")

    return requests.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(f"{path}/answers/*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Each day's items as of its newest fetch, with when that was. Days are pruned by ``approve_day``."""
    states = spark.read.schema(f"{DAYS}, batch_id long").option("basePath", f"{path}/days").parquet(f"{path}/days/*")
    newest = states.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("batch_id")))).where("k = 1")
    current = newest.select(F.col("day").alias("approve_day"), "fetch_id", "last_refreshed_at")
    return spark.read.parquet(f"{path}/items").drop("fetched_at").join(current, ["approve_day", "fetch_id"])
