"""Streams without own state machines: upserts, de-duplication and interval joins, and how to run one to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.sources.scratch import exists, forget, new_dir
from foliant.streaming.stateful import recent_media


def run_available(stream: DataFrame) -> DataFrame:
    """What is there now, run to its end into Parquet in the shared folder, as a table."""
    spark = stream.sparkSession
    out, log = new_dir(spark, "stream"), new_dir(spark, "stream-log")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_catalog_stream(items: DataFrame, path: str, checkpoint: str, order: str = "ingested_at") -> StreamingQuery:
    """Each micro-batch replaces the days it holds; of an item's versions the one that came in last wins.

    A day is merged with what is stored for it, so a batch with some of a day's items keeps the others.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        # Held: what is stored and what comes in are each read once, and a folder can't be replaced while it is read.
        held, aside = new_dir(spark, "upsert"), new_dir(spark, "upsert")
        batch.write.parquet(held)
        came = spark.read.schema(batch.schema).parquet(held)
        if exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path)
            came = came.unionByName(stored.join(came.select("approve_day").distinct(), "approve_day", "left_semi").select(batch.columns))
        newest = Window.partitionBy("approve_day", "news_item_id").orderBy(F.desc(order))
        came.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn").write.parquet(aside)
        spark.read.schema(batch.schema).parquet(aside).write.partitionBy("approve_day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        forget(spark, held)
        forget(spark, aside)

    return items.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_requests(requests: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """T4: each key once within ``delay``; a repetition that comes later than that passes."""
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def media_for_messages(messages: DataFrame, media: DataFrame, minutes: int = 15, delay: str = "1 minute") -> DataFrame:
    """Each message with the newest Markdown file that its sender sent in the ``minutes`` before it, or null.

    Messages and files of a sender meet in slots of time, each once, in order; no message meets all files of its minutes. A message
    comes out once the watermark has passed it. Of files of one time the last path counts.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    one = lambda df, name: df.withWatermark("ts", delay).select(F.col("sender").cast("string"), "ts", us, F.lit(name == "path").alias("is_file"), F.col(name).cast("string").alias("name"))
    files = media.where(F.lower("path").rlike(r"\.(md|markdown)$") & F.col("sender").isNotNull())
    found = recent_media(one(messages, "message_id").unionByName(one(files, "path")).where("us is not null"), minutes * 60_000_000)
    kind = {f.name: f.dataType for f in messages.schema}
    at = lambda c: F.timestamp_micros(c).cast(kind["ts"])
    return found.select(F.col("message").cast(kind["message_id"]).alias("message_id"), F.col("sender").cast(kind["sender"]), at("us").alias("ts"), "path", at("media_us").alias("media_ts"))


def table_stream(spark: SparkSession, sf: str, name: str, schema: str) -> DataFrame:
    """One of the given tables as a stream of its files.

    The path is a pattern, for a source takes a plain path for a folder and a table may be one file.
    """
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")
