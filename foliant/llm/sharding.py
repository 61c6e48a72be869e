"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

A record is hashed into one of a fixed number of slots, thousands of them, and never leaves its slot. Bytes
are added up per slot, and a small map says which shard holds which slot. A new map starts with the slots dealt
out in turn; rebalancing edits it: a shard keeps its largest slots up to a fair share of all bytes, the rest
moves, largest first, to whichever shard has least. Every edit is a new version, so a reader of an older version
finds its records where they were. Adding a shard is an edit that moves slots only into the new one.

The law that holds is ``bytes``: shards are as near in size as slots allow. A slot that holds more than a
quarter of a shard's share (a key that many rows repeat) is split into parts, by record and row number, and its
parts are mapped like slots. A record larger than a fair share is a shard's whole load.

Texts are measured where they are read and never shuffled; the rows that move have five numbers each. A row's
place in its shard is its slot's offset in the shard plus its rank in the slot, so no task orders a whole shard.
The map has at most ``slots + 4 * shards`` entries whatever the table's size, which is what bounds its broadcast.

Null and empty texts have no bytes and weigh 16. A null id is hashed like any other. Repeated rows each get a
place of their own. A very long text is one record. An empty table gives an empty result and an even map.
Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._shared import durable, new_path, require, table

SHARDS = 40
SLOTS = 4096
#: Bytes of a record besides its text.
OVERHEAD = 16
#: A slot above this part of a fair share is split.
SPLIT = 0.25


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, record (a hash of id and text), row number and slot of each row."""
    text = F.coalesce(F.col("t"), F.lit(""))
    return (
        require(docs, id_col, text_col)
        .select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
        .select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("doc_id", text).alias("record"),
            F.monotonically_increasing_id().alias("n"),
        )
        .withColumn("slot", F.pmod("record", F.lit(slots)).cast("int"))
    )


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("record", "n"), parts).cast("int")


def slot_loads(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, part, parts, bytes, records: the load of every slot, empty ones included, hot ones by part."""
    whole = rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    total = whole.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    share = F.col("total") * SPLIT / shards
    parts = F.greatest(F.lit(1), F.least(F.col("records"), F.ceil(F.col("bytes") / F.greatest(share, F.lit(1.0))))).cast("int")
    known = durable(whole.crossJoin(F.broadcast(total)).select("slot", parts.alias("parts"), "bytes", "records"))  # the total is one row
    hot = known.where("parts > 1")
    by_part = (
        rows.join(F.broadcast(hot.select("slot", "parts")), "slot")
        .groupBy("slot", "parts", _part(F.col("parts")).alias("part"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
        .select("slot", "part", "bytes", "records")
    )
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(known.select("slot", "parts"), "slot", "left")
    every = every.select("slot", F.coalesce("parts", F.lit(1)).alias("parts"))
    every = every.select("slot", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    loads = known.where("parts = 1").select("slot", F.lit(0).alias("part"), "bytes", "records").unionByName(by_part)
    return every.join(loads, ["slot", "part"], "left").select(
        "slot", "part", "parts", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("records", F.lit(0)).alias("records")
    )


def even_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    return loads.select(F.lit(1).alias("version"), "slot", "part", "parts", "bytes", "records", F.pmod(F.col("slot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"))


def _kept_and_moved(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map with ``stays``: whether the slot is among the largest of its shard that fit a fair share."""
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    share = slot_map.agg(F.ceil(F.coalesce(F.sum("bytes"), F.lit(0)) / shards).alias("share"))
    return (
        slot_map.crossJoin(F.broadcast(share))  # one row
        .withColumn("stays", (F.sum("bytes").over(largest_first) <= F.col("share")) & (F.col("shard") < shards))
        .drop("share")
    )


def rebalance(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version: what is above a fair share moves, largest first, to the shard with least.

    ``slot_map`` is one version of the map. Shards from ``shards`` on are given up. The fold runs over the moved entries
    of the map, whose number does not grow with the table.
    """
    marked = _kept_and_moved(slot_map, shards)
    kept = F.map_from_entries(F.collect_list(F.struct("shard", "load")))
    begun = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load")).agg(kept.alias("kept"))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.col("kept")[s], F.lit(0)).cast("long"))
    moved = marked.where(~F.col("stays")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "slot", "part", "bytes"))).alias("moved")
    )

    def place(state: Column, entry: Column) -> Column:
        # The shard with least comes in with the state, so that it is found once an entry.
        loads = F.transform(state["loads"], lambda load, s: F.when(s == state["least"], load + entry["bytes"]).otherwise(load))
        return F.struct(
            loads.alias("loads"),
            (F.array_position(loads, F.array_min(loads)) - 1).cast("int").alias("least"),
            F.concat(state["to"], F.array(state["least"])).alias("to"),
        )

    first = F.struct(
        start.alias("loads"), (F.array_position(start, F.array_min(start)) - 1).cast("int").alias("least"), F.array().cast("array<int>").alias("to")
    )
    target = (
        begun.crossJoin(moved)  # one row each
        .withColumn("to", F.aggregate("moved", first, place)["to"])
        .select(F.explode(F.arrays_zip("moved", "to")).alias("e"))
        .select(F.col("e.moved.slot").alias("slot"), F.col("e.moved.part").alias("part"), F.col("e.to").alias("to"))
    )
    return _next(marked, target)


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with one shard more than ``shards``: slots above the new fair share move into it, and no other moves."""
    marked = _kept_and_moved(slot_map, shards + 1)
    return _next(marked, marked.where(~F.col("stays")).select("slot", "part", F.lit(shards).alias("to")))


def _next(marked: DataFrame, target: DataFrame) -> DataFrame:
    return marked.join(target, ["slot", "part"], "left").select(
        (F.col("version") + 1).alias("version"), "slot", "part", "parts", "bytes", "records", F.coalesce("to", "shard").alias("shard")
    )


def save_version(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored map; the versions before it stay readable. The same version written again replaces itself."""
    slot_map.write.partitionBy("version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest unless one is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]  # one number
    return stored.where(F.col("version") == version).select("version", "slot", "part", "parts", "bytes", "records", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place there, without gaps."""
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    entries = slot_map.select("version", "slot", "part", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("base"))
    split = slot_map.where("parts > 1").select("slot", "parts").distinct()
    in_slot = Window.partitionBy("virtual_slot", "part").orderBy("record", "n")
    return (
        rows.withColumnRenamed("slot", "virtual_slot")
        .join(F.broadcast(split.withColumnRenamed("slot", "virtual_slot")), "virtual_slot", "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(_part(F.coalesce("parts", F.lit(1)))))
        .withColumn("rank", F.row_number().over(in_slot))
        .join(F.broadcast(entries.withColumnRenamed("slot", "virtual_slot")), ["virtual_slot", "part"])  # bounded: see the module
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "virtual_slot", "part", F.col("version").alias("map_version"))
    )


def shard_records(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, **columns) -> DataFrame:
    """Records with their places, by a new map at ``path`` whose versions are the even one and its first rebalancing."""
    rows = durable(records(docs, slots, **columns))
    save_version(even_map(slot_loads(rows, shards, slots), shards), path)
    save_version(rebalance(read_version(docs.sparkSession, path, 1), shards), path)
    return place(rows, read_version(docs.sparkSession, path, 2))


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(table(spark, sf_dir, "documents"), new_path(spark))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
