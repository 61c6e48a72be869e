"""The catalog of published items: versions, days, selection and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.attachments import APPENDIX_WORDS, attachment_extension, is_appendix
from foliant.functions.dates import parse_approve_ts
from foliant.sources.scratch import partition_values


def _pick(items: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; rows that tie are told apart by a hash of what they hold."""
    plain = [F.col(f"`{f.name}`") for f in items.schema if not f.dataType.simpleString().count("map<")]
    rank = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*plain))
    return items.withColumn("__rn", F.row_number().over(rank)).where("__rn = 1").drop("__rn")


def latest_by_id(items: DataFrame, file_col: str = "day_file") -> DataFrame:
    """Of an item's versions the one of the last file stays."""
    return _pick(items, ["news_item_id"], F.desc(file_col))


def first_by_id(items: DataFrame, day_col: str = "day_file") -> DataFrame:
    """Days are read newest first and an item's first version stays."""
    return _pick(items, ["news_item_id"], F.desc(day_col))


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All day stores in one, the last version of each item."""
    both = catalogs[0]
    for c in catalogs[1:]:
        both = both.unionByName(c)
    return latest_by_id(both)


def repartition_legacy(items: DataFrame) -> DataFrame:
    """Rows of a single-file store with their day; rows whose date cannot be read go."""
    return items.withColumn("approve_day", F.to_date(parse_approve_ts(F.col("approve_date")))).where("approve_day is not null")


def catalog_order(items: DataFrame) -> DataFrame:
    """By time (or the raw text where it is none) and id, newest first."""
    return items.orderBy(F.desc(catalog_key(F.col("approve_date"))), F.desc("news_item_id"))


def catalog_key(approve_date: Column) -> Column:
    return F.coalesce(F.date_format(parse_approve_ts(approve_date, "both"), "yyyy-MM-dd'T'HH:mm:ss"), approve_date)


def eligible_items(attachments: DataFrame, *extensions: str) -> DataFrame:
    """Ids of items that have an attachment of each extension. One aggregate, whatever their number."""
    ext = attachment_extension(F.col("file_name"))
    has = attachments.groupBy("item_id").agg(*(F.max((ext == e).cast("int")).alias(f"h{i}") for i, e in enumerate(extensions)))
    keep = F.lit(True)
    for i in range(len(extensions)):
        keep = keep & (F.col(f"h{i}") == 1)
    return has.where(keep).select("item_id")


def select_pair(attachments: DataFrame, first: str = ".pdf", second: str = ".hwpx") -> DataFrame:
    """An item's first attachment of either extension by position; items that lack one are skipped."""
    ext = attachment_extension(F.col("file_name"))
    name = lambda e: F.min_by(F.when(ext == e, F.col("file_name")), F.when(ext == e, F.col("pos")))
    return (
        attachments.groupBy("item_id").agg(name(first).alias("first_name"), name(second).alias("second_name"))
        .where("first_name is not null and second_name is not null")
    )


def primary_attachments(attachments: DataFrame, extension: str, words: tuple[str, ...] = APPENDIX_WORDS) -> DataFrame:
    """P5 over rows: (item_id, file_name, file_url) of each item that has the extension."""
    typed = attachments.where(attachment_extension(F.col("file_name")) == extension)
    best = F.min_by(F.struct("file_name", "file_url"), F.struct(is_appendix(F.col("file_name"), words), "pos"))
    return typed.groupBy("item_id").agg(best.alias("a")).select("item_id", "a.*")


def select_requested(items: DataFrame, requested: DataFrame, limit: int | None = None) -> DataFrame:
    """The requested items in the order of the request, (news_item_id, place); at most ``limit`` of them."""
    found = items.join(requested, "news_item_id").orderBy("place")
    return found if limit is None else found.limit(limit)


def artifact_order(artifacts: DataFrame, requested: DataFrame | None = None, recent: bool = False) -> DataFrame:
    """In the order of the request (news_item_id, place) where there is one, those not asked for at the end;
    else the most recently updated first if ``recent``, ties by id; else by id."""
    if requested is not None:
        return artifacts.join(requested, "news_item_id", "left").orderBy(F.asc_nulls_last("place"), "news_item_id")
    if recent:
        return artifacts.orderBy(F.desc_nulls_last("updated_at"), F.desc("news_item_id"))
    return artifacts.orderBy("news_item_id")


def recent_list(items: DataFrame) -> DataFrame:
    """Each item's last version, the newest day first, within it by time and then id, both descending."""
    at = parse_approve_ts(F.col("approve_date"))
    return latest_by_id(items).orderBy(F.desc("day_file"), F.desc_nulls_last(at), F.desc("news_item_id"))


def missing_ids(items: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that no item has."""
    return requested.join(items.select("news_item_id"), "news_item_id", "left_anti").select("news_item_id").distinct()


def not_yet_curated(items: DataFrame, curated: DataFrame, scaffolded: DataFrame) -> DataFrame:
    """Items whose sample is not curated, flagged where it is scaffolded already."""
    flag = scaffolded.select("sample_id").distinct().withColumn("scaffolded", F.lit(True))
    left = items.join(curated.select("sample_id"), "sample_id", "left_anti").join(flag, "sample_id", "left")
    return left.withColumn("scaffolded", F.coalesce("scaffolded", F.lit(False)))


def sample_exists(hits: DataFrame, first_root: DataFrame, second_root: DataFrame) -> DataFrame:
    """Hits flagged with whether either root has their sample."""
    known = first_root.select("sample_id").union(second_root.select("sample_id")).distinct().withColumn("sample_exists", F.lit(True))
    return hits.join(known, "sample_id", "left").withColumn("sample_exists", F.coalesce("sample_exists", F.lit(False)))


def curated_samples(meta: DataFrame, bridge: DataFrame) -> DataFrame:
    """Curated samples with title and job from the bridge, else their own; rows that lack either go."""
    b = bridge.select("sample_id", F.col("title").alias("b_title"), F.col("job_id").alias("b_job"))
    full = lambda a, c: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(c), F.lit("")))
    return (
        meta.where(F.col("status") == "curated")
        .join(b, "sample_id", "left")
        .select("sample_id", full("b_title", "title").alias("title"), full("b_job", "job_id").alias("job_id"))
        .where("title is not null and job_id is not null")
    )


def sample_inventory(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples that have a source file, with status, title and what they hold.

    ``files`` is (sample_id, path, text), ``meta`` (sample_id, kind, status, title) where kind
    ``metadata`` wins over ``meta`` as a whole. Without a status, golden slices make a sample curated.
    """
    has = lambda p: F.bool_or(F.col("path").rlike(p))
    from foliant.functions.markdown import extract_heading

    found = files.groupBy("sample_id").agg(
        has(r"(^|/)source\.[^/]+$").alias("source"),
        has(r"(^|/)golden/[^/]+\.md$").alias("has_golden"),
        has(r"(^|/)review\.md$").alias("has_review"),
        F.max(F.when(F.col("path").rlike(r"(^|/)rendered\.md$"), F.col("text"))).alias("rendered"),
    )
    m = _pick(meta, ["sample_id"], F.desc(F.col("kind") == "metadata")).select("sample_id", "status", F.col("title").alias("m_title"))
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.when(F.col("has_golden"), "curated").otherwise("scratch"))
    title = F.coalesce(F.nullif(F.col("m_title"), F.lit("")), extract_heading(F.col("rendered"), F.col("sample_id")))
    return (
        found.where("source").join(m, "sample_id", "left")
        .select("sample_id", status.alias("status"), "has_golden", "has_review", title.alias("title"))
    )


def latest_over_days(items: DataFrame, n: int) -> DataFrame:
    """K5: days newest first until ``n`` items are reached, then the newest ``n`` of those.

    Day counts are few rows; items of the kept days are found by a join on the day.
    """
    one = first_by_id(items)
    days = one.groupBy("day_file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("day_file")).rowsBetween(Window.unboundedPreceding, -1)
    kept = days.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < n).select("day_file")
    return one.join(kept, "day_file").orderBy(F.desc("day_file"), F.desc(catalog_key(F.col("approve_date"))), F.desc("news_item_id")).limit(n)


def latest_of_partitions(spark: SparkSession, path: str, n: int, day: str = "approve_day", lookback: int | None = None) -> DataFrame:
    """K5 over a table stored by day, with ``day`` as its partition: only the days that are needed to reach ``n`` are read.

    The days come from the names of the table's folders. Newest first, twice as many are counted each time until they hold
    ``n`` different items; older ones can't change what is found and stay unread.
    """
    days = sorted(partition_values(spark, path, day), reverse=True)[:lookback]
    if not days:
        return spark.read.parquet(path).limit(0)
    k = 1
    while True:
        of_days = spark.read.option("basePath", path).parquet(*(f"{path}/{day}={d}" for d in days[:k]))
        if k >= len(days) or of_days.agg(F.count_distinct("news_item_id")).first()[0] >= n:
            break
        k *= 2
    found = latest_over_days(of_days.withColumn("day_file", F.col(day).cast("string")), n)
    return found if day == "day_file" else found.drop("day_file")


def group_by_day(items: DataFrame) -> DataFrame:
    """(approve_day, items), newest day first; items without a readable date are left out."""
    return repartition_legacy(items).groupBy("approve_day").agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("approve_day"))


def day_status_rollup(days: DataFrame) -> DataFrame:
    """One row over (day, last_refreshed_at, served_stale, stale_reason)."""
    return days.agg(
        F.max("last_refreshed_at").alias("last_refreshed_at"),
        F.bool_or("served_stale").alias("served_stale"),
        F.min_by(F.nullif(F.col("stale_reason"), F.lit("")), F.when(F.col("stale_reason") != "", F.col("day"))).alias("first_warning"),
    )


def warm_summary(items: DataFrame, cached: DataFrame) -> DataFrame:
    """How many items there are, and how many are cached already or still to warm."""
    c = cached.select("news_item_id").distinct().withColumn("hit", F.lit(True))
    return items.join(c, "news_item_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("warmed"), F.count_if(F.col("hit")).alias("skipped")
    )


def export_summary(selected: DataFrame, missing: DataFrame) -> DataFrame:
    """Counts over the per-item status table (item_id, status) and the ids that were not found."""
    s = selected.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(F.col("status") == "exported").alias("exported"),
        F.count_if(F.col("status") == "scaffolded").alias("scaffolded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return s.crossJoin(missing.agg(F.count(F.lit(1)).alias("missing")))  # two single rows


def export_records(items: DataFrame, attachments: DataFrame, words: tuple[str, ...] = APPENDIX_WORDS) -> DataFrame:
    """(item_id, record): a JSON record per exported item, its pdf part null when absent."""
    hwpx = primary_attachments(attachments, ".hwpx", words).select("item_id", F.struct("file_name", "file_url").alias("hwpx"))
    pdf = primary_attachments(attachments, ".pdf", words).select("item_id", F.struct("file_name", "file_url").alias("pdf"))
    joined = items.join(hwpx, "item_id").join(pdf, "item_id", "left")
    return joined.select("item_id", F.to_json(F.struct("item_id", "hwpx", "pdf"), {"ignoreNullFields": "false"}).alias("record"))


def refresh_due(day: Column, today: Column, items: Column, last_at: Column, now: Column, max_age_s: int = 3600) -> Column:
    """Whether a day is to be fetched. A past day only while it is empty; today and later when it was never
    fetched, or ``max_age_s`` ago or earlier."""
    age = F.timestamp_diff("SECOND", last_at, now)
    return F.when(day < today, items == 0).otherwise(last_at.isNull() | (age >= max_age_s))


def freshness(days: DataFrame, now: str, today: str, max_age_s: int = 3600) -> DataFrame:
    """Which days to refresh; a last refresh that can't be read counts as none."""
    at = F.try_to_timestamp("last_refreshed_at").cast("timestamp_ntz")
    due = refresh_due(F.col("day"), F.lit(today), F.col("items"), at, F.lit(now).cast("timestamp_ntz"), max_age_s)
    return days.withColumn("refresh", due)
