"""The input views over the driver's tables, in Spark. See views_sql.py for the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(column) -> F.Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def v_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        _text("doc_id").alias("news_item_id"),
        F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")).alias("first_line"),
        F.col("source").alias("department"),
        F.expr("timestampadd(MINUTE, cast(doc_id * 37 % 43200 as int), timestamp_ntz'2023-12-20 00:00:00')").alias("ts"),
    )


def v_items(spark, sf) -> DataFrame:
    docs = v_docs(spark, sf)
    stamp = F.when(F.col("doc_id") % 50 == 7, "n/a").otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
    first = docs.select(
        "news_item_id", F.col("first_line").alias("title"), "department", stamp.alias("approve_date"), F.date_format("ts", "yyyy-MM-dd").alias("day_file")
    )
    second = docs.where(F.col("doc_id") % 10 == 0).select(
        "news_item_id",
        F.concat("first_line", F.lit(" v2")).alias("title"),
        "department",
        stamp.alias("approve_date"),
        F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd").alias("day_file"),
    )
    return first.unionByName(second)


def v_attachments(spark, sf) -> DataFrame:
    ext = F.when(F.col("l_returnflag") == "A", ".hwpx").when(F.col("l_returnflag") == "N", ".pdf").otherwise(".hwp")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.row_number().over(w).alias("pos"),
        F.concat(
            F.when(F.col("l_linestatus") == "F", "20240105_appendix ").otherwise(""),
            F.lit("doc"),
            _text("l_partkey"),
            F.when(F.col("l_partkey") % 5 == 0, F.upper(ext)).otherwise(ext),
        ).alias("file_name"),
        F.concat(F.lit("https://files.example/"), _text("l_orderkey"), F.lit("/"), _text("l_partkey")).alias("file_url"),
    )


def v_jobs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    created = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.concat(F.lit("job_"), F.lpad(_text(key), 8, "0")).alias("job_id"),
        created.alias("created_at"),
        F.expr("timestampadd(DAY, cast(o_custkey % 10 as int), cast(o_orderdate as timestamp_ntz))").alias("updated_at"),
        F.when(state == "O", "queued").when(state == "P", "processing").when(cust % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.when(state == "O", 0).when(state == "P", 25).otherwise(100).alias("progress"),
        F.when(cust % 3 == 0, F.concat(F.lit("req_"), _text(cust))).otherwise("").alias("client_request_id"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, "text").otherwise("html").alias("hwpx_table_mode"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("tok"), _text(key))).alias("edit_token"),
        F.when(state == "P", F.concat(F.lit("w"), _text(cust % 4))).alias("claimed_by"),
        F.when((state == "F") & (cust % 4 == 0), "conversion_failed").alias("error_code"),
        F.when(key % 5 == 0, F.concat(F.lit("edited "), _text(key))).otherwise("").alias("edited_markdown"),
        F.when(key % 2 == 0, F.concat(F.lit("text "), _text(key))).otherwise("").alias("markdown_text"),
        F.when(key % 3 == 1, F.concat(F.lit("html "), _text(key))).alias("markdown_html"),
        F.concat(F.lit("primary "), _text(key)).alias("markdown"),
        F.concat(F.lit("file"), _text(cust), F.lit(".hwpx")).alias("file_name"),
    )


def v_job_events(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf).select(
        _text("user_id").alias("job_id"),
        "ts",
        "event_id",
        F.when(kind == "signup", "create").when(kind == "view", "claim").when(kind == "click", "save_text").when(kind == "purchase", "save_edit").otherwise("fail").alias("kind"),
        F.concat(F.lit("v"), _text("event_id")).alias("payload"),
    )


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def v_probes(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.concat(F.lit("server"), _text(F.col("user_id") % 5)).alias("server"),
        "ts",
        "event_id",
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"),
        F.col("event_type").alias("detail"),
    )


def v_requests(spark, sf) -> DataFrame:
    return events(spark, sf).select(_text("user_id").alias("key"), "ts", "event_id")


def v_messages(spark, sf) -> DataFrame:
    turn = F.col("turn") % 6
    said = (
        F.when(turn == 0, "/qc today").when(turn == 1, "/qc failures").when(turn == 2, "/qc rerun 2024-01-05").when(turn == 3, "/server status")
        .when(turn == 4, "start qc recent 7").otherwise("open policy_briefing_2024_01_05_156000123")
    )
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.concat(F.lit("u"), _text(F.col("conv_id") % 7)).alias("sender"),
        F.expr("timestampadd(MINUTE, cast(conv_id * 60 + turn as int), timestamp_ntz'2024-01-01 00:00:00')").alias("ts"),
        F.concat(_text("conv_id"), F.lit("-"), _text("turn")).alias("message_id"),
        F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"),
    )


def v_media(spark, sf) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("u"), _text(F.col("user_id") % 7)).alias("sender"),
        "ts",
        F.concat(F.lit("/media/"), _text("event_id"), F.when(F.col("event_id") % 2 == 0, ".md").otherwise(".png")).alias("path"),
    )


def v_scores(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    doc = F.concat(F.lit("d"), F.lpad(_text("p_partkey"), 8, "0")).alias("document_id")

    def scores(engine, rows, nid, teds, mhs, top):
        k = F.col("p_partkey")
        return rows.select(
            doc,
            F.lit(engine).alias("engine"),
            (k * nid % 1000 / 1000.0).alias("nid"),
            F.when(F.col("p_size") % 3 != 0, k * teds % 1000 / 1000.0).alias("teds"),
            (k * mhs % top / 1000.0).alias("mhs"),
        )

    return scores("a", p, 7919, 104729, 31, 997).unionByName(scores("b", p.where("p_partkey % 50 <> 0"), 6151, 1299709, 17, 991))


def v_lines(spark, sf) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    kind = (F.col("doc_id") + F.col("i") + 1) % 7
    return lines.select(
        "doc_id",
        (F.col("i") + 1).alias("i"),
        F.when(kind == 0, F.concat(F.lit("## "), "line"))
        .when(kind == 1, F.concat(F.lit("- "), "line"))
        .when(kind == 2, F.concat(F.lit("| "), F.replace("line", F.lit(" "), F.lit(" | ")), F.lit(" |")))
        .when(kind == 3, F.concat(F.lit("> "), "line"))
        .when(kind == 4, F.concat(F.lit("\n"), "line"))
        .otherwise(F.col("line"))
        .alias("line"),
    )


def _marked(i):
    """The i-th line (from 0) of a document's array ``ls`` with its mark."""
    line = F.col("ls")[i]
    kind = (F.col("doc_id") + i + 1) % 7
    return (
        F.when(kind == 0, F.concat(F.lit("## "), line))
        .when(kind == 1, F.concat(F.lit("- "), line))
        .when(kind == 2, F.concat(F.lit("| "), F.replace(line, F.lit(" "), F.lit(" | ")), F.lit(" |")))
        .when(kind == 3, F.concat(F.lit("> "), line))
        .when(kind == 4, F.concat(F.lit("\n"), line))
        .otherwise(line)
    )


def _split_docs(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    return docs.withColumn("at", F.sequence(F.lit(0), F.size("ls") - 1))


def v_markdown(spark, sf) -> DataFrame:
    """Each document's marked lines, put together inside its row."""
    return _split_docs(spark, sf).select("doc_id", F.array_join(F.transform("at", _marked), "\n").alias("text"))


def v_pred(spark, sf) -> DataFrame:
    docs = _split_docs(spark, sf)
    kept = F.filter("at", lambda i: (F.col("doc_id") + i + 1) % 11 != 0)
    a = docs.where("doc_id % 20 <> 0").withColumn("kept", kept).where(F.size("kept") > 0)
    b = docs.where("doc_id % 25 <> 0").withColumn("kept", F.when(F.col("doc_id") % 13 == 0, F.reverse("at")).otherwise(F.col("at")))
    low = lambda i: F.when((F.col("doc_id") + i + 1) % 9 == 0, F.lower(_marked(i))).otherwise(_marked(i))
    return a.select(F.lit("a").alias("engine"), "doc_id", F.array_join(F.transform("kept", _marked), "\n").alias("text")).unionByName(
        b.select(F.lit("b").alias("engine"), "doc_id", F.array_join(F.transform("kept", low), "\n").alias("text"))
    )


def v_triage(spark, sf) -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("policy_briefing_2024_01_05_"), _text(F.lit(156000000) + F.col("doc_id"))).alias("sample_id"),
        F.when(F.col("doc_id") % 6 == 0, "curated").otherwise("scratch").alias("status"),
        F.when(F.col("quality").isNotNull(), F.col("quality") == 0).alias("review_required"),
        (F.col("n_chars") % 10).cast("int").alias("risk_score"),
        (F.col("n_chars") % 3).cast("int").alias("hard_finding_count"),
        (F.col("n_chars") % 7).cast("int").alias("finding_count"),
        F.concat(F.lit("class"), _text(F.col("doc_id") % 4)).alias("defect_class"),
    )


def v_qc(spark, sf) -> DataFrame:
    v = v_docs(spark, sf).withColumn("sample_id", F.concat(F.lit("policy_briefing_2024_01_05_"), _text(F.lit(156000000) + F.col("doc_id"))))
    return v.join(v_triage(spark, sf), "sample_id").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
        F.when(F.col("doc_id") % 3 == 0, "regression").otherwise("triage").alias("command"),
        "sample_id",
        (F.col("doc_id") % 5 != 0).alias("passed"),
        F.coalesce("review_required", F.col("status") != "curated").alias("review_required"),
        "risk_score",
        "defect_class",
    )


def v_attempts(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = lambda f: F.floor(F.col("value") * f + 1e-6).cast("long")
    at = events(spark, sf).withColumn("at", F.row_number().over(w) - 1)
    # Five attempts are one sample, as the loop of attempts ends there; a user's further events are samples of their own.
    return at.select(
        F.concat(F.lit("sample"), _text("user_id"), F.lit("_"), _text(F.floor(F.col("at") / 5))).alias("sample_id"),
        (F.col("at") % 5 + 1).alias("attempt"),
        ms(100).alias("inspect_before_ms"),
        ms(150).alias("fix_ms"),
        ms(50).alias("inspect_after_ms"),
        F.when(F.col("event_type") == "error", 0).otherwise(ms(220)).alias("judge_ms"),
        F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "defer").otherwise("retry").alias("decision"),
    )
