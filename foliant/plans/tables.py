"""Queries of catalogs, jobs, rankings, quality control and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.dates import parse_approve_ts
from foliant.functions.messages import format_alert
from foliant.operators import catalog as C
from foliant.operators import jobs as J
from foliant.operators import monitoring as N
from foliant.operators import qc as Q
from foliant.operators import ranking as R
from foliant.plans import views as V
from foliant.plans._registry import query
from foliant.plans.scalars import APPENDIX, EXTENSION, IS_APPENDIX
from foliant.sources.scratch import new_dir

AT = "try_strptime(approve_date, '%m/%d/%Y %H:%M:%S')"
LATEST = "latest as (select * from v_items qualify row_number() over (partition by news_item_id order by day_file desc) = 1)"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Sources whose work is a projection


@query("s04_repartition_legacy", "v_items", f"select news_item_id, title, strftime({AT}, '%Y-%m-%d') as approve_day from v_items where {AT} is not null")
def s04(spark, sf):
    return C.repartition_legacy(V.v_items(spark, sf)).select("news_item_id", "title", F.col("approve_day").cast("string").alias("approve_day"))


@query("s05_upgrade_jobs", "v_jobs", """
select job_id, coalesce(nullif(trim(edit_token), ''), 'legacy-' || job_id) as edit_token, coalesce(nullif(trim(hwpx_table_mode), ''), 'text') as hwpx_table_mode,
  cast(null as varchar) as source from v_jobs""")
def s05(spark, sf):
    return J.upgrade_jobs(V.v_jobs(spark, sf), {"source": "string"}).select("job_id", "edit_token", "hwpx_table_mode", "source")


# Catalog


@query("w01_latest_by_id", "v_items", f"with {LATEST} select news_item_id, title, day_file from latest")
def w01(spark, sf):
    return C.latest_by_id(V.v_items(spark, sf)).select("news_item_id", "title", "day_file")


@query("w02_first_by_id", "v_items", f"with {LATEST} select news_item_id, title from latest")
def w02(spark, sf):
    return C.first_by_id(V.v_items(spark, sf)).select("news_item_id", "title")


@query("u01_union_catalogs", "v_items", f"with {LATEST} select news_item_id, title, day_file from latest")
def u01(spark, sf):
    items = V.v_items(spark, sf)
    return C.union_catalogs(items.where("day_file < '2024-01-05'"), items.where("day_file >= '2024-01-05'")).select("news_item_id", "title", "day_file")


_LATEST_OVER_DAYS = f"""
with {LATEST}, d as (select day_file, count(*) as n from latest group by day_file), b as (select day_file, coalesce(sum(n) over (order by day_file desc rows between unbounded preceding and 1 preceding), 0) as before from d)
select news_item_id, day_file from latest join b using (day_file) where before < 100
order by day_file desc, coalesce(strftime({AT}, '%Y-%m-%dT%H:%M:%S'), approve_date) desc, news_item_id desc limit 100"""


@query("k05_latest_over_days", "v_items", _LATEST_OVER_DAYS)
def k05(spark, sf):
    return C.latest_over_days(V.v_items(spark, sf), 100).select("news_item_id", "day_file")


@query("k05b_latest_of_partitions", "v_items", _LATEST_OVER_DAYS)
def k05b(spark, sf):
    path = new_dir(spark, "days")
    V.v_items(spark, sf).withColumn("day_file", F.to_date("day_file")).write.partitionBy("day_file").parquet(path)
    return C.latest_of_partitions(spark, path, 100, "day_file").select("news_item_id", F.col("day_file").cast("string").alias("day_file"))


@query("k09_eligible_latest", ("v_items", "v_attachments"), f"""
with {LATEST}, e as (select item_id from v_attachments group by item_id having bool_or({EXTENSION} = '.pdf') and bool_or({EXTENSION} = '.hwpx'))
select l.news_item_id, l.title from latest l join e on e.item_id = l.news_item_id::bigint order by {AT} desc nulls last, l.news_item_id desc limit 100""")
def k09(spark, sf):
    e = C.eligible_items(V.v_attachments(spark, sf), ".pdf", ".hwpx").select(F.col("item_id").cast("string").alias("news_item_id"))
    items = C.latest_by_id(V.v_items(spark, sf)).join(e, "news_item_id", "left_semi")
    return items.orderBy(F.desc_nulls_last(parse_approve_ts(F.col("approve_date"))), F.desc("news_item_id")).limit(100).select("news_item_id", "title")


@query("k10_catalog_order", "v_items", f"""
select news_item_id, day_file, coalesce(strftime({AT}, '%Y-%m-%dT%H:%M:%S'), approve_date) as key from v_items""")
def k10(spark, sf):
    return C.catalog_order(V.v_items(spark, sf)).select("news_item_id", "day_file", C.catalog_key(F.col("approve_date")).alias("key"))


@query("k11_artifact_order", "v_jobs", "select job_id, 100000000 - split_part(job_id, '_', 2)::bigint as place from v_jobs")
def k11(spark, sf):
    jobs = V.v_jobs(spark, sf).select(F.col("job_id").alias("news_item_id"))
    asked = jobs.withColumn("place", F.lit(100000000) - F.split_part("news_item_id", F.lit("_"), F.lit(2)).cast("long"))
    return C.select_requested(jobs, asked).select(F.col("news_item_id").alias("job_id"), "place")


@query("k11b_artifact_recent", "v_jobs", "select job_id, updated_at from v_jobs")
def k11b(spark, sf):
    jobs = V.v_jobs(spark, sf).select(F.col("job_id").alias("news_item_id"), "updated_at")
    return C.artifact_order(jobs, recent=True).select(F.col("news_item_id").alias("job_id"), "updated_at")


@query("k13_recent_list", "v_items", f"with {LATEST} select news_item_id, day_file from latest")
def k13(spark, sf):
    return C.recent_list(V.v_items(spark, sf)).select("news_item_id", "day_file")


@query("j06_select_requested", "v_items", f"with {LATEST} select news_item_id, title, 1000000 - news_item_id::int as place from latest")
def j06(spark, sf):
    items = C.latest_by_id(V.v_items(spark, sf))
    asked = items.select("news_item_id", (F.lit(1000000) - F.col("news_item_id").cast("int")).alias("place"))
    return C.select_requested(items.select("news_item_id", "title"), asked.unionByName(asked.withColumn("news_item_id", F.concat(F.lit("x"), "news_item_id"))))


@query("u03_missing_ids", "v_items", "select distinct 'x' || news_item_id as news_item_id from v_items")
def u03(spark, sf):
    items = V.v_items(spark, sf).select("news_item_id")
    return C.missing_ids(items, items.select(F.concat(F.lit("x"), "news_item_id").alias("news_item_id")).unionByName(items))


@query("j07_not_yet_curated", "v_triage", """
select sample_id, risk_score = 3 as scaffolded from v_triage where status <> 'curated'""")
def j07(spark, sf):
    t = V.v_triage(spark, sf)
    return C.not_yet_curated(t.select("sample_id"), t.where("status = 'curated'"), t.where("risk_score = 3"))


@query("j14_eligible_items", "v_attachments", f"""
select item_id from v_attachments group by item_id having bool_or({EXTENSION} = '.pdf') and bool_or({EXTENSION} = '.hwpx')""")
def j14(spark, sf):
    return C.eligible_items(V.v_attachments(spark, sf), ".pdf", ".hwpx")


@query("j15_select_pair", "v_attachments", f"""
select item_id, arg_min(file_name, pos) filter ({EXTENSION} = '.pdf') as first_name, arg_min(file_name, pos) filter ({EXTENSION} = '.hwpx') as second_name
from v_attachments group by item_id having first_name is not null and second_name is not null""")
def j15(spark, sf):
    return C.select_pair(V.v_attachments(spark, sf))


@query("j17_curated_samples", "v_triage", """
select sample_id, case when risk_score % 2 = 0 then 'bridge ' || sample_id else 'own' end as title, 'job_' || hard_finding_count as job_id
from v_triage where status = 'curated' and (risk_score % 2 = 0 or finding_count > 0) and hard_finding_count > 0""")
def j17(spark, sf):
    t = V.v_triage(spark, sf)
    meta = t.select("sample_id", "status", F.when(F.col("finding_count") > 0, "own").otherwise("").alias("title"), F.when(F.col("hard_finding_count") > 0, F.concat(F.lit("job_"), F.col("hard_finding_count").cast("string"))).alias("job_id"))
    bridge = t.where("risk_score % 2 = 0").select("sample_id", F.concat(F.lit("bridge "), "sample_id").alias("title"), F.lit("").alias("job_id"))
    return C.curated_samples(meta, bridge)


@query("j18_sample_exists", "v_triage", "select sample_id, risk_score < 3 or finding_count = 5 as sample_exists from v_triage")
def j18(spark, sf):
    t = V.v_triage(spark, sf)
    return C.sample_exists(t.select("sample_id"), t.where("risk_score < 3"), t.where("finding_count = 5"))


@query("j19_sample_inventory", "v_triage", """
select sample_id, case when risk_score % 3 = 0 then 'curated' when finding_count % 2 = 0 then 'curated' else 'scratch' end as status, finding_count % 2 = 0 as has_golden,
  hard_finding_count = 1 as has_review, case when risk_score % 3 = 0 then 'meta title' else 'Head ' || finding_count end as title from v_triage where risk_score <> 5""")
def j19(spark, sf):
    t = V.v_triage(spark, sf)
    path = lambda cond, name: F.when(cond, F.struct(F.lit(name).alias("path"), F.concat(F.lit("x\n## Head "), F.col("finding_count").cast("string")).alias("text")))
    files = F.array_compact(F.array(
        path(F.col("risk_score") != 5, "source.hwpx"), path(F.col("finding_count") % 2 == 0, "golden/a.md"), path(F.col("hard_finding_count") == 1, "review.md"), path(F.lit(True), "rendered.md"),
    ))
    listing = t.select("sample_id", F.explode(files).alias("f")).select("sample_id", "f.*")
    one = t.where("risk_score % 3 = 0")
    meta = one.select("sample_id", F.lit("metadata").alias("kind"), F.lit("curated").alias("status"), F.lit("meta title").alias("title")).unionByName(
        one.select("sample_id", F.lit("meta").alias("kind"), F.lit("scratch").alias("status"), F.lit("old").alias("title"))
    )
    return C.sample_inventory(listing, meta)


@query("a15_day_status_rollup", "v_docs", """
select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_refreshed_at, bool_or(doc_id % 97 = 5) as served_stale,
  arg_min('warn ' || strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m-%d %H:%M:%S')) filter (doc_id % 97 = 5) as first_warning from v_docs""")
def a15(spark, sf):
    stale = F.col("doc_id") % 97 == 5
    days = V.v_docs(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_refreshed_at"),
        stale.alias("served_stale"), F.when(stale, F.concat(F.lit("warn "), F.date_format("ts", "yyyy-MM-dd"))).otherwise("").alias("stale_reason"),
    )
    return C.day_status_rollup(days)


@query("a16_group_by_day", "v_items", f"select strftime({AT}, '%Y-%m-%d') as approve_day, count(*) as items from v_items where {AT} is not null and contains(lower(title), 'e') group by 1")
def a16(spark, sf):
    from foliant.functions.titles import search_filter

    found = V.v_items(spark, sf).where(search_filter("E", F.col("title")))
    return C.group_by_day(found).select(F.col("approve_day").cast("string").alias("approve_day"), "items")


@query("a18_export_summary", "v_triage", """
select count(*) as selected, count(*) filter (risk_score < 5) as exported, count(*) filter (risk_score in (5, 6)) as scaffolded, count(*) filter (risk_score > 6) as failed,
  count(*) filter (finding_count = 0) as missing from v_triage""")
def a18(spark, sf):
    t = V.v_triage(spark, sf)
    status = F.when(F.col("risk_score") < 5, "exported").when(F.col("risk_score") < 7, "scaffolded").otherwise("failed")
    return C.export_summary(t.select("sample_id", status.alias("status")), t.where("finding_count = 0"))


@query("a18b_export_records", "v_attachments", f"""
with k as (select item_id, {EXTENSION} as ext, file_name, row_number() over (partition by item_id, {EXTENSION} order by {IS_APPENDIX}, pos) as rn from v_attachments),
h as (select * from k where ext = '.hwpx' and rn = 1), p as (select * from k where ext = '.pdf' and rn = 1)
select h.item_id, h.file_name as hwpx_name, p.file_name as pdf_name from h left join p using (item_id)""")
def a18b(spark, sf):
    a = V.v_attachments(spark, sf)
    got = C.export_records(a.select("item_id").distinct(), a, APPENDIX)
    part = lambda p: F.get_json_object("record", p)
    return got.select("item_id", part("$.hwpx.file_name").alias("hwpx_name"), part("$.pdf.file_name").alias("pdf_name"))


@query("a19_warm_summary", "v_items", f"""
with {LATEST} select count(*) as total, count(*) filter (news_item_id::bigint % 4 <> 0) as warmed, count(*) filter (news_item_id::bigint % 4 = 0) as skipped from latest""")
def a19(spark, sf):
    items = C.latest_by_id(V.v_items(spark, sf))
    return C.warm_summary(items, items.where(F.col("news_item_id").cast("int") % 4 == 0))


@query("t3_freshness", "v_docs", """
with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from v_docs group by 1), e as (select day, case when day[9:10]::int % 3 = 0 then 0 else n end as items,
  case day[9:10]::int % 4 when 0 then '' when 1 then 'garbage' when 2 then '2024-01-10 11:30:00' else '2024-01-10 10:59:00' end as last_refreshed_at from d)
select day, case when day < '2024-01-10' then items = 0 else day[9:10]::int % 4 in (0, 1, 3) end as refresh from e""")
def t3_freshness(spark, sf):
    days = V.v_docs(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    number = F.substring("day", 9, 2).cast("int")
    last = F.when(number % 4 == 0, "").when(number % 4 == 1, "garbage").when(number % 4 == 2, "2024-01-10 11:30:00").otherwise("2024-01-10 10:59:00")
    days = days.select("day", F.when(number % 3 == 0, 0).otherwise(F.col("n")).alias("items"), last.alias("last_refreshed_at"))
    return C.freshness(days, "2024-01-10 12:00:00", "2024-01-10").select("day", "refresh")


# Jobs


@query("w08_page_jobs", "v_jobs", """
with p as (select job_id, created_at, row_number() over (order by created_at desc, job_id desc) as place, lead(job_id) over (order by created_at desc, job_id desc) as nxt from v_jobs
  where status = 'completed' and (created_at < timestamp '1998-06-01' or (created_at = timestamp '1998-06-01' and job_id < 'job_00001000')))
select job_id, place::int as place, case when place = 25 and nxt is not null then job_id end as next_cursor from p where place <= 25""")
def w08(spark, sf):
    page = J.page_jobs(V.v_jobs(spark, sf), 25, "completed", ("1998-06-01 00:00:00", "job_00001000"))
    return page.select("job_id", "place", "next_cursor")


@query("w09_claim_plan", "v_jobs", """
select job_id, ((row_number() over (order by created_at, job_id) - 1) % 4)::int as worker, 'processing' as status, 25 as progress from v_jobs
where status = 'queued' order by created_at, job_id limit 200""")
def w09(spark, sf):
    return J.claim_plan(V.v_jobs(spark, sf), 4, 200).select("job_id", "worker", "status", "progress")


@query("w11_recent_by_user", (), """
with l as (select user_id, event_type, max(ts) as ts from events group by all)
select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_type) as place from l qualify place <= 3""")
def w11(spark, sf):
    opened = V.events(spark, sf).select(F.col("user_id").alias("user"), F.col("event_type").alias("item"), "ts")
    return J.recent_by_user(opened, 3).select(F.col("user").alias("user_id"), F.col("item").alias("event_type"), F.col("place").cast("long").alias("place"))


_SPLIT = "e as (select * from v_jobs where right(job_id, 1) in ('0', '1', '2')), r as (select * from v_jobs where right(job_id, 1) not in ('0', '1', '2'))"


@query("u04_create_jobs", "v_jobs", f"""
with {_SPLIT}, o as (select * from r where client_request_id <> '' and client_request_id not in (select client_request_id from e)
  qualify row_number() over (partition by client_request_id order by created_at, job_id) = 1)
select job_id, client_request_id from e union all select job_id, client_request_id from o union all select job_id, client_request_id from r where client_request_id = ''""")
def u04(spark, sf):
    jobs = V.v_jobs(spark, sf)
    old = F.substring("job_id", -1, 1).isin("0", "1", "2")
    return J.create_jobs(jobs.where(old), jobs.where(~old)).select("job_id", "client_request_id")


_FOLD = """
with f as (select job_id, last(kind order by ts, event_id) filter (kind in ('create', 'claim', 'save_text', 'fail')) as state, count(*) filter (kind in ('save_text', 'save_edit')) as result_version,
  last(payload order by ts, event_id) filter (kind = 'save_text') as markdown, last(payload order by ts, event_id) filter (kind = 'save_edit') as edited_markdown,
  last(payload order by ts, event_id) filter (kind = 'fail') as err from v_job_events group by job_id)"""


@query("u05_apply_results", "v_job_events", _FOLD + " select job_id, result_version, markdown, edited_markdown from f")
def u05(spark, sf):
    return J.fold_job_events(V.v_job_events(spark, sf)).select("job_id", "result_version", "markdown", "edited_markdown")


@query("u05b_save_html", "v_jobs", "select job_id, case when hwpx_table_mode = 'html' and coalesce(markdown_html, '') <> '' then markdown_html else markdown end as markdown from v_jobs")
def u05b(spark, sf):
    return J.save_html(V.v_jobs(spark, sf)).select("job_id", "markdown")


@query("u06_update_status", "v_job_events", _FOLD + """
select job_id, case state when 'claim' then 'processing' when 'fail' then 'failed' when 'save_text' then 'completed' else 'queued' end as status,
  case state when 'claim' then 25 when 'fail' then 100 when 'save_text' then 100 else 0 end as progress, case when state = 'fail' then err end as error from f""")
def u06(spark, sf):
    return J.fold_job_events(V.v_job_events(spark, sf)).select("job_id", "status", "progress", "error")


@query("u06b_update_status_table", "v_jobs", """
with u as (select *, job_id like '%3' as hit from v_jobs)
select job_id, case when hit then 'queued' else status end as status, progress, case when hit then 'E' else error_code end as error_code, case when not hit then claimed_by end as claimed_by from u""")
def u06b(spark, sf):
    jobs = V.v_jobs(spark, sf)
    hit = jobs.where(F.endswith("job_id", F.lit("3")))
    updates = hit.select("job_id", F.lit("queued").alias("new_status"), F.lit(None).cast("int").alias("new_progress"), F.lit("E").alias("new_error"))
    return J.update_status(jobs, updates).select("job_id", "status", "progress", "error_code", "claimed_by")


@query("u07_recover_incomplete", "v_jobs", """
select job_id, case when status in ('queued', 'processing') then 'queued' else status end as status, case when status in ('queued', 'processing') then 0 else progress end as progress,
  case when status = 'processing' then 'worker_restarted' else error_code end as error_code from v_jobs""")
def u07(spark, sf):
    return J.recover_incomplete(V.v_jobs(spark, sf)).select("job_id", "status", "progress", "error_code")


@query("u08_expire_jobs", "v_jobs", """
select job_id, status in ('completed', 'failed') and updated_at < timestamp '1998-01-01' - interval 3 day as expired from v_jobs""")
def u08(spark, sf):
    kept, gone = J.expire_jobs(V.v_jobs(spark, sf), "1998-01-01 00:00:00", 72)
    mark = lambda d, v: d.select("job_id", F.lit(v).alias("expired"))
    return mark(kept, False).unionByName(mark(gone, True))


@query("u09_reconcile_outcomes", "v_attempts", """
select sample_id, attempt, case when split_part(substr(sample_id, 7), '_', 1)::int % 5 = 0 then 'defer' else decision end as outcome, split_part(substr(sample_id, 7), '_', 1)::int % 5 = 0 or decision = 'pass' as final from v_attempts""")
def u09(spark, sf):
    rows = V.v_attempts(spark, sf).select("sample_id", "attempt", F.col("decision").alias("outcome"), (F.col("decision") == "pass").alias("final"))
    manual = rows.where(F.regexp_extract("sample_id", "^sample([0-9]+)_", 1).cast("int") % 5 == 0).select("sample_id", F.lit("defer").alias("outcome")).distinct()
    return J.reconcile_outcomes(rows, manual).select("sample_id", "attempt", "outcome", "final")


@query("u10_retry_failed", "v_jobs", """
with u as (select *, status = 'failed' and job_id like '%1' as hit from v_jobs)
select job_id, case when hit then 'queued' else status end as status, case when hit then 0 else progress end as progress, case when not hit then error_code end as error_code from u""")
def u10(spark, sf):
    jobs = V.v_jobs(spark, sf)
    return J.retry_failed(jobs, jobs.where((F.col("status") == "failed") & F.endswith("job_id", F.lit("1")))).select("job_id", "status", "progress", "error_code")


@query("u11_delete_jobs", "v_jobs", "select job_id, file_name, job_id like '%9' as deleted from v_jobs")
def u11(spark, sf):
    jobs = V.v_jobs(spark, sf)
    kept, gone = J.delete_jobs(jobs, jobs.where(F.endswith("job_id", F.lit("9"))))
    mark = lambda d, v: d.select("job_id", "file_name", F.lit(v).alias("deleted"))
    return mark(kept, False).unionByName(mark(gone, True))


# Rankings


def _overall(spark, sf, engine=None):
    s = R.with_overall(V.v_scores(spark, sf))
    return s.where(F.col("engine") == engine) if engine else s


@query("a01_overall_score", "v_overall", "select document_id, engine, round(overall, 6) as overall from v_overall")
def a01(spark, sf):
    return _overall(spark, sf).select("document_id", "engine", F.round("overall", 6).alias("overall"))


@query("a02_corpus_metrics", "v_overall", """
select engine, count(*) as documents, round(avg(overall), 6) as overall_mean, round(avg(nid), 6) as nid_mean, round(avg(teds), 6) as teds_mean, round(avg(mhs), 6) as mhs_mean,
  count(nid) as nid_count, count(teds) as teds_count, count(mhs) as mhs_count, count(*) filter (nid < 0.1) as missing_predictions, count(*) filter (mhs > 0.9) as table_timeouts from v_overall group by engine""")
def a02(spark, sf):
    s = _overall(spark, sf).withColumn("prediction_available", F.col("nid") >= 0.1).withColumn("table_timed_out", F.col("mhs") > 0.9)
    m = R.corpus_metrics(s)
    return m.select(*(F.round(c, 6).alias(c) if c.endswith("_mean") else c for c in m.columns))


@query("a03_run_summary", "v_scores", """
select engine, count(*) filter (nid > 0.05) as document_count, round(sum(mhs), 6) as total_elapsed, round(sum(mhs) / count(*) filter (nid > 0.05), 6) as elapsed_per_doc from v_scores group by engine""")
def a03(spark, sf):
    r = R.run_summary(V.v_scores(spark, sf).select("engine", (F.col("nid") > 0.05).alias("succeeded"), F.col("mhs").alias("elapsed")))
    return r.select("engine", "document_count", F.round("total_elapsed", 6).alias("total_elapsed"), F.round("elapsed_per_doc", 6).alias("elapsed_per_doc"))


@query("a04_leaderboard", "v_overall", """
select engine, case engine when 'a' then 'Engine A' else engine end as label, round(avg(overall), 6) as overall_mean, case engine when 'a' then 0.05 else round(sum(mhs) / count(*), 6) end as speed
from v_overall group by engine""")
def a04(spark, sf):
    s = _overall(spark, sf)
    m = s.groupBy("engine").agg(F.avg("overall").alias("overall_mean"), (F.sum("mhs") / F.count(F.lit(1))).alias("elapsed_per_doc"))
    about = spark.createDataFrame([("a", "Engine A", True, 0.05)], "engine string, label string, has_speed boolean, speed double")
    return R.leaderboard(m, about).select("engine", "label", F.round("overall_mean", 6).alias("overall_mean"), F.round("speed", 6).alias("speed"))


@query("a05_corpus_counts", "v_docs", "select count(*) as documents, count(*) filter (doc_id % 100 <> 3) as ground_truths, count(*) filter (doc_id % 100 = 3) as failures from v_docs")
def a05(spark, sf):
    d = V.v_docs(spark, sf)
    return R.corpus_counts(d, d.where("doc_id % 100 <> 3"), d.where("doc_id % 100 = 3"))


def _extreme_sql(order: str) -> str:
    return f"select document_id, round(overall, 6) as overall from v_overall where engine = 'a' and overall is not null order by v_overall.overall {order}, document_id limit 10"


@query("k01_best_documents", "v_overall", _extreme_sql("desc"))
def k01(spark, sf):
    return R.extremes(_overall(spark, sf, "a"), 10, True).select("document_id", F.round("overall", 6).alias("overall"))


@query("k01b_worst_documents", "v_overall", _extreme_sql("asc"))
def k01b(spark, sf):
    return R.extremes(_overall(spark, sf, "a"), 10, False).select("document_id", F.round("overall", 6).alias("overall"))


DELTAS = """d as (select a.document_id, a.overall as a_overall, b.overall as b_overall, a.overall - b.overall as delta from v_overall a join v_overall b using (document_id)
  where a.engine = 'a' and b.engine = 'b' and a.overall is not null and b.overall is not null)"""


def _deltas(spark, sf):
    from foliant.operators.matching import paired_deltas

    return paired_deltas(_overall(spark, sf, "a"), _overall(spark, sf, "b"))


@query("k02_top_deltas", "v_overall", f"""
with {DELTAS}, h as (select document_id, round(delta, 6) as delta, 'up' as side from d order by d.delta desc, document_id limit 8),
l as (select document_id, round(delta, 6) as delta, 'down' as side from d order by d.delta asc, document_id limit 8) select * from h union all select * from l""")
def k02(spark, sf):
    d = _deltas(spark, sf)
    one = lambda best, side: R.extremes(d, 8, best, "delta").select("document_id", F.round("delta", 6).alias("delta"), F.lit(side).alias("side"))
    return one(True, "up").unionByName(one(False, "down"))


@query("k03_largest_differences", "v_overall", f"with {DELTAS} select document_id, round(abs(delta), 6) as difference from d order by abs(delta) desc, document_id limit 20")
def k03(spark, sf):
    return R.largest_differences(_overall(spark, sf, "a"), _overall(spark, sf, "b"), 20).select("document_id", F.round("difference", 6).alias("difference"))


@query("k04_choose_examples", "v_overall", f"""
with {DELTAS}, l as ((select document_id, 0 as list, row_number() over (order by abs(delta) desc, document_id) as rank from d qualify rank <= 4) union all
  (select document_id, 1, row_number() over (order by a_overall desc, document_id) as rank from d qualify rank <= 2) union all (select document_id, 2, row_number() over (order by b_overall desc, document_id) as rank from d qualify rank <= 2)),
o as (select document_id, min(list * 100 + rank) as spot from l group by document_id)
select (row_number() over (order by spot, document_id))::int as place, document_id from o order by place limit 6""")
def k04(spark, sf):
    return R.choose_examples(_deltas(spark, sf))


@query("k08_ends", "v_overall", """
with s as (select * from v_overall where engine = 'b'), t as (select 'top' as side, document_id, round(overall, 6) as overall from s order by s.overall desc, document_id limit 3),
b as (select 'bottom' as side, document_id, round(overall, 6) as overall from s order by s.overall asc, document_id desc limit 3) select * from t union all select * from b""")
def k08(spark, sf):
    return R.ends(_overall(spark, sf, "b")).select("side", "document_id", F.round("overall", 6).alias("overall"))


@query("u02_common_docs", "v_scores", "select document_id, count(*) = 2 as common from v_scores group by document_id")
def u02(spark, sf):
    s = V.v_scores(spark, sf)
    a, b = s.where("engine = 'a'"), s.where("engine = 'b'")
    both = R.common_docs(a, b).withColumn("common", F.lit(True))
    return R.all_docs(a, b).join(both, "document_id", "left").withColumn("common", F.coalesce("common", F.lit(False)))


# Quality control


def _queue(spark, sf):
    return V.v_triage(spark, sf).withColumn("review_required", F.coalesce("review_required", F.col("status") != "curated"))


QUEUE = "q as (select sample_id, status, coalesce(review_required, status <> 'curated') as review_required, risk_score, hard_finding_count, finding_count, defect_class from v_triage)"
ORDER = "review_required desc, hard_finding_count desc, risk_score desc, finding_count desc, sample_id"


@query("k06_review_order", "v_triage", f"with {QUEUE} select sample_id, review_required from q")
def k06(spark, sf):
    return Q.review_order(_queue(spark, sf)).select("sample_id", "review_required")


@query("k07_to_review", "v_triage", f"with {QUEUE} select sample_id, count(*) over () as total from q where review_required order by {ORDER} limit 12")
def k07(spark, sf):
    return Q.to_review(_queue(spark, sf)).select("sample_id", "total")


@query("k12_curated_last", "v_triage", "select sample_id, status from v_triage")
def k12(spark, sf):
    return Q.curated_last(V.v_triage(spark, sf)).select("sample_id", "status")


@query("w10_next_in_queue", "v_triage", f"""
with {QUEUE}, n as (select sample_id, lead(sample_id) over (order by {ORDER}) as nxt, first_value(sample_id) over (order by {ORDER}) as fst from q)
select coalesce(nxt, fst) as sample_id from n where sample_id = 'policy_briefing_2024_01_05_156000042'""")
def w10(spark, sf):
    return Q.next_in_queue(_queue(spark, sf), "policy_briefing_2024_01_05_156000042")


@query("w12_queue_progress", "v_triage", f"""
with {QUEUE} select sample_id, (row_number() over (partition by defect_class order by {ORDER}))::int as place, count(*) over (partition by defect_class) as total from q""")
def w12(spark, sf):
    return Q.queue_progress(_queue(spark, sf), "defect_class").select("sample_id", "place", "total")


@query("w12b_queue_state", "v_triage", f"""
with {QUEUE}, b as (select defect_class as batch, count(*) filter (review_required) as index, count(*) as total from q group by 1),
r as (select defect_class as batch, sample_id, row_number() over (partition by defect_class order by {ORDER}) - 1 as index from q)
select b.batch, b.index::int as index, b.total, r.sample_id, case when b.index < b.total then 'queued' else 'finished' end as status from b left join r on r.batch = b.batch and r.index = b.index""")
def w12b(spark, sf):
    queue = _queue(spark, sf)
    batches = queue.groupBy(F.col("defect_class").alias("batch")).agg(F.count_if("review_required").cast("int").alias("index"))
    return Q.queue_state(queue, batches, "defect_class")


@query("a06_defect_frequency", "v_qc", "select defect_class, count(*) as n from v_qc where review_required group by 1")
def a06(spark, sf):
    return Q.defect_frequency(V.v_qc(spark, sf))


@query("a06b_sample_frequency", "v_qc", "select sample_id, count(distinct run_date) as runs, max(run_date) as latest_run from v_qc where review_required group by 1")
def a06b(spark, sf):
    return Q.sample_frequency(V.v_qc(spark, sf))


@query("a07_qc_status", "v_qc", """
select run_date, count(*) as rows, count(*) filter (review_required) as review_required_count, count(*) filter (command = 'regression' and not passed) as failed_count
from v_qc where run_date = (select max(run_date) from v_qc) group by 1""")
def a07(spark, sf):
    return Q.qc_status(V.v_qc(spark, sf))


@query("a08_qc_failures", "v_qc", """
select run_date, sample_id, 'review' as kind from v_qc where command = 'triage' and review_required union all
select run_date, sample_id, 'failed' from v_qc where command = 'regression' and not passed union all select run_date, sample_id, 'proposal' from v_qc where risk_score >= 8""")
def a08(spark, sf):
    return Q.qc_failures(V.v_qc(spark, sf))


@query("a09_evaluate_run", "v_qc", """
with r as (select run_date, count(*) filter (review_required) as a, count(*) filter (command = 'regression' and not passed) as b from v_qc group by 1)
select run_date, concat_ws(',', case when a > 0 then 'review_required=' || a end, case when b > 0 then 'regression_failed=' || b end) as reasons, a > 0 or b > 0 as fails from r""")
def a09(spark, sf):
    return Q.evaluate_run(V.v_qc(spark, sf))


STAGES = """m as (select sample_id, count(*) as attempts, sum(inspect_before_ms + inspect_after_ms)::bigint as inspect_ms, sum(fix_ms)::bigint as fix_ms, sum(judge_ms)::bigint as judge_ms,
  arg_max(decision, attempt) as latest_decision from v_attempts group by 1)"""


@query("a10_sample_stage_metrics", "v_attempts", f"""
with {STAGES} select *, case when greatest(inspect_ms, fix_ms, judge_ms) <= 0 then '' when inspect_ms >= fix_ms and inspect_ms >= judge_ms then 'inspect' when fix_ms >= judge_ms then 'fix' else 'judge' end as bottleneck_stage from m""")
def a10(spark, sf):
    return Q.sample_stage_metrics(V.v_attempts(spark, sf))


@query("a11_batch_metrics", "v_attempts", f"""
with {STAGES}, s as (select count(*) as samples, count(*) filter (latest_decision = 'pass') as completed, sum(inspect_ms) as i, sum(fix_ms) as f, sum(judge_ms) as j from m)
select samples, completed, case when i >= f and i >= j then 'inspect' when f >= j then 'fix' else 'judge' end as slowest_stage from s""")
def a11(spark, sf):
    m = Q.sample_stage_metrics(V.v_attempts(spark, sf))
    return Q.batch_metrics(m.withColumn("finished_at", F.when(F.col("latest_decision") == "pass", "2024-01-05").otherwise(" ")))


@query("a12_outcome_counts", "v_attempts", "select count(*) filter (decision = 'pass') as passed, count(*) filter (decision = 'defer') as deferred, count(*) filter (decision = 'retry') as other from v_attempts")
def a12(spark, sf):
    return Q.outcome_counts(V.v_attempts(spark, sf).select(F.col("decision").alias("outcome")))


# Monitoring


TRANSITIONS = """r as (select *, count(*) filter (ok) over (partition by server order by ts, event_id) as run, lag(ok) over (partition by server order by ts, event_id) as before from v_probes),
c as (select *, count(*) filter (not ok) over (partition by server, run order by ts, event_id) as k from r),
t as (select server, ts, event_id, detail, k, case when ok then 'up' when k >= 2 then 'down' else 'degraded' end as state,
  case when ok and not before then 'recovered' when not ok and k = 2 then 'down' when not ok and k = 1 then 'degraded' end as transition from c)"""


@query("w13_probe_transitions", "v_probes", f"with {TRANSITIONS} select server, event_id, k as consecutive_failures, state, transition from t")
def w13(spark, sf):
    return N.probe_transitions(V.v_probes(spark, sf)).select("server", "event_id", "consecutive_failures", "state", "transition")


@query("p38_format_alerts", "v_probes", f"""
with {TRANSITIONS} select event_id, upper(transition) || ' Server (' || server || ') - ' || detail || case when transition <> 'recovered' then ' - failures=' || k else '' end ||
  chr(10) || 'url: https://' || server || chr(10) || 'time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') as message from t where transition is not null""")
def p38(spark, sf):
    t = N.probe_transitions(V.v_probes(spark, sf)).where("transition is not null")
    text = format_alert(
        F.col("transition"), F.lit("Server"), F.col("server"), F.col("detail"), F.col("consecutive_failures"),
        F.concat(F.lit("https://"), "server"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    )
    return t.select("event_id", text.alias("message"))


@query("a14_server_status", "v_probes", """
with l as (select server, last(ok order by ts, event_id) as ok from v_probes group by server)
select coalesce(bool_or(server = 'server2' and ok), false) as primary_healthy, coalesce(string_agg(server, ',' order by server) filter (ok), '') as healthy,
  coalesce(string_agg(server, ',' order by server) filter (ok and server <> 'server2'), '') as fallback, bool_or(ok) and not bool_and(ok) as mismatch,
  case when coalesce(bool_or(server = 'server2' and ok), false) then 'server2' else min(server) filter (ok and server <> 'server2') end as recommended from l""")
def a14(spark, sf):
    return N.server_status(V.v_probes(spark, sf), "server2")


@query("a17_connector_health", (), """
select 't' || (user_id % 20) as tunnel, 'c' || last(event_id order by ts, lpad(event_id::varchar, 9, '0')) as kept, count(*) as total, count(*) - 1 as stale, 1::bigint as healthy from events group by 1""")
def a17(spark, sf):
    c = V.events(spark, sf).select(F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("tunnel"), F.col("ts").alias("created"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("connector_id"))
    return N.connector_health(c)


@query("t1b_over_quota", "v_requests", """
select event_id, count(*) over (partition by key order by ts range between interval 1 day preceding and current row) as in_window from v_requests qualify in_window > 2""")
def t1b(spark, sf):
    return N.over_quota(V.v_requests(spark, sf), 2, 86400).select("event_id", "in_window")


@query("s16_write_report", "v_overall", """
with m as (select engine, avg(overall) as o, avg(teds) filter (nid > 5) as t from v_overall group by engine)
select engine, '| ' || engine || ' | ' || printf('%.4f', o) || ' | n/a |' as cells from m""")
def s16(spark, sf):
    from foliant.sources.reports import markdown_cells

    m = _overall(spark, sf).groupBy("engine").agg(F.avg("overall").alias("o"), F.avg(F.when(F.col("nid") > 5, F.col("teds"))).alias("t"))
    return m.select("engine", markdown_cells(m, "engine", "o", "t").alias("cells"))


