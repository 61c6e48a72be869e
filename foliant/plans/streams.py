"""Queries of streams, run over the events table to its end, and of their twins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans import views as V
from foliant.plans._registry import query
from foliant.sources.scratch import new_dir
from foliant.streaming import pipelines as P
from foliant.streaming import serving
from foliant.streaming import stateful as S

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf) -> DataFrame:
    return P.table_stream(spark, sf, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _zoned(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _job_events(events: DataFrame) -> DataFrame:
    k = F.col("event_type")
    kind = F.when(k == "signup", "create").when(k == "view", "claim").when(k == "click", "save_text").when(k == "purchase", "save_edit").otherwise("fail")
    return events.select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("payload"))


#: Whether a request is accepted hangs on those before it: a recursive query, one request of every key at a step.
_ACCEPTED = """with recursive e as (select user_id::varchar as key, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select key, event_id, k, true as accepted, [ts] as kept from e where k = 1
  union all select key, event_id, k, len(now) < 2, case when len(now) < 2 then list_append(now, ts) else now end
  from (select e.*, list_filter(r.kept, lambda x: x >= e.ts - interval 1 day) as now from r join e on e.key = r.key and e.k = r.k + 1))
select key, event_id, accepted from r"""


@query("t1_rate_limit", (), _ACCEPTED)
def t1(spark, sf):
    requests = _events(spark, sf).withWatermark("ts", "1 hour").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    return P.run_available(S.rate_limit(requests, 2, 86400, stream=True)).select("key", "event_id", "accepted")


@query("t1_rate_limit_table", (), _ACCEPTED)
def t1_table(spark, sf):
    return S.rate_limit(_zoned(V.v_requests(spark, sf)), 2, 86400).select("key", "event_id", "accepted")


def _monitor_sql(reminder: str, quiet: str) -> str:
    """A probe's state hangs on the one before, and a reminder on the alert before it: a recursive query, one probe of every server at a step."""
    return f"""with recursive e as (select 'server' || (user_id % 5) as server, event_id, ts, event_type <> 'error' as ok, row_number() over (partition by user_id % 5 order by ts, event_id) as k from events),
r as (select server, event_id, k, case when ok then 'up' else 'degraded' end as state, case when ok then 0 else 1 end as fails,
    case when not ok then 'degraded' end as alert, case when not ok then ts end as alerted from e where k = 1
  union all select server, event_id, k, state, fails, alert, case when alert is null then alerted else ts end
  from (select e.server, e.event_id, e.k, e.ts, r.alerted,
      case when e.ok then 'up' when r.state = 'down' or r.fails + 1 >= 2 then 'down' else 'degraded' end as state, case when e.ok then 0 else r.fails + 1 end as fails,
      case when e.ok then case when r.state <> 'up' then 'recovered' end
        when r.state = 'down' then case when (r.alerted is null or e.ts - r.alerted >= {reminder}) and not {quiet} then 'down_reminder' end
        when r.fails + 1 >= 2 then 'down' when r.state = 'up' then 'degraded' end as alert
    from r join e on e.server = r.server and e.k = r.k + 1))
select server, event_id, state, fails::bigint as consecutive_failures, alert from r"""


_QUIET = "(hour(e.ts + interval 9 hour) >= 2 and hour(e.ts + interval 9 hour) < 8)"


@query("t2_monitor", (), _monitor_sql("interval 1 hour", _QUIET))
def t2(spark, sf):
    e = _events(spark, sf).withWatermark("ts", "1 hour")
    probes = e.select(F.concat(F.lit("server"), (F.col("user_id") % 5).cast("string")).alias("server"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return P.run_available(S.monitor(probes, stream=True)).select("server", "event_id", "state", "consecutive_failures", "alert")


#: Without reminders the monitor's rows follow from the probes alone.
@query("t2_monitor_table", "v_probes", """
with r as (select *, count(*) filter (ok) over (partition by server order by ts, event_id) as run, lag(ok) over (partition by server order by ts, event_id) as before from v_probes),
c as (select *, count(*) filter (not ok) over (partition by server, run order by ts, event_id) as k from r)
select server, event_id, case when ok then 'up' when k >= 2 then 'down' else 'degraded' end as state, k as consecutive_failures,
  case when ok and not before then 'recovered' when not ok and k = 2 then 'down' when not ok and k = 1 then 'degraded' end as alert from c""")
def t2_table(spark, sf):
    got = S.monitor(_zoned(V.v_probes(spark, sf)), reminder_s=10**8)
    return got.select("server", "event_id", "state", "consecutive_failures", "alert")


#: In these tables runs of failures are short; reminders every ten minutes show in them.
@query("t2_monitor_reminders", (), _monitor_sql("interval 10 minute", _QUIET))
def t2_reminders(spark, sf):
    return S.monitor(_zoned(V.v_probes(spark, sf)), reminder_s=600).select("server", "event_id", "state", "consecutive_failures", "alert")


#: Each event asks for a day, its own or the one before; errors and sign-ups are planned failures, and every fourth fetch brings no item.
_SERVED = """with recursive q as (select *, row_number() over (partition by day order by ts, event_id) as k from (
    select event_id, ts, (ts::date - case when user_id % 3 = 0 then 1 else 0 end)::date as day, event_type, event_type not in ('error', 'signup') as ok, event_id % 4 as n from events)),
r as (select distinct day, 0::bigint as k, null::bigint as request_id, null::varchar as answer, null::varchar as reason, null::timestamp as last_at, null::bigint as fetch_id, 0::bigint as items from q
  union all select day, k, event_id, answer, case when answer in ('stale', 'failed') then 'provider ' || event_type end,
    case when answer = 'refreshed' then ts else last_at end, case when answer = 'refreshed' then event_id else fetch_id end, case when answer = 'refreshed' then n else items end
  from (select q.*, r.last_at, r.fetch_id, r.items, case when not case when q.day < q.ts::date then r.items = 0 else r.last_at is null or q.ts - r.last_at >= interval 1 hour end then 'fresh'
      when q.ok then 'refreshed' when r.items > 0 then 'stale' else 'failed' end as answer from r join q on q.day = r.day and q.k = r.k + 1))
"""


def _serve(spark, sf) -> str:
    asked = ["event_id as request_id", "date_sub(to_date(ts), if(user_id % 3 = 0, 1, 0)) as day", "ts as asked_at", "event_type not in ('error', 'signup') as ok", "concat('provider ', event_type) as reason"]
    landed = V.events(spark, sf).where("event_id % 4 > 0").select(F.col("event_id").alias("fetch_id"), F.explode(F.expr("sequence(1, event_id % 4)")).alias("k"))
    fetches = landed.select("fetch_id", F.concat_ws("-", "fetch_id", "k").alias("news_item_id"))
    path = new_dir(spark, "served")
    serving.serve_catalog_stream(_events(spark, sf).selectExpr(*asked), fetches, path, new_dir(spark, "served-log")).awaitTermination()
    return path


@query("t3_serve_catalog", (), _SERVED + """select request_id, day::varchar as day, answer, reason, epoch_us(last_at) as last_refreshed_us, fetch_id, items from r where k > 0""")
def t3_serve(spark, sf):
    answers = serving.read_answers(spark, _serve(spark, sf))
    return answers.select("request_id", F.col("day").cast("string").alias("day"), "answer", "reason", F.unix_micros("last_refreshed_at").alias("last_refreshed_us"), "fetch_id", "items")


@query("t3b_served_items", (), _SERVED + """, l as (select day, max_by(fetch_id, k) as fetch_id from r group by day)
select day::varchar as day, fetch_id, fetch_id || '-' || unnest(generate_series(1, fetch_id % 4)) as news_item_id from l where fetch_id % 4 > 0""")
def t3b(spark, sf):
    return serving.read_catalog(spark, _serve(spark, sf)).select(F.col("approve_day").cast("string").alias("day"), "fetch_id", "news_item_id")


@query("t4_dedupe_requests", (), "select distinct user_id from events")
def t4(spark, sf):
    requests = _events(spark, sf).select("user_id", "ts")
    return P.run_available(P.dedupe_requests(requests, "user_id", delay="3650 days")).select("user_id")


_JOBS = """with f as (select job_id, last(kind order by ts, event_id) filter (kind in ('create', 'claim', 'save_text', 'fail')) as state, count(*) filter (kind in ('save_text', 'save_edit'))::int as result_version,
  last(payload order by ts, event_id) filter (kind = 'fail') as err from v_job_events group by job_id)
select job_id, case state when 'claim' then 'processing' when 'fail' then 'failed' when 'save_text' then 'completed' else 'queued' end as status,
  case state when 'claim' then 25 when 'fail' then 100 when 'save_text' then 100 else 0 end as progress, result_version, case when state = 'fail' then err end as error from f"""


@query("t5_job_state_stream", "v_job_events", _JOBS)
def t5(spark, sf):
    events = _job_events(_events(spark, sf).withWatermark("ts", "1 hour"))
    return S.last_states(P.run_available(S.job_state(events, stream=True)))


@query("t5_job_state_table", "v_job_events", _JOBS)
def t5_table(spark, sf):
    return S.last_states(S.job_state(_zoned(V.v_job_events(spark, sf))))


#: A message comes out once the watermark has passed it: a minute behind the slower stream's last event.
@query("t6_media_for_messages", (), """
with c as (select event_id::varchar as message_id, user_id % 7 as sender, ts from events where event_type = 'click'),
p as (select user_id % 7 as sender, ts as media_ts, '/m/' || event_id || '.md' as path from events where event_type = 'purchase'),
j as (select c.message_id, c.ts, max_by(p.path, (p.media_ts, p.path)) as path from c left join p on p.sender = c.sender and p.media_ts <= c.ts and p.media_ts >= c.ts - interval 15 minutes group by all)
select message_id, path from j where ts < (select least((select max(ts) from c), (select max(media_ts) from p)) - interval 1 minute)""")
def t6(spark, sf):
    e = _events(spark, sf)
    sender = F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("sender")
    messages = e.where("event_type = 'click'").select(F.col("event_id").cast("string").alias("message_id"), sender, "ts")
    media = _events(spark, sf).where("event_type = 'purchase'").select(sender, "ts", F.concat(F.lit("/m/"), F.col("event_id").cast("string"), F.lit(".md")).alias("path"))
    return P.run_available(P.media_for_messages(messages, media)).select("message_id", "path")


@query("t7_expire_stream", "v_job_events", """
with s as (select *, case kind when 'create' then 'queued' when 'claim' then 'processing' when 'save_text' then 'completed' when 'fail' then 'failed' end as own from v_job_events),
l as (select *, coalesce(last_value(own ignore nulls) over (partition by job_id order by ts, event_id), 'queued') as status,
  row_number() over (partition by job_id order by ts desc, event_id desc) as k from s)
select job_id, status from l where k = 1 and status in ('completed', 'failed') and ts + interval 24 hours < (select max(ts) from s) - interval 1 hour""")
def t7(spark, sf):
    events = _job_events(_events(spark, sf).withWatermark("ts", "1 hour"))
    return P.run_available(S.expire_stream(events, 24))
