"""The input views in DuckDB SQL: name -> (views it stands on, SQL). See views.py for the Spark side."""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_docs": ((), """
select doc_id, cast(doc_id as varchar) as news_item_id, coalesce(split_part(text, chr(10), 1), '') as first_line, source as department,
  timestamp '2023-12-20 00:00:00' + to_minutes((doc_id * 37 % 43200)::int) as ts from documents"""),
    "v_items": (("v_docs",), """
select news_item_id, first_line as title, department,
  case when doc_id % 50 = 7 then 'n/a' else strftime(ts, '%m/%d/%Y %H:%M:%S') end as approve_date,
  strftime(ts, '%Y-%m-%d') as day_file from v_docs
union all
select news_item_id, first_line || ' v2', department,
  case when doc_id % 50 = 7 then 'n/a' else strftime(ts, '%m/%d/%Y %H:%M:%S') end,
  strftime(ts + interval 1 day, '%Y-%m-%d') from v_docs where doc_id % 10 = 0"""),
    "v_attachments": ((), """
select l_orderkey as item_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::int as pos,
  case when l_linestatus = 'F' then '20240105_appendix ' else '' end || 'doc' || l_partkey ||
  case when l_partkey % 5 = 0 then upper(ext) else ext end as file_name,
  'https://files.example/' || l_orderkey || '/' || l_partkey as file_url
from (select *, case l_returnflag when 'A' then '.hwpx' when 'N' then '.pdf' else '.hwp' end as ext from lineitem)"""),
    "v_jobs": ((), """
select 'job_' || lpad(cast(o_orderkey as varchar), 8, '0') as job_id, cast(o_orderdate as timestamp) as created_at,
  cast(o_orderdate as timestamp) + to_days((o_custkey % 10)::int) as updated_at,
  case when o_orderstatus = 'O' then 'queued' when o_orderstatus = 'P' then 'processing' when o_custkey % 4 = 0 then 'failed' else 'completed' end as status,
  case when o_orderstatus = 'O' then 0 when o_orderstatus = 'P' then 25 else 100 end as progress,
  case when o_custkey % 3 = 0 then 'req_' || o_custkey else '' end as client_request_id,
  case o_orderkey % 3 when 0 then '' when 1 then 'text' else 'html' end as hwpx_table_mode,
  case when o_orderkey % 4 = 0 then '' else 'tok' || o_orderkey end as edit_token,
  case when o_orderstatus = 'P' then 'w' || (o_custkey % 4) end as claimed_by,
  case when o_orderstatus = 'F' and o_custkey % 4 = 0 then 'conversion_failed' end as error_code,
  case when o_orderkey % 5 = 0 then 'edited ' || o_orderkey else '' end as edited_markdown,
  case when o_orderkey % 2 = 0 then 'text ' || o_orderkey else '' end as markdown_text,
  case when o_orderkey % 3 = 1 then 'html ' || o_orderkey end as markdown_html,
  'primary ' || o_orderkey as markdown, 'file' || o_custkey || '.hwpx' as file_name
from orders"""),
    "v_job_events": ((), """
select cast(user_id as varchar) as job_id, ts, event_id, case event_type when 'signup' then 'create' when 'view' then 'claim'
  when 'click' then 'save_text' when 'purchase' then 'save_edit' else 'fail' end as kind, 'v' || event_id as payload from events"""),
    "v_probes": ((), """
select 'server' || (user_id % 5) as server, ts, event_id, event_type <> 'error' as ok,
  case when event_type = 'error' then 503 else 200 end as status, event_type as detail from events"""),
    "v_requests": ((), "select cast(user_id as varchar) as key, ts, event_id from events"),
    "v_messages": ((), """
select 'u' || (conv_id % 7) as sender, timestamp '2024-01-01 00:00:00' + to_minutes((conv_id * 60 + turn)::int) as ts,
  cast(conv_id as varchar) || '-' || turn as message_id,
  case turn % 6 when 0 then '/qc today' when 1 then '/qc failures' when 2 then '/qc rerun 2024-01-05' when 3 then '/server status'
    when 4 then 'start qc recent 7' else 'open policy_briefing_2024_01_05_156000123' end || ' ' || coalesce(text, '') as text
from conversations where role = 'user'"""),
    "v_media": ((), """
select 'u' || (user_id % 7) as sender, ts, '/media/' || event_id || case when event_id % 2 = 0 then '.md' else '.png' end as path
from events where event_type = 'purchase'"""),
    "v_scores": ((), """
select 'd' || lpad(cast(p_partkey as varchar), 8, '0') as document_id, 'a' as engine, (p_partkey * 7919 % 1000) / 1000.0::double as nid,
  case when p_size % 3 <> 0 then (p_partkey * 104729 % 1000) / 1000.0::double end as teds, (p_partkey * 31 % 997) / 1000.0::double as mhs from part
union all
select 'd' || lpad(cast(p_partkey as varchar), 8, '0'), 'b', (p_partkey * 6151 % 1000) / 1000.0::double,
  case when p_size % 3 <> 0 then (p_partkey * 1299709 % 1000) / 1000.0::double end, (p_partkey * 17 % 991) / 1000.0::double
from part where p_partkey % 50 <> 0"""),
    "v_overall": (("v_scores",), """
select *, case when nid is null and teds is null and mhs is null then null else
  (coalesce(nid, 0) + coalesce(teds, 0) + coalesce(mhs, 0)) / ((nid is not null)::int + (teds is not null)::int + (mhs is not null)::int) end as overall
from v_scores"""),
    "v_lines": ((), """
select doc_id, i::int as i, case (doc_id + i) % 7 when 0 then '## ' || line when 1 then '- ' || line
  when 2 then '| ' || replace(line, ' ', ' | ') || ' |' when 3 then '> ' || line when 4 then chr(10) || line else line end as line
from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)"""),
    "v_markdown": (("v_lines",), "select doc_id, string_agg(line, chr(10) order by i) as text from v_lines group by doc_id"),
    "v_pred": (("v_lines",), """
select 'a' as engine, doc_id, string_agg(line, chr(10) order by i) as text from v_lines
  where doc_id % 20 <> 0 and (doc_id + i) % 11 <> 0 group by doc_id
union all
select 'b', doc_id, string_agg(case when (doc_id + i) % 9 = 0 then lower(line) else line end, chr(10) order by case when doc_id % 13 = 0 then -i else i end)
  from v_lines where doc_id % 25 <> 0 group by doc_id"""),
    "v_triage": ((), """
select 'policy_briefing_2024_01_05_' || (156000000 + d.doc_id) as sample_id, case when d.doc_id % 6 = 0 then 'curated' else 'scratch' end as status,
  case when l.quality is not null then l.quality = 0 end as review_required, (n_chars % 10)::int as risk_score, (n_chars % 3)::int as hard_finding_count,
  (n_chars % 7)::int as finding_count, 'class' || (d.doc_id % 4) as defect_class
from documents d left join labels l on d.doc_id = l.doc_id"""),
    "v_qc": (("v_docs", "v_triage"), """
select strftime(v.ts, '%Y-%m-%d') as run_date, case when v.doc_id % 3 = 0 then 'regression' else 'triage' end as command, t.sample_id,
  v.doc_id % 5 <> 0 as passed, coalesce(t.review_required, t.status <> 'curated') as review_required, t.risk_score, t.defect_class
from v_docs v join v_triage t on t.sample_id = 'policy_briefing_2024_01_05_' || (156000000 + v.doc_id)"""),
    "v_attempts": ((), """
select 'sample' || user_id || '_' || (place // 5) as sample_id, (place % 5 + 1)::int as attempt, floor(value * 100 + 0.000001)::bigint as inspect_before_ms, floor(value * 150 + 0.000001)::bigint as fix_ms,
  floor(value * 50 + 0.000001)::bigint as inspect_after_ms, case when event_type = 'error' then 0 else floor(value * 220 + 0.000001)::bigint end as judge_ms,
  case event_type when 'purchase' then 'pass' when 'error' then 'defer' else 'retry' end as decision
from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events)"""),
}
