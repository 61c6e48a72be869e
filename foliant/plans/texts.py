"""Queries of joins across sources, of documents as lines, and of texts against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import convert as X
from foliant.operators import evaluate as E
from foliant.operators import pages as PG
from foliant.operators import lines as L
from foliant.operators import matching as M
from foliant.plans import views as V
from foliant.plans._registry import query
from foliant.plans.scalars import EXTENSION, KEY
from foliant.plans.tables import AT, DELTAS, LATEST, _overall
from foliant.sources.scratch import stored

NORM = r"trim(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^ | $', '', 'g'))"
COMPACT = "regexp_replace({}, '[^0-9A-Za-z가-힣]', '', 'g')"

# Joins


@query("j01_pair_predictions", ("v_markdown", "v_pred"), """
select m.doc_id, md5(coalesce(p.text, '')) as prediction_md5, p.text is not null as prediction_available from v_markdown m left join v_pred p on p.doc_id = m.doc_id and p.engine = 'a'""")
def j01(spark, sf):
    pred = V.v_pred(spark, sf).where("engine = 'a'").select("doc_id", "text")
    return M.pair_predictions(V.v_markdown(spark, sf), pred).select("doc_id", F.md5("prediction").alias("prediction_md5"), "prediction_available")


@query("j02_merge_engines", ("v_overall", "v_items"), f"""
with {LATEST}, m as (select news_item_id, approve_date, 'd' || lpad(news_item_id, 8, '0') as document_id from latest)
select m.document_id, a.document_id is not null as a_available, b.document_id is not null as b_available, round(a.overall - b.overall, 6) + 0 as delta_overall
from m left join v_overall a on a.document_id = m.document_id and a.engine = 'a' left join v_overall b on b.document_id = m.document_id and b.engine = 'b'""")
def j02(spark, sf):
    manifest = C.latest_by_id(V.v_items(spark, sf)).select(F.concat(F.lit("d"), F.lpad("news_item_id", 8, "0")).alias("document_id"), "approve_date")
    got = M.merge_engines(manifest, _overall(spark, sf, "a"), _overall(spark, sf, "b"))
    return got.select("document_id", "a_available", "b_available", F.round("delta_overall", 6).alias("delta_overall"))


@query("j03_paired_deltas", "v_overall", f"with {DELTAS} select document_id, round(delta, 6) + 0 as delta from d")
def j03(spark, sf):
    return M.paired_deltas(_overall(spark, sf, "a"), _overall(spark, sf, "b")).select("document_id", F.round("delta", 6).alias("delta"))


@query("j04_engine_matrix", ("v_docs", "v_pred"), """
select d.doc_id, e.engine, case when p.doc_id is not null then 'available' when e.engine = 'a' then 'failed' when e.engine = 'm' then 'manual_missing' else 'missing' end as status
from v_docs d cross join (values ('a'), ('b'), ('m')) e(engine) left join v_pred p on p.doc_id = d.doc_id and p.engine = e.engine""")
def j04(spark, sf):
    docs = V.v_docs(spark, sf)
    status = docs.select("doc_id", F.lit("a").alias("engine"), F.lit("failed").alias("status"))
    return M.engine_matrix(docs, {"a": False, "b": False, "m": True}, status, V.v_pred(spark, sf))


@query("j05_match_artifacts", "v_jobs", r"""
with j as (select job_id, split_part(job_id, '_', 2)::bigint as n, file_name from v_jobs)
select job_id, 'originals/' || job_id || '-a ' || file_name as hwpx, case when n % 3 = 0 then 'originals/' || job_id || '-b.pdf' end as pdf,
  case when n % 4 = 0 then 'results/' || job_id || '.md' when n % 4 = 1 then 'results/named' || n || '.md' end as result,
  case when n % 6 = 0 then 'golden/' || job_id || '.preview.md' when n % 6 = 1 then 'golden/Title ' || n || '.md' end as golden from j where n % 5 <> 0""")
def j05(spark, sf):
    jobs = V.v_jobs(spark, sf).withColumn("n", F.split_part("job_id", F.lit("_"), F.lit(2)).cast("long"))
    text = F.col("n").cast("string")
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    one = lambda cond, path: jobs.where(cond).select(path.alias("path"))
    originals = one("n % 5 <> 0", cat("originals/", F.col("job_id"), "-a ", F.col("file_name"))).unionByName(one("n % 3 = 0", cat("originals/", F.col("job_id"), "-b.pdf")))
    originals = originals.unionByName(one("n % 5 <> 0", cat("originals/", F.col("job_id"), "-z.hwpx")))
    results = one("n % 4 = 0", cat("results/", F.col("job_id"), ".md")).unionByName(one("n % 4 = 1", cat("results/named", text, ".md")))
    golden = one("n % 6 = 0", cat("golden/", F.col("job_id"), ".preview.md")).unionByName(one("n % 6 = 1", cat("golden/Title ", text, ".md")))
    table = jobs.select("job_id", cat("Title  ", text).alias("title"), F.when(F.col("n") % 4 == 1, cat("results/named", text, ".md")).alias("result_path"))
    return M.match_artifacts(originals, results, golden, table)


@query("j08_queue_with_triage", "v_triage", """
select sample_id, status, case when finding_count > 2 then 'item title' else 'meta' end as title, case when risk_score % 4 = 0 then true else coalesce(case when risk_score % 4 < 3 then review_required end, status <> 'curated') end as review_required,
  case when risk_score % 4 < 3 then risk_score else 0 end as risk_score from (select * replace (case when risk_score % 4 = 0 then true else review_required end as review_required) from v_triage)""")
def j08(spark, sf):
    t = V.v_triage(spark, sf).withColumn("review_required", F.when(F.col("risk_score") % 4 == 0, True).otherwise(F.col("review_required")))
    samples = t.select("sample_id", "status", F.lit("meta").alias("title"), F.lit("d").alias("approve_date"))
    items = t.where("finding_count > 1").select("sample_id", F.when(F.col("finding_count") > 2, "item title").otherwise("").alias("title"), F.lit("e").alias("approve_date"))
    got = M.queue_with_triage(items, samples, t.where("risk_score % 4 < 3"))
    return got.select("sample_id", "status", "title", "review_required", "risk_score")


_QUERY_SQL = "case news_item_id::bigint % 3 when 0 then title when 1 then array_to_string(string_split(title, ' ')[1:3], ' ') else array_to_string(list_reverse(string_split(title, ' ')[1:3]), ' ') end"
_MATCH_SQL = rf"""
with {LATEST}, i as (select news_item_id, {AT} as at_ts, {KEY.format("replace(replace(lower(trim(title)), 'ai', '인공지능'), 'a.i.', '인공지능')")} as t from latest),
q0 as (select news_item_id as query_id, {_QUERY_SQL} as query from latest where news_item_id::bigint % 20 = 0),
q1 as (select query_id, {KEY.format("replace(replace(lower(trim(query)), 'ai', '인공지능'), 'a.i.', '인공지능')")} as q from q0),
q2 as (select *, replace(q, ' ', '') as qc, list_filter(regexp_split_to_array(q, '[\s()/-]+'), lambda x: len(x) >= 2 and x not in ('보도자료', '보도참고', '보도참고자료', '국정브리핑')) as kept from q1 where q <> ''),
q as (select *, case when list_contains(kept, qc) then kept else list_append(kept, qc) end as toks from q2),
h as (select query_id, news_item_id, at_ts, q, t, qc, len(toks) as n, len(list_filter(toks, lambda x: contains(t, x) or contains(replace(t, ' ', ''), x))) as hits from q, i where t <> ''),
m as (select *, case when q = t then 0 when contains(t, q) then 1 when contains(replace(t, ' ', ''), qc) then 2 when hits >= greatest(2, least(n, 3)) then 10 - least(hits, 9) end as rank from h)"""


@query("j09_match_titles", "v_items", _MATCH_SQL + """
select query_id, news_item_id, rank::int as rank, row_number() over (partition by query_id order by rank, at_ts desc nulls last, news_item_id) as place from m where rank is not null qualify place <= 3""")
def j09(spark, sf):
    items = C.latest_by_id(V.v_items(spark, sf))
    n = F.col("news_item_id").cast("int")
    words = F.slice(F.split("title", " "), 1, 3)
    text = F.when(n % 3 == 0, F.col("title")).when(n % 3 == 1, F.array_join(words, " ")).otherwise(F.array_join(F.reverse(words), " "))
    queries = items.where(n % 20 == 0).select(F.col("news_item_id").alias("query_id"), text.alias("query"))
    return M.best_titles(queries, items, 3).select("query_id", "news_item_id", "rank", F.col("place").cast("long").alias("place"))


_SAMPLES_SQL = rf"""
with {LATEST}, i as (select news_item_id, title, news_item_id::bigint as place, {AT}::date as day from latest),
s as (select 's' || news_item_id as sample_id, case when place % 2 = 0 then title else 'other ' || place end as title, 'dir/' || strftime(day, '%y%m%d') || '_doc' || place || '.hwpx' as source, place, day
  from i where day is not null),
f as (select item_id::varchar as news_item_id, {COMPACT.format("regexp_replace(file_name, '(.)\\.[^.]*$', '\\1')")} as stem, {EXTENSION} as ext from v_attachments),
c as (select s.sample_id, i.news_item_id, i.place, {COMPACT.format('s.title')} as a, {COMPACT.format('i.title')} as b, strftime(s.day, '%y%m%d') || 'doc' || s.place as src from s join i using (day)),
g as (select c.sample_id, c.news_item_id, c.place, c.a, c.b, coalesce(sum(case when f.stem = c.src then 6 when f.stem <> '' and (contains(c.src, f.stem) or contains(f.stem, c.src)) then 4 else 0 end), 0) as fs,
  coalesce(max((f.ext = '.pdf')::int), 0) as pdf from c left join f using (news_item_id) group by all),
k as (select sample_id, news_item_id, place, (case when a = b then 5 when b <> '' and (contains(a, b) or contains(b, a)) then 3 else 0 end + fs + pdf)::bigint as score from g),
best as (select * from k where score >= 5 qualify row_number() over (partition by sample_id order by score desc, place, news_item_id) = 1)"""


def _samples(spark, sf):
    items = C.latest_by_id(V.v_items(spark, sf)).select("news_item_id", "title", "approve_date", F.col("news_item_id").cast("long").alias("place"))
    items = stored(items, "candidates")  # samples are made of them, too
    from foliant.functions.dates import parse_approve_ts

    day = F.date_format(parse_approve_ts(F.col("approve_date")), "yyMMdd")
    num = F.col("place").cast("string")
    title = F.when(F.col("place") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("other "), num))
    source = F.concat(F.lit("dir/"), day, F.lit("_doc"), num, F.lit(".hwpx"))
    samples = items.where(day.isNotNull()).select(F.concat(F.lit("s"), "news_item_id").alias("sample_id"), title.alias("title"), source.alias("source"))
    files = V.v_attachments(spark, sf).select(F.col("item_id").cast("string").alias("news_item_id"), "file_name")
    return samples, items, files


@query("j10_score_candidates", ("v_items", "v_attachments"), _SAMPLES_SQL + " select sample_id, news_item_id, score from best")
def j10(spark, sf):
    return M.score_candidates(*_samples(spark, sf))


@query("j11_backfill_plan", ("v_items", "v_attachments"), _SAMPLES_SQL.replace("c as (select s.sample_id", """pf as (select distinct news_item_id from f where ext = '.pdf'), ip as (select i.* from i join pf using (news_item_id)),
c as (select s.sample_id""").replace("from s join i using (day)", "from s join ip i using (day)") + rf""",
e1 as (select {NORM.format('title')} as k, arg_min(news_item_id, place) as i1 from ip group by 1), e2 as (select {COMPACT.format('title')} as k, arg_max(news_item_id, place) as i2 from ip group by 1)
select s.sample_id, case when s.place % 8 = 0 then 'already_present' when coalesce(i1, i2, best.news_item_id) is not null then 'backfilled' else 'catalog_miss' end as status,
  case when s.place % 8 <> 0 then coalesce(i1, i2, best.news_item_id) end as news_item_id
from s left join e1 on e1.k = {NORM.format('s.title')} left join e2 on e2.k = nullif({COMPACT.format('s.title')}, '') left join best using (sample_id)""")
def j11(spark, sf):
    samples, items, files = _samples(spark, sf)
    have = samples.where(F.substring("sample_id", 2, 12).cast("long") % 8 == 0)
    return M.backfill_plan(samples, items, files, have)


@query("j12_attach_recent_media", ("v_messages", "v_media"), """
select m.message_id, arg_max(d.path, strftime(d.ts, '%Y%m%d%H%M%S%f') || d.path) as media_path from v_messages m left join v_media d
on d.sender = m.sender and d.path like '%.md' and d.ts <= m.ts and d.ts >= m.ts - interval 15 minute group by 1""")
def j12(spark, sf):
    return M.attach_recent_media(V.v_messages(spark, sf), V.v_media(spark, sf)).select("message_id", "media_path")


@query("j13_compare_outputs", "v_pred", """
select doc_id::varchar as sample_id, count(distinct engine) as servers, count(distinct sha256(text)) > 1 as text_mismatch, count(distinct sha256(left(text, 20))) > 1 as html_mismatch from v_pred group by 1""")
def j13(spark, sf):
    p = V.v_pred(spark, sf).select(F.col("doc_id").cast("string").alias("sample_id"), F.col("engine").alias("server"), F.sha2("text", 256).alias("text_hash"), F.sha2(F.substring("text", 1, 20), 256).alias("html_hash"))
    return M.compare_outputs(p)


@query("j16_example_texts", ("v_markdown", "v_pred"), """
select m.doc_id, left(m.text, 80) as truth, coalesce(left(a.text, 80), '') as a, coalesce(left(b.text, 80), '') as b from v_markdown m left join v_pred a on a.doc_id = m.doc_id and a.engine = 'a'
left join v_pred b on b.doc_id = m.doc_id and b.engine = 'b'""")
def j16(spark, sf):
    pred = V.v_pred(spark, sf)
    one = lambda e: pred.where(F.col("engine") == e)
    md = V.v_markdown(spark, sf)
    return M.example_texts(md.select("doc_id"), {"truth": md, "a": one("a"), "b": one("b")}, 80)


# Lines

_LINES = "l as (select doc_id, i - 1 as pos, line from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select doc_id, string_split(text, chr(10)) as ls from v_markdown where text <> '')))"
_SECTION = r"s as (select *, coalesce(last_value(nullif(trim(regexp_extract(trim(line), '^#{1,6}\s+(.+)$', 1)), '') ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), 'body') as section from l)"
_UNITS = r"""p as (select *, trim(line) as x, trim(line) <> '' and not regexp_matches(trim(line), '^(#{1,6}\s+|>|!\[[^\]]*\]\([^)]+\)$|[-*]\s+|[0-9]+\.\s+|(-{3,}|\*{3,}|_{3,})$|```)') and not contains(line, '|') as plain from s),
b as (select *, coalesce(lag(plain) over (partition by doc_id order by pos), false) as before from p),
n as (select *, sum(case when x = '' then 0 when not plain or not before then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as unit from b),
u as (select doc_id, unit::bigint as unit, min(section) as section, trim(regexp_replace(string_agg(x, ' ' order by pos), '\s+', ' ', 'g')) as text from n where x <> '' group by doc_id, unit)"""


def _lines(spark, sf):
    return L.lines_of(V.v_markdown(spark, sf), "doc_id")


@query("w03_assign_sections", "v_markdown", f"with {_LINES}, {_SECTION} select doc_id, pos::int as pos, section from s")
def w03(spark, sf):
    return L.assign_sections(_lines(spark, sf), "doc_id").select("doc_id", "pos", "section")


@query("w04_paragraph_units", "v_markdown", f"with {_LINES}, {_SECTION}, {_UNITS} select * from u")
def w04(spark, sf):
    return L.paragraph_units(_lines(spark, sf), "doc_id")


@query("w05_drop_image_appendix", "v_markdown", f"""
with {_LINES}, e as (select *, case when starts_with(trim(line), '## ') and contains(line, 'the') then 1 when starts_with(trim(line), '## ') and contains(line, 'an') then 0 end as ev from l),
k as (select *, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), 0) as skip from e)
select doc_id, pos::int as pos, line from k where skip = 0 or ev = 1 union all select doc_id, pos::int, '_left out_' from k where ev = 1""")
def w05(spark, sf):
    return L.drop_marked_sections(_lines(spark, sf), "doc_id", appendix="an", image="the", note="_left out_")


@query("w06_collapse_blanks", "v_markdown", f"""
with {_LINES}, d as (select doc_id, pos * 2 + k as pos, case when k = 1 then '' else line end as line from l cross join (values (0), (1)) t(k)),
r as (select *, sum((trim(line) <> '')::int) over (partition by doc_id order by pos rows unbounded preceding) as run, sum((trim(line) <> '')::int) over (partition by doc_id order by pos rows between current row and unbounded following) as later from d),
n as (select *, row_number() over (partition by doc_id, run order by pos) - (run > 0)::int as place from r)
select doc_id, pos::int as pos, case when trim(line) = '' then '' else line end as line from n where trim(line) <> '' or (place <= 1 and later > 0)""")
def w06(spark, sf):
    doubled = _lines(spark, sf).select("doc_id", F.explode(F.array(F.struct((F.col("pos") * 2).alias("pos"), "line"), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit("").alias("line")))).alias("x")).select("doc_id", "x.*")
    return L.collapse_blanks(doubled, "doc_id")


_INDENTED = r"d as (select doc_id, pos, case when pos % 5 = 1 and regexp_matches(line, '^([-*+]|>)') then '   ' || line when pos % 11 = 4 then '---' else line end as line from l)"


@query("w07_indent_normalize", "v_markdown", rf"""
with {_LINES}, {_INDENTED},
i as (select doc_id, pos, case when regexp_matches(ltrim(line), '^([-*+]|[0-9]+[.)])\s+|^>') and len(line) - len(ltrim(line)) >= 2 then repeat(' ', ((len(line) - len(ltrim(line))) // 2 * 4)::int) || ltrim(line) else line end as line from d),
p as (select *, last_value(nullif(trim(line), '') ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as previous, coalesce(trim(lag(line) over (partition by doc_id order by pos)) <> '', false) as touching from i),
o as (select doc_id, pos, case when regexp_matches(trim(line), '^(-{{3,}}|\*{{3,}}|_{{3,}})$') then case when touching then ['', '<hr />', ''] else ['<hr />', ''] end
  when regexp_matches(line, '^[-*+]\s+') and previous is not null and not regexp_matches(previous, '^([-*+]|[0-9]+[.)])\s+') and not starts_with(previous, '#') then ['', line]
  when starts_with(trim(line), '>') and coalesce(starts_with(previous, '|'), false) and touching then ['', line] else [line] end as out from p)
select doc_id, pos::int as pos, (generate_subscripts(out, 1) - 1)::int as sub, unnest(out) as line from o""")
def w07(spark, sf):
    lines = _lines(spark, sf)
    pos, line = F.col("pos"), F.col("line")
    indented = F.when((pos % 5 == 1) & line.rlike(r"^([-*+]|>)"), F.concat(F.lit("   "), line)).when(pos % 11 == 4, "---").otherwise(line)
    return L.indent_normalize(lines.withColumn("line", indented), "doc_id")


@query("s18_read_ranking_doc", (), """
select doc_id, 0 as row, 'a' || doc_id as first, 6 as cells from documents union all select doc_id, 1, 'b' || doc_id, 6 from documents where doc_id % 2 = 0""")
def s18(spark, sf):
    n = F.col("doc_id").cast("string")
    row = lambda c, k: F.concat(F.lit(f"| {c}"), n, F.lit(" |" + " x |" * (k - 1) + "\n"))
    text = F.concat(F.lit("intro\n| skipped | y |\n\n| rank | a | b | c | d | e |\n| --- | --- | --- | --- | --- | --- |\n"), row("a", 6), row("s", 3), F.when(F.col("doc_id") % 2 == 0, row("b", 6)).otherwise(""), F.lit("after\n| z | z | z | z | z | z |\n"))
    cells = L.section_rows(text, "| rank")
    six = F.filter(cells, lambda r: F.size(r) >= 6)
    rows = V.table(spark, sf, "documents").select("doc_id", F.posexplode(six).alias("row", "r"))
    return rows.select("doc_id", "row", F.col("r")[0].alias("first"), F.size("r").alias("cells"))


@query("s18b_section_fields", (), """
select doc_id, 'sample_' || doc_id as sample_id, 'Title ' || doc_id as title, source as feature, case when doc_id % 2 = 0 then 'wait ' || doc_id else '' end as reason from documents where doc_id % 3 > 0""")
def s18b(spark, sf):
    n = F.col("doc_id").cast("string")
    named = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("sample id: `sample_"), n, F.lit("`\n"))).otherwise("no id\n")
    why = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("- reason: wait "), n, F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# ranking\n- feature: none\n## 1. Title "), n, F.lit("\n"), named, F.lit("- feature: old\n- feature:  "), F.coalesce("source", F.lit("")), F.lit("\n"), why, F.lit("## 2. empty\n- feature: x"))
    found = L.section_fields(text, {"feature": "- feature:", "reason": "- reason:"}, r"sample id:\s*`([^`]+)`")
    return V.table(spark, sf, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


# Evaluation

_PAIRS = """g as (select e.engine, m.doc_id, m.text as truth, coalesce(p.text, '') as prediction, p.text is not null as available from v_markdown m cross join (values ('a'), ('b')) e(engine)
  left join v_pred p on p.doc_id = m.doc_id and p.engine = e.engine),
x as (select engine, doc_id, 1 as side, string_split(truth, chr(10)) as ls from g where truth <> '' union all select engine, doc_id, 2, string_split(prediction, chr(10)) from g where prediction <> ''),
y as (select engine, doc_id, side, generate_subscripts(ls, 1) - 1 as pos, unnest(ls) as line from x)"""


def _dice_sql(name: str, items: str) -> str:
    return f"""{name}_i as ({items}), {name}_n as (select engine, doc_id, item, count(*) filter (side = 1) as a, count(*) filter (side = 2) as b from {name}_i group by all),
{name} as (select engine, doc_id, 2 * sum(least(a, b)) / (sum(a) + sum(b)) as d, sum(a) as truth from {name}_n group by all)"""


_ORDER = rf"""{_dice_sql("tok", r"select engine, doc_id, side, unnest(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda t: t <> '')) as item from y")},
o as (select engine, doc_id, trim(line) as line, max(pos) filter (side = 1) as pa, max(pos) filter (side = 2) as pb from y where trim(line) <> '' group by engine, doc_id, trim(line) having count(*) filter (side = 1) = 1 and count(*) filter (side = 2) = 1),
o2 as (select *, lag(pb) over (partition by engine, doc_id order by pa) as before from o), ord as (select engine, doc_id, avg((pb > before)::int) as keep from o2 where before is not null group by all)"""
_CELLS = r"""tr as (select engine, doc_id, side, regexp_split_to_array(regexp_replace(trim(line), '^\||\|$', '', 'g'), '\|') as cs from y where starts_with(trim(line), '|'))"""
_TABLE = f"""{_CELLS}, {_dice_sql("tab", "select engine, doc_id, side, len(cs) || '|' || trim(unnest(cs)) as item from tr")}, {_dice_sql("tabs", "select engine, doc_id, side, len(cs)::varchar as item from tr")},
tn as (select engine, doc_id, greatest(coalesce(sum(len(cs)) filter (side = 1), 0), coalesce(sum(len(cs)) filter (side = 2), 0)) > 60 as over_budget from tr group by all)"""
_HEAD = rf"""hd as (select engine, doc_id, side, len(regexp_extract(trim(line), '^#+')) as level, trim(regexp_replace(trim(line), '^#+', '')) as text from y where regexp_matches(trim(line), '^#{{1,6}}\s+\S')),
{_dice_sql("hea", "select engine, doc_id, side, level || '|' || text as item from hd")}, {_dice_sql("heas", "select engine, doc_id, side, level as item from hd")}"""


def _pairs(spark, sf):
    return E.pair_all(V.v_markdown(spark, sf), V.v_pred(spark, sf), ("a", "b"))


def _rounded(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


@query("e01_reading_order", ("v_markdown", "v_pred"), f"""
with {_PAIRS}, {_ORDER} select engine, doc_id, round(coalesce(tok.d, 1.0), 6)::double as tokens, round(ord.keep, 6) as "order" from g left join tok using (engine, doc_id) left join ord using (engine, doc_id)""")
def e01(spark, sf):
    return _rounded(E.reading_order_score(_pairs(spark, sf)), "tokens", "order")


@query("e02_table_score", ("v_markdown", "v_pred"), f"""
with {_PAIRS}, {_TABLE} select engine, doc_id, case when coalesce(tab.truth, 0) > 0 then round(tab.d, 6) end as "table", case when coalesce(tab.truth, 0) > 0 then round(tabs.d, 6) end as table_s
from g left join tab using (engine, doc_id) left join tabs using (engine, doc_id)""")
def e02(spark, sf):
    return _rounded(E.table_score(_pairs(spark, sf)), "table", "table_s").drop("table_timed_out")


@query("e03_heading_score", ("v_markdown", "v_pred"), f"""
with {_PAIRS}, {_HEAD} select engine, doc_id, case when coalesce(hea.truth, 0) > 0 then round(hea.d, 6) end as heading, case when coalesce(hea.truth, 0) > 0 then round(heas.d, 6) end as heading_s
from g left join hea using (engine, doc_id) left join heas using (engine, doc_id)""")
def e03(spark, sf):
    return _rounded(E.heading_score(_pairs(spark, sf)), "heading", "heading_s")


@query("e04_table_budget", ("v_markdown", "v_pred"), f"""
with {_PAIRS}, {_TABLE} select engine, doc_id, case when coalesce(tab.truth, 0) > 0 and not over_budget then round(tab.d, 6) end as "table", coalesce(tab.truth, 0) > 0 and over_budget as table_timed_out
from g left join tab using (engine, doc_id) left join tn using (engine, doc_id)""")
def e04(spark, sf):
    got = _rounded(E.table_score(_pairs(spark, sf), 60), "table").drop("table_s")
    return got.withColumn("table_timed_out", F.coalesce("table_timed_out", F.lit(False)))


_EVALUATED = f"""{_PAIRS}, {_ORDER}, {_TABLE}, {_HEAD}, ev as (select engine, doc_id, available, coalesce(tok.d, 1.0) as tokens, case when coalesce(tab.truth, 0) > 0 then tab.d end as t, case when coalesce(hea.truth, 0) > 0 then hea.d end as h
from g left join tok using (engine, doc_id) left join tab using (engine, doc_id) left join hea using (engine, doc_id))"""


@query("e5_evaluate_corpus", ("v_markdown", "v_pred"), f"""
with {_EVALUATED} select engine, count(*) as documents, count(*) filter (not available) as missing_predictions, round(avg(tokens), 6) as tokens_mean, round(avg(t), 6) as table_mean, count(t) as table_count,
  round(avg(h), 6) as heading_mean, round(avg((tokens + coalesce(t, 0) + coalesce(h, 0)) / (1 + (t is not null)::int + (h is not null)::int)), 6) as overall_mean from ev group by engine""")
def e5(spark, sf):
    s = E.evaluate_corpus(V.v_markdown(spark, sf), V.v_pred(spark, sf), ("a", "b"))
    mean = lambda c: F.round(F.avg(c), 6).alias(f"{c}_mean")
    return s.groupBy("engine").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("prediction_available")).alias("missing_predictions"),
        mean("tokens"), mean("table"), F.count("table").alias("table_count"), mean("heading"), mean("overall"),
    )


_DIFF = f"""{_PAIRS.replace("y as (select", "yy as (select")}, l as (select engine || '/' || side || '/' || doc_id as doc_id, pos, line from yy), {_SECTION}, {_UNITS},
v as (select split_part(doc_id, '/', 1) as engine, split_part(doc_id, '/', 2)::int as side, split_part(doc_id, '/', 3)::bigint as doc_id, unit, section, text from u),
c as (select *, row_number() over (partition by engine, doc_id, side, section, text order by unit) as n from v),
r as (select engine, doc_id, section, text, n, min(side) as side, min(unit) as unit from c group by engine, doc_id, section, text, n having count(*) = 1),
k as (select *, row_number() over (partition by engine, doc_id, side, section order by unit) as k from r),
df as (select engine, doc_id, section, k::int as k, max(text) filter (side = 1) as before, max(text) filter (side = 2) as after from k group by engine, doc_id, section, k)"""


@query("e06_corpus_diff", ("v_markdown", "v_pred"), f"""
with {_DIFF} select engine, doc_id, section, k, case when after is null then 'removed' when before is null then 'added' else 'changed' end as kind, md5(before) as before, md5(after) as after from df""")
def e06(spark, sf):
    d = E.corpus_diff(_pairs(spark, sf))
    return d.withColumn("before", F.md5("before")).withColumn("after", F.md5("after"))


@query("a13_diff_summary", ("v_markdown", "v_pred"), f"""
with {_DIFF} select engine, doc_id, count(*) filter (before is null) as added, count(*) filter (after is null) as removed, count(*) filter (before is not null and after is not null) as changed, count(distinct section) as sections from df group by all""")
def a13(spark, sf):
    return E.diff_summary(E.corpus_diff(_pairs(spark, sf)))


@query("e07_changed_words", ("v_markdown", "v_pred"), rf"""
with {_PAIRS}, w as (select engine, doc_id, list_filter(regexp_split_to_array(trim(truth), '\s+'), lambda t: t <> '') as a, list_filter(regexp_split_to_array(trim(prediction), '\s+'), lambda t: t <> '') as b from g)
select engine, doc_id, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]))::int as changed from w""")
def e07(spark, sf):
    return _pairs(spark, sf).select("engine", "doc_id", E.changed_words(F.col("truth"), F.col("prediction")).alias("changed"))


_PAGE_BLOCKS = r"""
with a as (select page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') as h from pages),
s as (select page_id, unnest(string_split_regex(regexp_replace(h, '(?i)<(/?)(h[1-6]|p|li|th|td|tr|table|ul|ol|div|article|section|nav|footer|header|body)\b[^>]*>', chr(1) || '\1\2' || chr(2), 'g'), chr(1))) as part,
  generate_subscripts(string_split_regex(regexp_replace(h, '(?i)<(/?)(h[1-6]|p|li|th|td|tr|table|ul|ol|div|article|section|nav|footer|header|body)\b[^>]*>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) , 1) as i from a),
b as (select page_id, i, lower(split_part(part, chr(2), 1)) as e, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(split_part(part, chr(2), 2), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) as t from s)"""

#: A page's lines from its flat blocks.
_PAGE_LINES = """string_agg(case when e[1] = 'h' and len(e) = 2 then repeat('#', e[2]::int) || ' ' || t when e = 'li' then '- ' || t when e in ('td', 'th') then '| ' || t || ' |' else t end, chr(10) order by i)"""

_PAGE_FROM = """from (select * from b where regexp_matches(e, '^(h[1-6]|p|li|th|td)$') and t <> '') group by page_id"""


@query("e08_pages_to_markdown", (), f"""{_PAGE_BLOCKS}
select page_id, md5({_PAGE_LINES}) as markdown_md5
{_PAGE_FROM}""")
def e08(spark, sf):
    return PG.pages_to_markdown(V.table(spark, sf, "pages")).select("page_id", F.md5("markdown").alias("markdown_md5"))


#: What each page gets at its end, and what becomes of it; @ is the page's id.
_PLANTED = (
    "<ul><li>one @<ul><li>two @</li><li><p>three</p></li></ul>tail @</li><li>four</li></ul>"
    "<table><tr><th>a @</th><th colspan='2'>b</th></tr><tr><td rowspan=\"2\">c</td><td>d<p>more</p></td><td>e</td></tr><tr><td>f @</td><td>g</td></tr></table>"
    "<table><tr><td>head @</td></tr><tr><td>- x</td></tr><tr><td>-y @</td></tr></table><p style=\"margin-left:30pt\">- in @</p><p>[ box @ ]</p>"
    "<table><tr><td>annex @</td><td></td></tr><tr><td>first</td><td>second</td></tr></table><table><tr><td>notice</td></tr></table>"
    "<table><tr><td>contact</td><td>n @</td><td>p</td><td>q</td></tr><tr><td>only</td><td>two</td></tr></table>"
    "<table><tr><td>agenda</td></tr><tr><td>item @</td><td>who</td><td>tel</td><td>mail</td></tr></table>"
)
_PLANTED_LINES = """- one @
  - two @
  - three
  tail @
- four
| a @ | b | b |
| --- | --- | --- |
| c | d more | e |
| c | f @ | g |
## head @
- x
- y @
  - in @
## [ box @ ]
## annex @
first second
## contact
- contact: n @ / p q
- only / two
## agenda
- item @
  - who
  - tel / mail"""


@query("e08b_page_structure", (), f"""{_PAGE_BLOCKS}, m as (select page_id, {_PAGE_LINES} as own
{_PAGE_FROM})
select p.page_id, md5(coalesce(own || chr(10), '') || replace('{_PLANTED_LINES}', '@', p.page_id::varchar)) as markdown_md5, len(coalesce(own || chr(10), '')) as own_chars from pages p left join m using (page_id)""")
def e08b(spark, sf):
    planted = F.replace(F.lit(_PLANTED), F.lit("@"), F.col("page_id").cast("string"))
    pages = V.table(spark, sf, "pages").select("page_id", F.concat("html", planted).alias("html"))
    rules = PG.Rules(labels=("notice",), appendix=("annex",), contacts=("contact",), agenda=("agenda",))
    end = F.replace(F.lit(_PLANTED_LINES), F.lit("@"), F.col("page_id").cast("string"))
    done = PG.pages_to_markdown(pages, rules)
    return done.select("page_id", F.md5("markdown").alias("markdown_md5"), (F.length("markdown") - F.length(end)).cast("long").alias("own_chars"))


@query("e09_document_header", ("v_docs",), """
select doc_id, '# ' || first_line || case when doc_id % 2 = 0 then chr(10) || '- source: web' else '' end || chr(10) || '- department: ' || department || chr(10) || '- time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') ||
  chr(10) || '  - [f' || doc_id || '.pdf](https://files.example/' || doc_id || ')' as header from v_docs""")
def e09(spark, sf):
    n = F.col("doc_id").cast("string")
    links = F.array(F.struct(F.concat(F.lit("f"), n, F.lit(".pdf")).alias("file_name"), F.concat(F.lit("https://files.example/"), n).alias("file_url")))
    source = F.when(F.col("doc_id") % 2 == 0, "web").otherwise("")
    header = E.document_header(F.col("first_line"), source, F.col("department"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), links)
    return V.v_docs(spark, sf).select("doc_id", header.alias("header"))


# Pluggable steps


def _shout(content: bytes) -> tuple[str, str]:
    """A stand-in converter that fails on some documents."""
    text = content.decode("utf-8")
    if text.startswith("T"):
        raise ValueError("no T")
    return text.upper(), f"<p>{len(text)}</p>"


@query("x01_convert_corpus", (), """
select doc_id::varchar as doc_id, case when doc_id % 10 = 9 then 'missing_input' when starts_with(text, 'T') then 'failed' else 'available' end as status,
  case when doc_id % 10 <> 9 and not starts_with(text, 'T') then '<p>' || len(text) || '</p>' end as html, case when doc_id % 10 <> 9 and starts_with(text, 'T') then 'ValueError: no T' end as error from documents""")
def x01(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 9, F.col("text").cast("binary")).alias("content"))
    return X.convert_corpus(docs, "upper", _shout).select("doc_id", "status", "html", "error")


@query("x02_run_stage", "v_qc", """
select 'frequency' as stage, '{"defect_class":"' || defect_class || '","n":' || n || '}' as payload from (select defect_class, count(*) as n from v_qc where review_required group by 1)
union all select 'evaluate', '{"run_date":"' || run_date || '","reasons":"' || concat_ws(',', case when a > 0 then 'review_required=' || a end, case when b > 0 then 'regression_failed=' || b end) || '","fails":' || (a > 0 or b > 0) || '}'
from (select run_date, count(*) filter (review_required) as a, count(*) filter (command = 'regression' and not passed) as b from v_qc group by 1)""")
def x02(spark, sf):
    from foliant.operators import qc as Q

    return X.run_stages(V.v_qc(spark, sf), {"frequency": Q.defect_frequency, "evaluate": Q.evaluate_run})
