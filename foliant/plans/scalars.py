"""Queries of the projections and scalar functions (P1 to P39, and the scalar ones of S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import attachments as A
from foliant.functions import dates as D
from foliant.functions import markdown as M
from foliant.functions import messages as Q
from foliant.functions import scores as S
from foliant.functions import titles as T
from foliant.plans import views as V
from foliant.plans._registry import query

APPENDIX = ("appendix",)
SP = r"[\s\x{00A0}]+"
#: DuckDB SQL of a title's key; {} is the trimmed, lower-cased text with synonyms replaced.
KEY = r"trim(regexp_replace(regexp_replace(replace({}, '_', ' '), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s()-]', '', 'g'))"
TITLE_KEY = KEY.format("replace(replace(lower(trim(title)), 'ai', '인공지능'), 'a.i.', '인공지능')")
IS_APPENDIX = r"regexp_matches(regexp_replace(regexp_replace(trim(file_name), '^\s*[0-9]{6,8}(?:[\s_-]+)?', ''), '^[ _-]+', ''), '^(?:[\[<(]\s*)?(?:appendix)(?:[^\p{L}_]|$)')"
EXTENSION = r"regexp_extract(lower(file_name), '\.[^.]*$', 0)"


def _items(spark, sf):
    return V.v_items(spark, sf)


@query("p01_normalize_title", "v_docs", rf"""
select doc_id, trim(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&quot;', '"'), '&amp;', '&'), '{SP}', ' ', 'g')) as title
from (select doc_id, '  &lt;' || first_line || '&quot;  &amp;amp; x ' as t from v_docs)""")
def p01(spark, sf):
    raw = F.concat(F.lit("  &lt;"), "first_line", F.lit("&quot;  &amp;amp; x "))
    return V.v_docs(spark, sf).select("doc_id", T.normalize_title(raw).alias("title"))


@query("p02_attachment_extension", "v_attachments", f"select item_id, pos, {EXTENSION} as extension from v_attachments")
def p02(spark, sf):
    return V.v_attachments(spark, sf).select("item_id", "pos", A.attachment_extension(F.col("file_name")).alias("extension"))


@query("p03_is_appendix", "v_attachments", f"select item_id, pos, {IS_APPENDIX} as is_appendix from v_attachments")
def p03(spark, sf):
    return V.v_attachments(spark, sf).select("item_id", "pos", A.is_appendix(F.col("file_name"), APPENDIX).alias("is_appendix"))


def _with_arrays(spark, sf):
    """Items with their attachments in order; an item has at most a few."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "file_name", "file_url")))
    return V.v_attachments(spark, sf).groupBy("item_id").agg(listed.alias("attachments"))


@query("p04_has_appendix", "v_attachments", f"""
select item_id, bool_or({EXTENSION} = '.hwpx' and {IS_APPENDIX}) as has_appendix from v_attachments group by item_id""")
def p04(spark, sf):
    return _with_arrays(spark, sf).select("item_id", A.has_appendix(F.col("attachments"), ".hwpx", APPENDIX).alias("has_appendix"))


@query("p05_primary_attachment", "v_attachments", f"""
with k as (select item_id, file_name, row_number() over (partition by item_id order by {IS_APPENDIX}, pos) as rn from v_attachments where {EXTENSION} = '.hwpx'),
i as (select distinct item_id from v_attachments)
select i.item_id, k.file_name as primary_hwpx from i left join k on i.item_id = k.item_id and k.rn = 1""")
def p05(spark, sf):
    first = A.primary_attachment(F.col("attachments"), ".hwpx", APPENDIX)
    return _with_arrays(spark, sf).select("item_id", first["file_name"].alias("primary_hwpx"))


_STAMPS = r"""select doc_id, case doc_id % 4 when 0 then strftime(ts, '%m/%d/%Y %H:%M:%S') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 2 then strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H:%M') else 'n/a' end as s from v_docs"""


@query("p06_parse_approve_ts", "v_docs", f"""
select doc_id, strftime(try_strptime(s, '%m/%d/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as strict,
  strftime(coalesce(try_strptime(s, '%m/%d/%Y %H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(substr(s, 1, 10), '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') as either,
  strftime(coalesce(try_strptime(substr(s, 1, 10), '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y %H:%M:%S')), '%Y-%m-%d %H:%M:%S') as prefix
from ({_STAMPS})""")
def p06(spark, sf):
    form = lambda p: F.date_format("ts", p)
    kind = F.col("doc_id") % 4
    s = F.when(kind == 0, form(D.SLASHED)).when(kind == 1, form(D.DASHED)).when(kind == 2, form("yyyy-MM-dd'T'HH:mm")).otherwise("n/a")
    out = lambda v: F.date_format(D.parse_approve_ts(s, v), D.DASHED)
    return V.v_docs(spark, sf).select("doc_id", out("strict").alias("strict"), out("both").alias("either"), out("prefix").alias("prefix"))


@query("p07_on_day", "v_items", """
select news_item_id, title from v_items where try_strptime(approve_date, '%m/%d/%Y %H:%M:%S')::date = date '2023-12-31'""")
def p07(spark, sf):
    return _items(spark, sf).where(D.on_day(F.col("approve_date"), "2023-12-31")).select("news_item_id", "title")


@query("p08_title_key", "v_items", f"select news_item_id, day_file, {TITLE_KEY} as key from v_items")
def p08(spark, sf):
    return _items(spark, sf).select("news_item_id", "day_file", T.title_key(F.col("title")).alias("key"))


@query("p09_storage_key", "v_items", f"select news_item_id, day_file, {KEY.format('lower(trim(title))')} as key from v_items")
def p09(spark, sf):
    marked = F.concat("title", F.lit(":Zone.Identifier"))
    return _items(spark, sf).select("news_item_id", "day_file", T.storage_key(marked).alias("key"))


@query("p10_compact_key", "v_items", "select news_item_id, day_file, regexp_replace(title, '[^0-9A-Za-z가-힣]', '', 'g') as key from v_items")
def p10(spark, sf):
    return _items(spark, sf).select("news_item_id", "day_file", T.compact_key(F.col("title")).alias("key"))


_TOKENS = rf"""
select news_item_id, day_file, key, replace(key, ' ', '') as whole, list_filter(regexp_split_to_array(key, '[\s()/-]+'), lambda t: len(t) >= 2 and
  t not in ('보도자료', '보도참고', '보도참고자료', '국정브리핑')) as kept from (select *, {TITLE_KEY} as key from v_items)"""


@query("p11_title_tokens", "v_items", f"""
select news_item_id, day_file, case when key = '' then 0 else len(kept) + (not list_contains(kept, whole))::int end::int as n_tokens,
  case when key = '' then 0 else len(list_distinct(list_append(kept, whole))) end::int as n_distinct from ({_TOKENS})""")
def p11(spark, sf):
    title = F.col("title")
    return _items(spark, sf).select(
        "news_item_id", "day_file", F.size(T.title_tokens(title, distinct=False)).alias("n_tokens"), F.size(T.title_tokens(title)).alias("n_distinct")
    )


_MD = "(select doc_id, case when doc_id % 3 = 0 then '# Title ' || doc_id || chr(10) else '' end || text as text from v_markdown)"


def _markdown(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    return V.v_markdown(spark, sf).withColumn("text", F.concat(head, "text"))


@query("p12_extract_title", "v_markdown", rf"""
select doc_id, nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), '') as title,
  coalesce(nullif(trim(regexp_replace(regexp_extract(text, '(?m)^[ \t]*(#[^\n]*)$', 1), '^#+', '')), ''), 'none') as heading from {_MD}""")
def p12(spark, sf):
    return _markdown(spark, sf).select(
        "doc_id", M.extract_title(F.col("text")).alias("title"), M.extract_heading(F.col("text"), F.lit("none")).alias("heading")
    )


@query("p13_extract_department", "v_markdown", r"""
select doc_id, nullif(trim(regexp_extract(text, '(?m)^- ([^\n]+?(?:tion|ing))(?:[^\p{L}\p{N}_]|$)', 1)), '') as department from v_markdown""")
def p13(spark, sf):
    return V.v_markdown(spark, sf).select("doc_id", M.extract_department(F.col("text"), ("tion", "ing")).alias("department"))


_LABELLED = "(select doc_id, text, string_split(repeat(chr(10), (doc_id % 4)::int) || case when doc_id % 2 = 0 then '' else 'intro' || chr(10) end || 'PRESS' || chr(10) || text, chr(10)) as ls from v_markdown)"


@query("p14_inject_department", "v_markdown", f"""
with a as (select doc_id, ls, (select min(i) from range(0, len(ls)) t(i) where i >= 9 and trim(ls[i + 1]) <> '') as stop,
  (select min(i) from range(0, len(ls)) t(i) where trim(ls[i + 1]) = 'PRESS') as hit from {_LABELLED})
select doc_id, md5(case when doc_id % 5 = 0 or hit is null or hit > coalesce(stop, len(ls)) then array_to_string(ls, chr(10))
  else array_to_string(list_concat(ls[:hit], ['dept ' || doc_id || ' PRESS /'], ls[hit + 2:]), chr(10)) end) as text_md5 from a""")
def p14(spark, sf):
    n = F.col("doc_id")
    text = F.concat(
        F.repeat(F.lit("\n"), (n % 4).cast("int")), F.when(n % 2 == 0, "").otherwise("intro\n"), F.lit("PRESS\n"), "text"
    )
    dept = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("dept "), n.cast("string")))
    return V.v_markdown(spark, sf).withColumn("text", text).select(
        "doc_id", F.md5(M.inject_department(F.col("text"), dept, ("PRESS",))).alias("text_md5")
    )


@query("p15_clean_title", "v_items", r"select news_item_id, day_file, trim(title) as title from v_items")
def p15(spark, sf):
    tagged = F.concat(F.lit(" [press] "), "title")
    return _items(spark, sf).select("news_item_id", "day_file", T.clean_title(tagged).alias("title"))


@query("p16_score_band", "v_overall", """
select document_id, engine, case when overall >= 0.6 then 'strong' when overall >= 0.45 then 'mixed' else 'weak' end as band from v_overall""")
def p16(spark, sf):
    overall = S.overall_score(F.col("nid"), F.col("teds"), F.col("mhs"))
    return V.v_scores(spark, sf).select("document_id", "engine", S.score_band(overall).alias("band"))


@query("p17_metric_commentary", "v_scores", """
select document_id, engine, case when nid >= 0.9 then 'order_stable' when nid >= 0.8 then 'order_mostly_stable' else 'order_unstable' end || ',' ||
  case when teds is null then 'table_not_scored' when teds >= 0.75 then 'table_strong' when teds >= 0.4 then 'table_partial' else 'table_weak' end || ',' ||
  case when mhs >= 0.3 then 'heading_kept' when mhs > 0 then 'heading_partial' else 'heading_lost' end as commentary from v_scores""")
def p17(spark, sf):
    verdicts = S.metric_commentary(F.col("nid"), F.col("teds"), F.col("mhs"))
    return V.v_scores(spark, sf).select("document_id", "engine", F.array_join(verdicts, ",").alias("commentary"))


#: engine, rank, metric, at_least, below, verdict
ASSESSMENT = [
    ("a", 1, "tables", 3, None, "tables_kept"), ("a", 2, "headings", 2, None, "sections_kept"), ("a", 3, None, None, None, "clean_text"),
    ("b", 1, "lines", None, 6, "short_output"), ("b", 2, "quotes", 2, None, "many_quotes"), ("b", 3, None, None, None, "basic_text"),
]


@query("p18_assess_result", "v_pred", r"""
with m as (select engine, doc_id, doc_id % 9 <> 4 as available, len(string_split(regexp_replace(text, '\n$', ''), chr(10))) as lines, text = '' as none,
  len(regexp_extract_all(text, '(?m)^[ \t]*\|')) as tables, len(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+')) as headings,
  len(regexp_extract_all(text, '(?m)^>')) as quotes from v_pred)
select engine, doc_id, case when not available then 'not_assessed'
  when engine = 'a' then case when tables >= 3 then 'tables_kept' when headings >= 2 then 'sections_kept' else 'clean_text' end
  else case when lines < 6 then 'short_output' when quotes >= 2 then 'many_quotes' else 'basic_text' end end as verdict from m""")
def p18(spark, sf):
    s = M.markdown_structure(F.col("text"))
    names = ("lines", "tables", "images", "page_marks", "headings", "quotes")
    metrics = F.create_map(*(x for n in names for x in (F.lit(n), s[n].cast("int"))))
    results = V.v_pred(spark, sf).select(
        "engine", "doc_id", F.when(F.col("doc_id") % 9 != 4, "available").otherwise("failed").alias("status"), metrics.alias("metrics")
    )
    rules = spark.createDataFrame(ASSESSMENT, "engine string, rank int, metric string, at_least int, below int, verdict string")
    return S.assess_result(results, rules, ["doc_id"])


@query("p19_shorten", (), r"""
select doc_id, left(text, 40) as excerpt, case when len(trim(text)) <= 60 then trim(text) else rtrim(left(trim(text), 57)) || '...' end as short from documents""")
def p19(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", T.excerpt(text, 40).alias("excerpt"), T.shorten(text, 60).alias("short"))


@query("p20_sample_id", "v_docs", r"""
select doc_id, 'policy_briefing_' || strftime(ts, '%Y_%m_%d') || '_' || (156000000 + doc_id) as sample_id, cast(156000000 + doc_id as varchar) as item,
  case when doc_id % 2 = 0 then cast(156000000 + doc_id as varchar) end as in_text from v_docs""")
def p20(spark, sf):
    number = (F.lit(156000000) + F.col("doc_id")).cast("string")
    sample = T.sample_id(number, F.col("ts"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see page?newsId="), number, F.lit(" now"))).otherwise("see 12345")
    return V.v_docs(spark, sf).select(
        "doc_id", sample.alias("sample_id"), T.sample_item(sample).alias("item"), T.item_in_text(text).alias("in_text")
    )


@query("p21_safe_filename", "v_docs", r"""
select doc_id, coalesce(nullif(regexp_replace(f, '[^\p{L}\p{N}_\s.()-]', '_', 'g'), ''), 'document') as file_name
from (select doc_id, case when doc_id % 10 = 0 then '' else first_line || ':*' || doc_id || '.hwpx' end as f from v_docs)""")
def p21(spark, sf):
    name = F.when(F.col("doc_id") % 10 == 0, "up/dir/").otherwise(F.concat(F.lit("a/b/"), F.replace("first_line", F.lit("/"), F.lit("")), F.lit(":*"), F.col("doc_id").cast("string"), F.lit(".hwpx")))
    return V.v_docs(spark, sf).select("doc_id", T.safe_filename(name).alias("file_name"))


@query("p22_candidate_dates", "v_docs", r"""
with n as (select doc_id, ts, 'f' || case doc_id % 4 when 0 then '_' || strftime(ts, '%y%m%d') || '_' || strftime(ts, '%m-%d')
  when 1 then ' ' || strftime(ts, '%m-%d') when 2 then '(' || strftime(ts, '%m%d') || ')' else '_999999_02-30' end || '.hwpx' as file_name from v_docs)
select doc_id, case doc_id % 4 when 0 then strftime(ts, '%Y-%m-%d') || ',2026-' || strftime(ts, '%m-%d') || ',2025-' || strftime(ts, '%m-%d')
  when 3 then '' else '2026-' || strftime(ts, '%m-%d') || ',2025-' || strftime(ts, '%m-%d') end as dates from n""")
def p22(spark, sf):
    form = lambda p: F.date_format("ts", p)
    kind = F.col("doc_id") % 4
    tail = (
        F.when(kind == 0, F.concat(F.lit("_"), form("yyMMdd"), F.lit("_"), form("MM-dd"))).when(kind == 1, F.concat(F.lit(" "), form("MM-dd")))
        .when(kind == 2, F.concat(F.lit("("), form("MMdd"), F.lit(")"))).otherwise("_999999_02-30")
    )
    dates = D.candidate_dates(F.concat(F.lit("f"), tail, F.lit(".hwpx")))
    return V.v_docs(spark, sf).select("doc_id", F.array_join(F.transform(dates, lambda d: d.cast("string")), ",").alias("dates"))


@query("p23_classify_error", (), """
select event_id, case when event_type in ('error', 'view') then 'upstream_timeout' else event_type || ' refused' end as category from events""")
def p23(spark, sf):
    kind = F.col("event_type")
    message = F.when(kind == "error", "Read Timed Out after 5 s").when(kind == "view", "502 Bad Gateway").otherwise(F.concat(kind, F.lit(" refused ")))
    return V.table(spark, sf, "events").select("event_id", Q.classify_error(message).alias("category"))


@query("p24_fleet_version_check", (), r"""
select o_orderkey, o_orderkey % 3 < 1 or (o_orderkey % 3 = 1 and o_custkey % 10 < 4) as below_minimum,
  not (o_orderkey % 3 = 1 and o_custkey % 10 = 5) as differs, case when o_orderkey % 4 = 0 then 'package' when o_orderkey % 4 = 1 then 'bundled' else 'package' end as backend from orders""")
def p24(spark, sf):
    key = F.col("o_orderkey")
    version = F.concat(F.lit("v"), (key % 3).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.lit("-rc1"))
    path = F.when(key % 4 == 0, "/usr/lib/site-packages/conv/__init__.py").when(key % 4 == 1, "/srv/packages/conv/__init__.py").otherwise("/opt/conv.py")
    check = Q.fleet_version_check(F.regexp_replace(version, "^v", ""), path, "1.4", "v1.5-rc1")
    return V.table(spark, sf, "orders").select("o_orderkey", check["below_minimum"].alias("below_minimum"), check["differs"].alias("differs"), check["backend"].alias("backend"))


@query("p25_mask_spec", (), "select o_orderkey, 'git+https://***@host.example/' || o_custkey || '.git' as spec from orders")
def p25(spark, sf):
    spec = F.concat(F.lit(" git+https://user:"), F.col("o_orderkey").cast("string"), F.lit("@host.example/"), F.col("o_custkey").cast("string"), F.lit(".git "))
    return V.table(spark, sf, "orders").select("o_orderkey", Q.mask_spec(spec).alias("spec"))


@query("p26_markdown_structure", "v_markdown", r"""
select doc_id, case when text = '' then 0 else len(string_split(regexp_replace(text, '\n$', ''), chr(10))) end::int as lines,
  len(regexp_extract_all(text, '(?m)^[ \t]*\|'))::int as tables, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'))::int as images,
  len(regexp_extract_all(text, '(?m)^[ \t]*-?[ \t]*[0-9]+[ \t]*-?[ \t]*$'))::int as page_marks,
  len(regexp_extract_all(text, '(?m)^#{1,6}[ \t]+'))::int as headings, len(regexp_extract_all(text, '(?m)^>'))::int as quotes from v_markdown""")
def p26(spark, sf):
    return V.v_markdown(spark, sf).select("doc_id", M.markdown_structure(F.col("text")).alias("s")).select("doc_id", "s.*")


#: The given pages hold scripts alone, and what is added is known: no pattern is needed to say what stays.
@query("p27_strip_unsafe_html", (), """
select page_id, md5(array_to_string(list_transform(string_split(html, '<script>'),
  lambda x: case when contains(x, '</script>') then substr(x, instr(x, '</script>') + 9) else x end), '') || '<a href="#x()" >z</a>') as html_md5 from pages""")
def p27(spark, sf):
    html = F.concat("html", F.lit('<a href="javascript:x()" onclick="y()">z</a><form a=1></form>'))
    return V.table(spark, sf, "pages").select("page_id", F.md5(M.strip_unsafe_html(html)).alias("html_md5"))


RULES = [(r"[ \t]+", " "), (r" ([,.])", "$1"), (r"\.{2,}", "."), (r"\n{2,}", "\n")]
LITERALS = {" | ": " / ", "!!": "!"}


@query("p28_normalize_text_rules", (), r"""
select doc_id, md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ([,.])', '\1', 'g'), '\.{2,}', '.', 'g'), '\n{2,}', chr(10), 'g'),
  ' | ', ' / '), '!!', '!')) as text_md5 from documents""")
def p28(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(M.normalize_text_rules(F.col("text"), RULES, LITERALS)).alias("text_md5"))


@query("p29_parse_verdict", (), r"""
select event_id, case event_id % 4 when 0 then 'pass' when 1 then 'retry' when 2 then 'retry' else 'defer' end as decision,
  case event_id % 4 when 0 then 'high' else 'medium' end as confidence, case event_id % 4 when 0 then 'a' || event_id else '' end as blocking,
  case event_id % 4 when 3 then 'wait' else '' end as summary from events""")
def p29(spark, sf):
    n = F.col("event_id") % 4
    text = (
        F.when(n == 0, F.concat(F.lit('{"decision":" pass ","confidence":"high","blocking_findings":[" a'), F.col("event_id").cast("string"), F.lit(' ","",null]}')))
        .when(n == 1, "not json").when(n == 2, '{"decision":"maybe","blocking_findings":"none"}').otherwise('{"decision":"defer","user_summary":" wait "}')
    )
    v = Q.parse_verdict(text)
    return V.table(spark, sf, "events").select(
        "event_id", v["decision"].alias("decision"), v["confidence"].alias("confidence"),
        F.array_join(v["blocking_findings"], ",").alias("blocking"), v["user_summary"].alias("summary"),
    )


@query("p30_message_metadata", "v_messages", r"""
select message_id, sender as sender_id, case when m = 0 then message_id end as in_message, trim(regexp_replace(case when m = 1 then '"sender_id": "' || sender || '" ' || text else text end, '\s+', ' ', 'g')) as body
from (select *, len(message_id) % 3 as m from v_messages) where m < 2
union all
select message_id, substr(sender, 2), null, trim(regexp_replace(text, '\s+', ' ', 'g')) from v_messages where len(message_id) % 3 = 2""")
def p30(spark, sf):
    m = F.length("message_id") % 3
    text = (
        F.when(m == 0, F.concat(F.lit('Conversation info (untrusted metadata):\n```json\n{"sender_id": "'), "sender", F.lit('", "message_id": "'), "message_id", F.lit('"}\n```\n'), "text"))
        .when(m == 1, F.concat(F.lit('"sender_id": "'), "sender", F.lit('" '), "text"))
        .otherwise(F.concat(F.lit("[Chat someone id:"), F.substring("sender", 2, 9), F.lit(" now] "), "text"))
    )
    got = Q.message_metadata(text)
    return V.v_messages(spark, sf).select("message_id", got["sender_id"].alias("sender_id"), got["message_id"].alias("in_message"), got["body"].alias("body"))


@query("p31_message_media", "v_media", """
select path as source, i as pos, case i when 0 then path else '/x/' || path || '.MARKDOWN' end as path, case i when 0 then path like '%.md' else true end as is_markdown
from v_media cross join (values (0), (1)) t(i)""")
def p31(spark, sf):
    text = F.concat(F.lit('see <file name="/x/'), "path", F.lit('.MARKDOWN" mime="text/plain"> [media attached: '), "path", F.lit(" (text/markdown) | note]"))
    return V.v_media(spark, sf).select(F.col("path").alias("source"), F.posexplode(Q.message_media(text)).alias("pos", "m")).select(
        "source", "pos", F.col("m.path").alias("path"), F.col("m.is_markdown").alias("is_markdown")
    )


@query("p32_classify_intent", "v_messages", r"""
select message_id, case split_part(text, ' ', 1) when '/qc' then case split_part(text, ' ', 2) when 'today' then 'qc-status' when 'failures' then 'qc-failures' else 'qc-rerun' end
  when '/server' then 'server-status' when 'start' then 'auto_start' else 'open_sample' end as intent, case when split_part(text, ' ', 1) = 'start' then 7 end::int as n from v_messages""")
def p32(spark, sf):
    got = Q.classify_intent(F.col("text"))
    return V.v_messages(spark, sf).select("message_id", got["intent"].alias("intent"), got["count"].alias("n"))


REPORT = "qc_commands array<struct<command:string,returncode:int,payload:string>>"


@query("p33_dashboard_command_filter", "v_qc", "select sample_id, risk_score, defect_class from v_qc where command = 'triage'")
def p33(spark, sf):
    from foliant.operators.qc import command_rows

    # One report per sample, as landed: a JSON array of commands whose payloads are JSON themselves.
    payload = F.to_json(F.array(F.struct("sample_id", "risk_score", "defect_class")))
    report = F.to_json(F.struct(F.array(F.struct("command", F.lit(0).alias("returncode"), payload.alias("payload")), F.struct(F.lit("other").alias("command"), F.lit(1).alias("returncode"), F.lit("{}").alias("payload"))).alias("qc_commands")))
    reports = V.v_qc(spark, sf).select(F.from_json(report, REPORT).alias("r")).select("r.*")
    return command_rows(reports, "triage", "sample_id string, risk_score int, defect_class string")


@query("p34_status_of_attachment", "v_attachments", f"""
with k as (select item_id, file_name, row_number() over (partition by item_id order by {IS_APPENDIX}, pos) as rn from v_attachments where {EXTENSION} = '.hwpx'),
i as (select distinct item_id from v_attachments), s as (select i.item_id, case when k.file_name is null then 'missing' when i.item_id % 5 = 1 then 'html_error'
  when i.item_id % 5 = 2 then 'wrong_container' when i.item_id % 5 = 3 then 'missing' else 'ok' end as status from i left join k on i.item_id = k.item_id and k.rn = 1)
select item_id, status, case when status <> 'ok' then '# item ' || item_id || chr(10) || chr(10) || status || ' notice' || chr(10) || chr(10) || status || ' about' || chr(10) || chr(10) || 'd' || item_id end as placeholder from s""")
def p34(spark, sf):
    n = F.col("item_id") % 5
    head = F.when(n == 1, "\n <!DOCTYPE html><p>").when(n == 2, "%PDF-1.4").when(n == 3, "").otherwise("PK\x03\x04...")
    first = A.primary_attachment(F.col("attachments"), ".hwpx", APPENDIX)
    status = A.status_of_attachment(first["file_name"], A.payload_kind(head.cast("binary")))
    notices = {s: (f"{s} notice", f"{s} about") for s in ("missing", "html_error", "wrong_container")}
    title, detail = F.concat(F.lit("item "), F.col("item_id").cast("string")), F.concat(F.lit("d"), F.col("item_id").cast("string"))
    return _with_arrays(spark, sf).withColumn("status", status).select(
        "item_id", "status", A.placeholder_document(F.col("status"), title, notices, detail).alias("placeholder")
    )


@query("p35_result_view", "v_jobs", """
select job_id, coalesce(nullif(edited_markdown, ''), markdown) as primary_text, coalesce(nullif(edited_markdown, ''), nullif(markdown_text, ''), markdown) as text_variant,
  coalesce(nullif(edited_markdown, ''), markdown_html, markdown) as html_variant from v_jobs""")
def p35(spark, sf):
    names = ("edited_markdown", "markdown", "markdown_text", "markdown_html")
    return V.v_jobs(spark, sf).select("job_id", Q.result_view({n: F.col(n) for n in names}).alias("v")).select("job_id", "v.*")


@query("p36_search_filter", "v_items", "select news_item_id, day_file from v_items where contains(lower(title), 'the on') or contains(lower(department), 'the on') or contains(lower(department), 'src1')")
def p36(spark, sf):
    t, d = F.col("title"), F.col("department")
    return _items(spark, sf).where(T.search_filter(" The ON ", t, d) | T.search_filter("SRC1", d)).select("news_item_id", "day_file")


@query("p37_inspect_summary", "v_triage", """
select sample_id, case when risk_score < 2 then 'inspect=PASS findings=0' else 'inspect=FAIL findings=4' || case when finding_count = 0 then ' top=' || defect_class else
  ' top=' || defect_class || ',rule' || finding_count end end as summary from v_triage""")
def p37(spark, sf):
    def finding(category, rule, message):
        return F.struct(F.lit(category).alias("category") if category is None else category.alias("category"), rule.alias("assertion_id"), F.lit(message).alias("message"))

    blank = F.lit("")
    rule = F.when(F.col("finding_count") == 0, "").otherwise(F.concat(F.lit("rule"), F.col("finding_count").cast("string")))
    findings = F.array(
        finding(F.col("defect_class"), rule, "m1"), finding(blank, rule, ""), finding(blank, blank, " "), finding(F.lit("late"), rule, "m4")
    )
    return V.v_triage(spark, sf).select("sample_id", Q.inspect_summary(F.col("risk_score") < 2, findings).alias("summary"))


@query("p39_storage_title", "v_jobs", "select job_id, 'file' || regexp_extract(file_name, '[0-9]+') as title from v_jobs")
def p39(spark, sf):
    path = F.concat(F.lit("originals/"), "job_id", F.lit("-"), "file_name")
    return V.v_jobs(spark, sf).select("job_id", T.storage_title(path).alias("title"))


@query("s14_sniff_payload", (), """
select page_id, case page_id % 4 when 0 then 'html' when 1 then 'zip' when 2 then 'other' else 'empty' end as payload_kind from pages""")
def s14(spark, sf):
    n = F.col("page_id") % 4
    content = F.when(n == 0, F.col("html").cast("binary")).when(n == 1, F.lit(b"PK\x03\x04rest")).when(n == 2, F.lit(b"%PDF-1.7")).otherwise(F.lit(b""))
    return V.table(spark, sf, "pages").select("page_id", A.payload_kind(content).alias("payload_kind"))


@query("s15_content_hash", (), "select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents")
def s15(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", A.content_hash(F.col("text")).alias("text_sha256"))
