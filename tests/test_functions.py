import pytest
from pyspark.sql import functions as F

from foliant.functions import attachments as A
from foliant.functions import dates as D
from foliant.functions import markdown as M
from foliant.functions import messages as Q
from foliant.functions import scores as S
from foliant.functions import titles as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_nulls_are_empty(spark):
    null = F.lit(None).cast("string")
    for f in (T.normalize_title, T.title_key, T.storage_key, T.compact_key, T.clean_title, T.shorten, A.attachment_extension, Q.mask_spec):
        assert value(spark, f(null)) == ""
    assert value(spark, T.safe_filename(null)) == "document"
    assert value(spark, T.title_tokens(null)) == []
    assert value(spark, A.is_appendix(null)) is False


def test_title_keys(spark):
    assert value(spark, T.title_key(F.lit(" AI_x  (Y)!"))) == "인공지능 x (y)"
    assert value(spark, T.storage_key(F.lit("Doc_1.hwpx:Zone.Identifier"))) == "doc 1hwpx"
    assert value(spark, T.title_tokens(F.lit("보도자료 big big a"))) == ["big", "보도자료bigbiga"]


@pytest.mark.parametrize("name, want", [("붙임1.hwpx", True), ("240105_별첨 a.hwpx", True), ("[첨부] a.pdf", True), ("붙임표.hwpx", False), ("본문.hwpx", False)])
def test_appendix(spark, name, want):
    assert value(spark, A.is_appendix(F.lit(name))) is want


def test_primary_prefers_what_is_no_appendix(spark):
    rows = [("붙임 a.hwpx", "1"), ("b.pdf", "2"), ("c.HWPX", "3")]
    df = spark.createDataFrame([(rows,), ([("붙임 a.hwpx", "1")],), ([],)], "a array<struct<file_name:string,file_url:string>>")
    got = [r[0] and r[0].file_url for r in df.select(A.primary_attachment(F.col("a"), ".hwpx")).collect()]
    assert got == ["3", "1", None]


def test_candidate_dates(spark):
    dates = lambda n: [str(d) for d in value(spark, D.candidate_dates(F.lit(n)))]
    assert dates("a/240105 doc.hwpx") == ["2024-01-05"]
    assert dates("x 1-5.hwpx") == ["2026-01-05", "2025-01-05"]
    assert dates("(0105).hwpx") == ["2026-01-05", "2025-01-05"]
    assert dates("991399 02-30.hwpx") == []


def test_approve_dates(spark):
    at = lambda t, v: str(value(spark, D.parse_approve_ts(F.lit(t), v)))
    assert at("01/05/2024 10:11:12", "strict") == "2024-01-05 10:11:12"
    assert at("2024-01-05 10:11:12", "strict") == "None"
    assert at("2024-01-05 10:11:12", "both") == "2024-01-05 10:11:12"
    assert at("2024-01-05 10:11:12", "prefix") == "2024-01-05 00:00:00"


def test_inject_department(spark):
    put = lambda t, d="D": value(spark, M.inject_department(F.lit(t), F.lit(d)))
    assert put("\n\n보도자료\nx") == "\n\nD 보도자료 /\nx"
    assert put("a\n" * 12 + "보도자료") == "a\n" * 12 + "보도자료"
    assert put("\n" * 20 + "보도자료") == "\n" * 20 + "D 보도자료 /"
    assert put("보도자료", "") == "보도자료"


def test_structure_of_edges(spark):
    lines = lambda t: value(spark, M.markdown_structure(F.lit(t))["lines"])
    assert [lines(t) for t in ("", "a", "a\n", "a\n\n")] == [0, 1, 1, 2]


def test_unsafe_html(spark):
    html = '<p onclick="x()">a</p><SCRIPT>b</SCRIPT><iframe src=x></iframe><a href="javascript:alert(1)">c</a>'
    assert value(spark, M.strip_unsafe_html(F.lit(html))) == '<p >a</p><a href="#alert(1)">c</a>'


def test_scores(spark):
    n = F.lit(None).cast("double")
    assert value(spark, S.overall_score(n, n, n)) is None
    assert value(spark, S.overall_score(F.lit(0.5), n, F.lit(0.7))) == pytest.approx(0.6)
    assert value(spark, S.metric_commentary(n, n, n)) == ["order_unstable", "table_not_scored", "heading_lost"]


def test_versions(spark):
    parts = lambda v: value(spark, Q.version_parts(F.lit(v)))
    assert [parts(v) for v in ("1.2.3", "1.2-rc1", "x", "", "1.10")] == [[1, 2, 3], [1, 2], [], [], [1, 10]]


def test_verdict_defaults(spark):
    for text in (None, "", "[]", "{", '{"decision": 3}'):
        v = value(spark, Q.parse_verdict(F.lit(text).cast("string")))
        assert (v.decision, v.confidence, v.blocking_findings) == ("retry", "medium", [])


def test_intent_counts_are_clamped(spark):
    got = lambda t: tuple(value(spark, Q.classify_intent(F.lit(t))))
    assert got("start qc recent 900") == ("auto_start", 50)
    assert got("start qc") == ("auto_start", 10)
    assert got("/qc today") == ("qc-status", None)
    assert got("hello") == (None, None)


def test_inspect_summary_cuts_before_it_filters(spark):
    f = [("", "", ""), ("a", "", ""), ("", "b", ""), ("c", "", "")]
    df = spark.createDataFrame([(f,)], "f array<struct<category:string,assertion_id:string,message:string>>")
    assert df.select(Q.inspect_summary(F.lit(False), F.col("f"))).first()[0] == "inspect=FAIL findings=4 top=a,b"
