"""Nesting, spans and kinds of tables, on hand-made pages."""

from foliant.operators import pages as PG


def lines(spark, html, **rules):
    got = PG.pages_to_markdown(spark.createDataFrame([(1, html)], "page_id long, html string"), PG.Rules(**rules)).first()
    return got.markdown.split("\n") if got else []


def test_lists_nest_and_text_behind_an_inner_list_goes_back(spark):
    html = "<ol><li>a<ul><li>b<ul><li>c</ul>d</ul>e<li><p>f</p><p>g</p></ol><p>h"
    assert lines(spark, html) == ["- a", "  - b", "    - c", "    d", "  e", "- f", "  g", "h"]


def test_spans_fill_the_grid(spark):
    html = """<table><tr><td rowspan=3>A<td colspan="2">B</td><td>C</tr><tr><td>d<td rowspan='2' colspan='2'>E</tr><tr><td>f</tr><tr><td>g</tr></table>"""
    assert lines(spark, html) == ["| A | B | B | C |", "| --- | --- | --- | --- |", "| A | d | E | E |", "| A | f | E | E |", "| g |  |  |  |"]


def test_spans_are_bounded_and_may_be_wrong(spark):
    got = lines(spark, "<table><tr><td colspan=99999999999>a<td rowspan=0>b<td colspan=x>c</table><table><tr><td>p<td>q<tr><td colspan=9999>r</table>")
    assert got[0].count("|") == PG.WIDEST + 3 and got[-1].count("r") == PG.WIDEST


def test_inner_tables_are_text_of_the_outer_cell(spark):
    assert lines(spark, "<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e<tr><td>f<td>g</table>") == ["| a b c d | e |", "| --- | --- |", "| f | g |"]


def test_kinds_of_tables(spark):
    assert lines(spark, "<table><tr><td>Notice</table><p>x", labels=("Notice",)) == ["x"]
    assert lines(spark, "<table><tr><td>Head<tr><td>- a<tr><td>--b</table>") == ["## Head", "- a", "- b"]
    assert lines(spark, "<table><tr><td>a<tr><td>b</table>") == ["| a |", "| --- |", "| b |"]
    assert lines(spark, "<table><tr><td>Annex 1<td>x<tr><td><td>y</table>", appendix=("Annex",)) == ["## Annex 1 x", "y"]
    assert lines(spark, "<table><tr><td><td></table>") == []
    assert lines(spark, "<table><tr><td>Who<td>a<td>b<td>c<td>d<td>e</table>", contacts=("Who",)) == ["## Who", "- Who: a / b c d / e"]


def test_paragraph_rules(spark):
    html = (
        "<p>Notice<p>At: noon<p>[ box ]<p>&lt; head &gt;<p>Annex 2<p style='margin-left:60pt'>- deep<p style='margin-left:24pt'>mid"
        "<p style='text-align:center;font-size:22pt'>big<p style='text-align:center; margin-left:30pt'>mid<p>short brief<p style='margin-left:30pt;text-indent:-10pt'>hang"
    )
    got = lines(spark, html, labels=("Notice",), bold=("At:",), appendix=("Annex",), dropped=("brief",))
    assert got == ["# Notice", "**At: noon**", "## [ box ]", "## head", "## Annex 2", "    - deep", "  mid", "## big", "mid", "  hang"]


def test_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "<p>\x01a\x02b"), (5, "<p>x"), (5, "<p>x"), (6, "</table></ul><li>y"), (None, "<h9>z<h2>w")], "page_id long, html string")
    got = sorted((str(r.page_id), r.markdown) for r in PG.pages_to_markdown(pages).collect())
    assert got == [("4", "a b"), ("5", "x"), ("5", "x"), ("6", "- y"), ("None", "## w")]
    assert lines(spark, "<p>" + "long " * 100_000)[0].startswith("long long")
