"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over
the host's number of pages; lines above ``ratio`` on at least ``min_pages`` pages are boilerplate
and are dropped wherever the host repeats them. Pages of one host with the same text count once,
in both numbers, so that a page which was stored many times does not make its own lines look like
a template. Lines are compared trimmed of white space; blank lines are never counted or dropped.

Counting is an aggregate with a map side over (host, line hash), and only hashes are shuffled. The
boilerplate lines of a host are few whatever its size: every counted page holds at most its own
lines, so fewer than (lines a page) / ratio lines can pass. They are joined to the pages by host
and dropped inside each page's own line array, so page texts are not regrouped.

Null texts stay null and contain no line, a null host is a host of its own, repeated rows each stay
as a row, a page whose lines are all dropped keeps its row with an empty text, and an empty table
gives an empty result. A very long text is one array of lines in one row; its lines count once each.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, table

RATIO = 0.1
MIN_PAGES = 3
#: A ratio well below that of boilerplate lines in the given tables (8.7 % to 13.2 %), for lines on enough pages to tell.
WIDE = (0.03, 10)


def _free(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _address(line: Column) -> Column:
    """128 bits of hash, so that different lines do not meet by chance."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", wide: tuple[float, int] | None = None
) -> DataFrame:
    """(host, lines): the addresses of each host's boilerplate lines, for hosts that have any.

    With ``wide``, a second ratio and least number of pages, lines above both are boilerplate as well.
    """
    pages = require(docs, host_col, text_col).select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    # The page's hash, not its text, tells equal pages; the lines of a page are counted once.
    lines = pages.select(
        "host",
        F.xxhash64("text").alias("page"),
        F.transform(F.array_distinct(F.transform(F.split("text", "\n"), _trimmed)), _address).alias("lines"),
    ).where(F.col("lines").isNotNull())
    blank = _address(F.lit(""))
    hosts = pages.where(F.col("text").isNotNull()).groupBy("host").agg(F.count_distinct(F.xxhash64("text")).alias("pages"))
    counted = (
        lines.select("host", "page", F.explode("lines").alias("line"))
        .where(F.col("line") != blank)
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= (min(min_pages, wide[1]) if wide else min_pages))
    )
    above = (F.col("n") >= min_pages) & (F.col("n") > F.col("pages") * F.lit(float(ratio)))
    if wide:
        above |= (F.col("n") >= wide[1]) & (F.col("n") > F.col("pages") * F.lit(float(wide[0])))
    h = hosts.select(F.col("host").alias("h_host"), "pages")
    return (
        counted.join(h, F.col("host").eqNullSafe(F.col("h_host")))
        .where(above)
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", wide: tuple[float, int] | None = None
) -> DataFrame:
    """``docs`` with the boilerplate lines of each row's host taken out of its text; all other columns stay."""
    host, lines = _free(docs, "its_host"), _free(docs, "its_lines")
    # Written first: Spark then knows how small it is, and need not regroup the texts to find out.
    found = durable(boilerplate_lines(docs, ratio, min_pages, host_col, text_col, wide)).select(F.col("host").alias(host), F.col("lines").alias(lines))
    joined = docs.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
    kept = F.filter(
        F.split(F.col(f"`{text_col}`"), "\n"), lambda line: ~F.array_contains(F.col(lines), _address(_trimmed(line)))
    )
    text = F.when(F.col(lines).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).drop(host, lines)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = docs.select("doc_id", "source", "text", F.size(F.split("text", "\n")).alias("before"))
    kept = drop_boilerplate(before)
    after = F.when(F.col("text").isNull() | (F.col("before") < 1), 0).otherwise(F.size(F.split("text", "\n")))
    # A text that lost everything splits into one empty line; md5 and length describe what is left.
    return kept.select(
        "doc_id",
        F.coalesce(F.col("before"), F.lit(0)).cast("long").alias("lines_before"),
        after.cast("long").alias("lines_after"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, source, text, string_split(text, chr(10)) as ls from documents),
p as (select source, count(distinct text) as pages from d where text is not null group by source),
l as (select distinct source, text, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))) as line from d),
c as (select source, line, count(*) as n from l where line <> '' group by source, line having count(*) >= {MIN_PAGES}),
b as (select c.source, c.line from c join p on c.source is not distinct from p.source where c.n > p.pages * {RATIO!r}::double),
g as (select source, list(line) as lines from b group by source),
k as (select d.doc_id, d.ls, case when g.lines is null then d.text else array_to_string(list_filter(d.ls, lambda x:
    not list_contains(g.lines, trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))), chr(10)) end as t
  from d left join g on d.source is not distinct from g.source)
select doc_id, coalesce(len(ls), 0)::bigint as lines_before,
  case when t is null then 0 else len(string_split(t, chr(10))) end::bigint as lines_after,
  coalesce(len(t), 0)::bigint as n_chars, md5(t) as text_md5 from k"""
