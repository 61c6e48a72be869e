"""Secret scans over an incremental, content-addressed blob ledger.

Every version of a text is addressed by its SHA-256. The ledger holds one row for each
(blob, rule version) pair that has been scanned. A run hashes the versions it is given, keeps the
pairs that the ledger lacks, reads only those texts, and appends their findings; findings are then
joined back to every path (here: every row) that holds the blob.

Null texts count as empty. A repeated row, or a text that many rows share, is scanned once and
reported for each row. Rows with a null id are scanned and reported like any other. A very long text is
scanned whole, in one piece. An empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, slices, table

RULE_VERSION = 1

#: Fixed patterns of the three base kinds, in the order in which ties on a start are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = ("assign", "access", "hex")

#: Kinds that this scanner adds; each is a plain regular expression.
ADDED = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "url": r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@[A-Za-z0-9.-]+",
}
KINDS = (*BASE_KINDS, *ADDED)

LEDGER_SCHEMA = "blob string, rule_version int, findings array<struct<kind:string,start:int,end:int>>"


@cache
def _rules() -> list[tuple[str, re.Pattern, str]]:
    """(kind, pattern, a string every match holds or ""), for kinds whose patterns never scan a stretch twice.

    Greedy runs make ``[0-9a-f]{32,}`` and ``AKIA[A-Z0-9]{12,}`` the same as matching any run and
    dropping the short ones; an assignment must be matched first and dropped afterwards, for a
    short value still uses up its text.
    """
    return [
        ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), ""),
        ("access", re.compile(r"AKIA[A-Z0-9]{12,}"), "AKIA"),
        ("hex", re.compile(r"[0-9a-f]{32,}"), ""),
        ("pem", re.compile(ADDED["pem"]), "-----BEGIN "),
        ("forge", re.compile(ADDED["forge"]), "gh"),
        ("chat", re.compile(ADDED["chat"]), "xox"),
    ]


#: Kinds that begin with a run of letters which may be long and lead nowhere: what follows the run is looked for first. The run
#: before it, read backwards, ends where it may begin no sooner, and the first place in it that can start a match does.
_BY_MIDDLE = {
    "jwt": ("eyJ", re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"eyJ(?=.{8})", re.S)),
    "url": ("://", re.compile(r"://[^/\s:@]+:[^/\s:@]+@[A-Za-z0-9.-]+"), re.compile(r"[a-z0-9+.-]*"), re.compile(r"[a-z]")),
}


def _run_before(text: str, run: re.Pattern, at: int, least: int) -> str:
    """The run of a class's characters that ends before ``at`` and begins at ``least`` or later."""
    out: list[str] = []
    stretch = 32
    while at > least:
        piece = text[max(least, at - stretch) : at][::-1]
        n = run.match(piece).end()
        out.append(piece[:n])
        at, stretch = at - n, 2 * stretch
        if n < len(piece):
            break
    return "".join(out)[::-1]


def _by_middle(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one after another; each stretch of text is read a bounded number of times."""
    needle, middle, run, start = _BY_MIDDLE[kind]
    end = 0
    if needle in text:
        for m in middle.finditer(text) if kind == "url" else _overlapping(middle, text):
            if m.start() >= end:
                before = _run_before(text, run, m.start(), end)
                first = start.search(before)
                if first:
                    yield m.start() - len(before) + first.start(), m.end()
                    end = m.end()


def _overlapping(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches from every start: that of one token's middle may lie in another's end."""
    at = text.find(".eyJ")
    while at >= 0:
        m = pattern.match(text, at)
        if m:
            yield m
        at = text.find(".eyJ", at + 1)


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, by start and then kind."""
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    found = []
    for kind, pattern, needle in _rules():
        if needle and needle not in text:
            continue
        for m in pattern.finditer(text):
            if kind != "assign" or len(m[2]) >= 8:
                found.append((kind, m.start(), m.end()))
    for kind in _BY_MIDDLE:
        found += [(kind, s, e) for s, e in _by_middle(text, kind)]
    return sorted(found, key=lambda f: (f[1], order[f[0]]))


#: Addresses that a task keeps of the blobs it has scanned.
REMEMBERED = 200_000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each blob that this task meets for the first time."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    seen: set[str] = set()
    for batch in slices(batches):
        blobs, rows = [], []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist()):
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text)])
        if len(seen) > REMEMBERED:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(rows, spans)], ["blob", "findings"])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def versions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and the address of its text."""
    return require(docs, id_col, text_col).select(
        F.col(id_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob")
    )


def scan_unseen(
    docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks.

    Where the ledger has no blob of this rule version all are unseen: texts are scanned where they lie,
    each once in a task, and only findings are shuffled. Otherwise one row of each unseen blob keeps its
    text past a join by id, so a text that a third of all rows share is moved once; where few blobs are
    unseen, Spark broadcasts that small side and no text moves at all.
    """
    seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
    texts = require(docs, id_col, text_col).select(
        F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    if seen.isEmpty():
        picked = texts.select(F.sha2("text", 256).alias("blob"), "text")
    else:
        unseen = (
            versions_of(docs, id_col, text_col)
            .groupBy("blob")
            .agg(F.min("path").alias("keeper"))
            .join(seen, "blob", "left_anti")
            .select(F.col("blob").alias("unseen_blob"), "keeper")
        )
        # Spark makes the filter a part of the join's key, so rows that share an id, or a text, do not meet in one task.
        picked = (
            texts.join(unseen, texts["path"].eqNullSafe(unseen["keeper"]), "inner")
            .where(F.sha2("text", 256) == F.col("unseen_blob"))
            .select(F.col("unseen_blob").alias("blob"), "text")
        )
    return (
        picked.mapInArrow(_scan, "blob string, findings array<struct<kind:string,start:int,end:int>>")
        .dropDuplicates(["blob"])
        .select("blob", F.lit(rule_version).alias("rule_version"), "findings")
    )


def findings_by_path(
    docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each row's id, blob and findings. Only blobs that have findings take part in the join."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    return versions_of(docs, id_col, text_col).join(hits, "blob", "left").select("path", "blob", "findings")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(findings by row, the ledger to keep for the next run)."""
    ledger = ledger if ledger is not None else empty_ledger(docs.sparkSession)
    grown = ledger.unionByName(durable(scan_unseen(docs, ledger, **options)))
    return findings_by_path(docs, grown, **options), grown


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce("findings", F.expr("array()").cast("array<struct<kind:string,start:int,end:int>>"))
    base = F.filter("f", lambda x: x["kind"].isin(*BASE_KINDS))
    joined = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("f", lambda x: x["kind"] == kind)).cast("long")
    return found.withColumn("f", spans).select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("f")).alias("spans"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Places of all matches: the gaps between matches and the matches, added up."""
    p = pattern.replace("'", "''")
    return f"""
    select doc_id, '{kind}' as kind, {rank} as rank, s as start, s + len(m) as stop from (
      select doc_id, ms[i] as m,
        list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: len(g))), 0) as s
      from (select doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) as i from (
        select doc_id, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as ms
        from d where regexp_matches(t, '{p}')))
    ) where {keep}"""


def _oracle() -> str:
    value = "len(regexp_extract(m, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"
    parts = [
        _sql_spans("assign", 0, f"(?i){ASSIGN}", value),
        _sql_spans("access", 1, ACCESS, "len(m) >= 16"),
        _sql_spans("hex", 2, "[0-9a-f]{32,}", "true"),
        *(_sql_spans(k, 3 + i, p, "true") for i, (k, p) in enumerate(ADDED.items())),
    ]
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(parts)}),
g as (select doc_id,
  count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3), '') as b,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on g.doc_id is not distinct from d.doc_id"""


ORACLE = _oracle()
