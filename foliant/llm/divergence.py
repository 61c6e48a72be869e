"""Source divergence audit over the iceberg of frequent terms.

A language keeps the terms that stand in at least ``min_docs`` of its documents. They are found by refining byte
prefixes level by level: the first level counts the distinct documents of each short prefix, and only prefixes at or
above the threshold are extended to the next length, for a prefix stands in at least as many documents as any term
that begins with it. A term no longer than the level's length is complete; its count is its own, and it is kept or
discarded there. The refinement ends when no open prefix is left. Lengths double, so long terms need few levels.

Each document is parsed once. A task's documents form blocks by language, of bounded size, with each different term once
and the documents' terms by number; that table is written and read by every level. A block is one packed value, which Spark hands on as
it is, and few lie in one row group, for a reader holds a row group at a time. A level counts inside the block (a
document adds one to each of its prefixes) and shuffles one row a prefix and block. Surviving prefixes reach the next level as a bitmap of fixed size (``BITS``) over their hashes, whatever
their number: a collision lets a prefix through that the next level's exact count discards, so results do not
depend on it. Occurrences of kept terms are then counted by group, the bitmap of kept terms first and an exact join
after. Pairs of sources are compared in blocks of terms and of sources; what a task holds is one block of each.

Arithmetic is in whole numbers throughout (decimals where a product may pass 64 bits). Null text, language and
source are ''. Every row is a document, repeated rows too. A document without terms still makes its group occur. A very
long text is a block of its own, a very long term takes more levels. Ties go by the item's UTF-8 bytes. An empty table gives an
empty result, a language that keeps no term gives pairs of value 0. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._shared import durable, new_path, require, slices, table

MIN_DOCS = 30
#: Bytes of the first level's prefixes; each next level's are twice as long.
FIRST_LEVEL = 4
#: Log of the bitmap's size: 2 MiB.
BITS = 24
#: Bits of one row of a bitmap aggregate (two to the fifteenth).
ROW_BITS = 32_768
#: Entries (terms of documents) and characters of text after which a block is closed, and entries of a task's open blocks.
BLOCK_TERMS, BLOCK_CHARS, OPEN_TERMS = 1_000_000, 32_000_000, 2_000_000
#: ``sources`` names each source once; ``block`` holds the parts of :meth:`_Block.row`.
BLOCKS = "lang string, sources array<string>, block binary"
#: A row group is closed at this size, however few its rows, and blocks are too large for a dictionary of values.
GROUPED = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "compression": "none"}
TOP = 50
#: Terms and sources of a block of comparisons.
TERM_BLOCK, SOURCE_BLOCK = 4096, 128
SCALE, SMOOTH = 1_000_000_000, 5

#: Bytes that make up terms: ASCII letters, lower-cased, and every byte of a non-ASCII character. All else separates.
TERM_BYTES = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(128)).lower() + bytes(range(128, 256))
#: Marks an open prefix; no term holds it.
OPEN = b"*"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split(b" ") if text else []


class _Numbers(dict):
    """Term -> its number, in order of coming."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class _Block:
    """Documents of one language: their different terms once, and each document's terms by number, with counts."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.names, self.sources, self.sizes, self.at, self.n, self.size, self.chars = lang, _Numbers(), _Numbers(), [], [], [], [], 0, 0

    def add(self, source: str, found: Counter, chars: int) -> None:
        self.chars += chars
        self.sources.append(self.names[source])
        self.sizes.append(len(found))
        self.at.append(np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found)))
        self.n.append(np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        self.size += len(found) + 1

    def row(self) -> pa.RecordBatch:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        whole = lambda parts, kind: pa.ListArray.from_arrays(pa.array([0, sum(map(len, parts))], pa.int32()), pa.array(np.concatenate(parts), kind))
        parts = pa.RecordBatch.from_arrays(
            [one(list(self.numbers), pa.binary()), one(self.sources, pa.int32()), one(self.sizes, pa.int32()), whole(self.at, pa.int32()), whole(self.n, pa.int64())],
            ["terms", "sources", "sizes", "at", "n"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(parts)
        return pa.RecordBatch.from_arrays([pa.array([self.lang], pa.string()), one(list(self.names), pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["lang", "sources", "block"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[str, _Block] = {}
    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = Counter(terms_of(text))
            found.pop(b"", None)
            if lang not in blocks:
                blocks[lang] = _Block(lang)
            blocks[lang].add(source, found, len(text))
            if blocks[lang].size >= BLOCK_TERMS or blocks[lang].chars >= BLOCK_CHARS:
                yield blocks.pop(lang).row()
        while sum(b.size for b in blocks.values()) > OPEN_TERMS:  # many languages
            yield blocks.pop(max(blocks, key=lambda x: blocks[x].size)).row()
    yield from (b.row() for b in blocks.values())


def parsed(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Blocks of documents of one language: lang, their sources, and packed the terms, and by document its source, how many terms it has, which and how often."""
    named = require(docs, lang_col, source_col, text_col).toDF("lang", "source", "text")
    return named.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in named.columns)).mapInArrow(_parse, BLOCKS)


def bitmap(df: DataFrame, *key: str) -> np.ndarray:
    """The bits at the hashes of ``key``. Its size is fixed, so it may pass the driver and go to every task."""
    bit = F.pmod(F.xxhash64(*key), F.lit(1 << BITS))
    rows = (
        df.select(F.shiftright(bit, 15).alias("row"), (bit % ROW_BITS).alias("at"))
        .groupBy("row")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for r in rows:
        out[r.row * (ROW_BITS // 8) :][: ROW_BITS // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _test(bits: np.ndarray, lang: str):
    """Whether the bit of (lang, term) is set, as ``bitmap`` hashes it."""
    seed, mask, view = xxhash.xxh64_intdigest(lang, 42), (1 << BITS) - 1, memoryview(bits)

    def has(term: bytes) -> bool:
        at = xxhash.xxh64_intdigest(term, seed) & mask
        return view[at >> 3] >> (at & 7) & 1 == 1

    return has


def stored_blocks(docs: DataFrame) -> DataFrame:
    """:func:`parsed`, written once and read back, a few blocks at a time."""
    path = new_path(docs.sparkSession)
    docs.write.options(**GROUPED).parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def _rows(batches: Iterator[pa.RecordBatch], *parts: str) -> Iterator[tuple]:
    """(lang, names of sources, terms, document of each entry, term of each entry, and the named ``parts``) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            names = batch.column("sources")[i].as_py() if "sources" in batch.schema.names else None
            with pa.ipc.open_stream(batch.column("block")[i].as_buffer()) as packed:
                row = packed.read_next_batch()
            sizes, at, *more = (row.column(c)[0].values.to_numpy() for c in ("sizes", "at", *parts))
            yield batch.column("lang")[i].as_py(), names, row.column("terms")[0].as_py(), np.repeat(np.arange(len(sizes)), sizes), at, *more


def _level(length: int, before: int, bits):
    """Partial (lang, item, documents) of a level; ``bits`` holds the prefixes that survived the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, terms, doc, at in _rows(batches):
            has = bits and _test(bits.value, lang)
            items: dict[bytes, int] = {}
            of = np.full(len(terms), -1, dtype=np.int64)
            for i, term in enumerate(terms):
                if len(term) > before and (not has or has(term[:before] + OPEN)):
                    of[i] = items.setdefault(term if len(term) <= length else term[:length] + OPEN, len(items))
            if not items:
                continue
            item = of[at]
            doc, item = doc[item >= 0], item[item >= 0]
            # A document's terms differ; what may repeat in it are open prefixes.
            may = np.fromiter((x.endswith(OPEN) for x in items), dtype=bool, count=len(items))[item]
            key = np.sort(doc[may] * len(items) + item[may])
            once = key[np.append(True, key[1:] != key[:-1])[: len(key)]] % len(items)
            docs = np.bincount(item[~may], minlength=len(items)) + np.bincount(once, minlength=len(items))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array(list(items), pa.binary()), pa.array(docs, pa.int64())], ["lang", "item", "docs"])

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, docs): each language's terms in at least ``min_docs`` documents. ``docs`` is a :func:`stored_blocks`."""
    spark = docs.sparkSession
    kept, before, length, bits = [], 0, FIRST_LEVEL, None
    while True:
        level = durable(
            docs.select("lang", "block")
            .mapInArrow(_level(length, before, bits), "lang string, item binary, docs long")
            .groupBy("lang", "item")
            .agg(F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs)
        )
        is_open = F.endswith(F.col("item"), F.lit(OPEN))
        kept.append(level.where(~is_open))
        still_open = level.where(is_open)
        if still_open.isEmpty():
            break
        bits = spark.sparkContext.broadcast(bitmap(still_open, "lang", "item"))
        before, length = length, 2 * length
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return durable(out.withColumnRenamed("item", "term"))


def _occurrences(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, terms, doc, at, of_doc, n in _rows(batches, "sources", "n"):
            keep = np.fromiter(map(_test(bits.value, lang), terms), dtype=bool, count=len(terms))
            kept = np.flatnonzero(keep)
            if not len(kept):
                continue
            mine = keep[at]
            key, total = _summed((np.cumsum(keep) - 1)[at[mine]] * len(names) + of_doc.astype(np.int64)[doc[mine]], n[mine], len(kept) * len(names))
            term, source = np.divmod(key, len(names))
            begin = pa.array(np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept), pa.string()), pa.array(terms, pa.binary()).take(pa.array(kept)),
                    pa.ListArray.from_arrays(begin, pa.array(names, pa.string()).take(pa.array(source))), pa.ListArray.from_arrays(begin, pa.array(total)),
                ],
                ["lang", "term", "sources", "n"],
            )

    return run


def _summed(key: np.ndarray, n: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum of n) of each different key, in order; by places where these are few, else by sorting."""
    if keys <= 4 * len(key):
        place = np.zeros(keys, dtype=np.int64)
        np.add.at(place, key, n)
        found = np.flatnonzero(place)
        return found, place[found]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of kept terms, where a group has any. A block sends on one row a term, with its sources."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(kept, "lang", "term"))
    counted = docs.mapInArrow(_occurrences(bits), "lang string, term binary, sources array<string>, n array<long>")
    each = counted.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.arrays_zip("sources", "n")).alias("e"))
    return each.groupBy("lang", F.col("e.sources").alias("source"), "term").agg(F.sum("e.n").alias("n"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), 0 where there are no terms."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    of = (total + SMOOTH * terms).cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.when(terms == 0, F.lit(0)).otherwise(F.lit(1) + F.call_function("div", over, F.when(of > 0, of).otherwise(F.lit(1).cast("decimal(20,0)")))).cast("long")


def groups_of(docs: DataFrame, counted: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, p0): every occurring group, its kept terms' occurrences, V, and p of an absent term."""
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    total = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    out = docs.select("lang", F.explode("sources").alias("source")).distinct().join(terms, "lang", "left").join(total, ["lang", "source"], "left")
    out = out.na.fill(0, ["terms", "total"])
    return out.withColumn("p0", share(F.lit(0), "total", "terms"))


def _compare(rows: pa.Table) -> pa.Table:
    """Sums of |p - p'| over a block's terms for each pair of its sources, and both orders of a pair.

    A row without a term gives a source's p of absent terms; others give p of a term that the source has.
    """
    lang, left, right = rows.column("lang")[0].as_py(), rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    marker = rows.filter(rows.column("term").is_null())
    present = rows.filter(rows.column("term").is_valid())
    sources, side = marker.column("source").to_pylist(), marker.column("side").to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    p0, size = marker.column("p").to_numpy(), marker.column("block_terms")[0].as_py()
    keys = present.column("term").combine_chunks().dictionary_encode()
    seen = len(keys.dictionary)
    p = np.repeat(p0[:, None], seen, axis=1)
    at = np.array([place[s] for s in present.column("source").to_pylist()], dtype=np.int64)
    p[at, keys.indices.to_numpy()] = present.column("p").to_numpy()
    first, second = np.flatnonzero(side == left), np.flatnonzero(side == right)
    out: tuple[list, list, list] = [], [], []
    for i in first.tolist():
        sums = np.abs(p[second] - p[i]).sum(axis=1) + (size - seen) * np.abs(p0[second] - p0[i])
        for j, value in zip(second.tolist(), sums.tolist()):
            if i != j:
                out[0].append(sources[i]), out[1].append(sources[j]), out[2].append(value)
                if left != right:
                    out[0].append(sources[j]), out[1].append(sources[i]), out[2].append(value)
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})


def pair_distances(counted: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed distance of every two sources of a language, both ways."""
    per_lang = groups.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("terms") / TERM_BLOCK)).cast("int").alias("term_blocks"),
        F.ceil(F.count(F.lit(1)) / SOURCE_BLOCK).cast("int").alias("source_blocks"),
    )
    block = lambda term: F.pmod(F.xxhash64(term), F.col("term_blocks")).cast("int").alias("block")
    sizes = kept.join(per_lang, "lang").groupBy("lang", block("term")).agg(F.count(F.lit(1)).alias("block_terms"))
    stats = groups.join(per_lang, "lang").withColumn("side", F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int"))
    known = stats.select("lang", "source", "total", "terms", "term_blocks", "source_blocks", "side")
    present = counted.join(known, ["lang", "source"]).select(
        "lang", "source", "side", "source_blocks", block("term"), "term", share("n", "total", "terms").alias("p"), F.lit(None).cast("long").alias("block_terms")
    )
    marker = (
        stats.select("lang", "source", "side", "source_blocks", "p0", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("block"))
        .join(sizes, ["lang", "block"], "left")
        .select("lang", "source", "side", "source_blocks", "block", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"), F.coalesce("block_terms", F.lit(0)).alias("block_terms"))
    )
    # A row goes to every pair of source blocks that its source takes part in; one where there are few sources.
    dealt = (
        present.unionByName(marker)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("other"))
        .withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
        .select("lang", "block", "left", "right", "side", "source", "term", "p", "block_terms")
    )
    sums = dealt.groupBy("lang", "block", "left", "right").applyInArrow(_compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def over_used(counted: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses above its language's rate, ``top`` of each group."""
    whole = counted.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("terms").alias("terms"))
    q = whole.join(totals, "lang").select("lang", "term", share("all", "lang_total", "terms").alias("q"))
    value = (F.col("p") - F.col("q")).alias("value")
    found = (
        counted.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
        .select("lang", "source", "term", share("n", "total", "terms").alias("p"))
        .join(q, ["lang", "term"])
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").cast("string").alias("item"), value)
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **columns) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources and the terms that mark each source."""
    read = stored_blocks(parsed(docs, **columns))
    kept = kept_terms(read, min_docs)
    counted = durable(occurrences(read, kept))
    groups = durable(groups_of(read, counted, kept))
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(counted, groups, kept).withColumn("rank", F.row_number().over(nearest))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int"))
    return part(pairs, "pair").unionByName(part(over_used(counted, groups, top), "term"))


def op13_prefix_iceberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
o as (select lang, source, rid, unnest(ts) as term from d),
k as (select lang, term from o group by all having count(distinct rid) >= {MIN_DOCS}),
g as (select distinct lang, source from d),
v as (select g.lang, count(k.term) as v from (select distinct lang from g) g left join k using (lang) group by g.lang),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by all),
cl as (select lang, term, sum(n) as n from c group by all),
gn as (select g.lang, g.source, v.v, coalesce(sum(c.n), 0) as total from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source group by all),
ln as (select lang, sum(total) as total, max(v) as v from gn group by lang),
gp as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (gn.total + {SMOOTH} * gn.v) as p
  from gn join k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
lp as (select cl.lang, cl.term, 1 + ({SCALE}::hugeint * (cl.n + {SMOOTH})) // (ln.total + {SMOOTH} * ln.v) as q from cl join ln using (lang)),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select gp.lang, gp.source, 'term' as part, gp.term as item, gp.p - lp.q as value from gp join lp using (lang, term) where gp.n > 0 and gp.p > lp.q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {TOP}"""
