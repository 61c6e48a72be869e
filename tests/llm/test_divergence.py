import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from foliant.llm import divergence as D

DDL = "text string, lang string, source string, item string, terms string"  # the last two clash with the operator's own
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, min_docs=30, top=50):
    """Dense tables of every group and kept term."""
    seen, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(ASCII_LOWER))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), n in seen.items() if la == lang and n >= min_docs]
        sources = sorted(s for la, s in groups if la == lang)
        n = {s: [counts[lang, s][t] for t in kept] for s in sources}
        n[None] = [sum(n[s][i] for s in sources) for i in range(len(kept))]
        p = {s: [1 + 10**9 * (c + 5) // (sum(x) + 5 * len(kept)) for c in x] for s, x in n.items()}
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [(a - b, t) for a, b, c, t in zip(p[s], p[None], n[s], kept) if c and a > b]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out.update((lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked))
    return out


def docs_of(n, seed=2):
    rng = random.Random(seed)
    words = ["The", "the", "ab", "abc", "abcd", "abcde", "abcdefghij" * 4, "été", "Été", "日本", "ß", "a", "ABCD"] + [f"w{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 9)}" for i in range(120)]
    sources = ["a"] * 6 + ["b", "c", None, "", "é"]
    return [
        (rng.choice([" ", "\n", "-", "7"]).join(rng.choices(words, k=rng.randint(0, 40))) if rng.random() > 0.05 else None, rng.choice(["en", "en", "de", None]), rng.choice(sources)) for _ in range(n)
    ]


def rows(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], DDL)


def test_against_a_plain_version(spark):
    docs = docs_of(900)
    got = D.divergence(frame(spark, docs).repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got.count() == len(rows(got)) and rows(got) == plain(docs)


def test_bounds_change_nothing(spark, monkeypatch):
    docs = docs_of(400, 3)
    want = plain(docs, 10, 7)
    # blocks of 8 terms and 2 sources, and of 50 entries.
    for name, value in (("TERM_BLOCK", 8), ("SOURCE_BLOCK", 2), ("BLOCK_TERMS", 50), ("FIRST_LEVEL", 2)):
        monkeypatch.setattr(D, name, value)
    assert rows(D.divergence(frame(spark, docs), min_docs=10, top=7)) == want


def test_a_full_bitmap_lets_everything_through(spark, monkeypatch):
    docs = docs_of(300, 4)
    real = D.bitmap
    monkeypatch.setattr(D, "bitmap", lambda df, *key: real(df, *key) | 255)
    assert rows(D.divergence(frame(spark, docs), min_docs=8)) == plain(docs, 8)


def test_levels_keep_what_the_threshold_keeps(spark):
    docs = [("abcdefgh" + "xy"[i % 2] * 30, "en", "a") for i in range(20)] + [("abcd", "en", "b")] * 5 + [("abcde", "en", "b")] * 4
    kept = {(r.term.decode(), r.docs) for r in D.kept_terms(D.durable(D.parsed(frame(spark, docs))), 5).collect()}
    assert kept == {("abcdefgh" + "x" * 30, 10), ("abcdefgh" + "y" * 30, 10), ("abcd", 5)}


def test_edges(spark):
    assert D.divergence(frame(spark, [])).count() == 0
    few = [(None, None, None), ("", None, "a"), ("12 34", None, "b"), ("word " * 3, "en", None)]
    assert rows(D.divergence(frame(spark, few))) == plain(few)
    assert len(plain(few)) == 6  # pairs of value 0 alone
    long = [("x" * 200_000 + " y " * 50_000, "en", s) for s in "ab"] * 2
    assert rows(D.divergence(frame(spark, long), min_docs=4)) == plain(long, 4)


@pytest.mark.parametrize("min_docs", [D.MIN_DOCS])
def test_rows_match_sql(spark, sf_dir, min_docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = set(con.sql(D.ORACLE).fetchall())
    got = rows(D.op13_prefix_iceberg(spark, sf_dir))
    assert got == want and len(want) > 100


def test_readers_hold_few_blocks_at_a_time(spark, monkeypatch):
    """A block is one packed value, and a row group ends at its size, not after a hundred blocks: a reader holds a row group at a time."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(D, "BLOCK_TERMS", 2000)
    monkeypatch.setattr(D, "GROUPED", D.GROUPED | {"parquet.block.size": 1 << 16})
    rng = random.Random(6)
    docs = [(" ".join("".join(rng.choices("abcdefgh", k=rng.choice((5, 9)))) for _ in range(500)), "en", rng.choice("ab")) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"lang": [d[1] for d in docs], "source": [d[2] for d in docs], "text": [d[0] for d in docs]})
    blocks = [b.to_pylist()[0] for b in D._parse(iter([batch]))]  # a worker of its own would not see the small bounds
    read = D.stored_blocks(spark.createDataFrame([(b["lang"], b["sources"], b["block"]) for b in blocks], D.BLOCKS).coalesce(1))
    assert all(f.dataType.simpleString() != "array<binary>" for f in read.schema)
    groups = [g for f in read.inputFiles() for meta in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(meta.row_group, range(meta.num_row_groups))]
    assert sum(g.num_rows for g in groups) >= 40
    assert max(g.total_byte_size for g in groups) < 5 * (1 << 16)
    got = D.kept_terms(read, 2)
    seen = Counter(t for d in docs for t in set(d[0].split()))
    assert {(r.term.decode(), r.docs) for r in got.collect()} == {(t, n) for t, n in seen.items() if n >= 2}
    one = {(r.source, r.term.decode(), r.n) for r in D.occurrences(read, got).collect()}
    many = Counter((d[2], t) for d in docs for t in d[0].split() if seen[t] >= 2)
    assert one == {(*k, n) for k, n in many.items()}


def test_a_task_holds_a_bounded_number_of_entries(monkeypatch):
    """Blocks of many languages are closed, the largest first, and long texts by their characters."""
    import pyarrow as pa

    for name, value in (("BLOCK_TERMS", 400), ("OPEN_TERMS", 1000), ("BLOCK_CHARS", 30_000)):
        monkeypatch.setattr(D, name, value)
    texts = ["same " * 7000] * 2 + [" ".join(f"{chr(97 + i % 26)}{chr(97 + k)}" for k in range(20)) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"lang": ["long"] * 2 + [f"l{i % 40}" for i in range(1500)], "source": ["s"] * 1502, "text": texts})
    found = Counter(b.column("lang")[0].as_py() for b in D._parse(iter([batch])))
    assert len(found) == 41 and found["long"] == 2 and sum(found.values()) > 100
