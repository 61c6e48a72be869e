import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import packing as P

DDL = "doc_id long, text string, piece int, bin string"


@pytest.fixture(scope="module")
def encode():
    return P.Encoder()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_tokenizers(text):
    e = test_ids_are_those_of_tokenizers.__dict__.setdefault("e", P.Encoder())
    assert e(text).tolist() == e.exact(text)


def test_special_token_text(encode):
    text = "a <|endoftext|> b"
    assert encode(text).tolist() == encode.exact(text)


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)]
    assert P.cut(2049) == [(0, 1), (1, 2048)]
    assert P.cut(4096) == [(0, 2048), (2048, 2048)]
    assert P.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_tight(sizes):
    b, offset, used = P.best_fit(np.array(sizes, dtype=np.int64), 64)
    assert used.sum() == sum(sizes) and (used <= 64).all()
    for k in range(len(used)):
        spans = sorted((o, o + s) for o, s, at in zip(offset, sizes, b) if at == k)
        assert [a for a, _ in spans] == [0, *(e for _, e in spans)][: len(spans)]
    assert len(used) <= 1 + 2 * sum(sizes) // 64


def check(rows, docs, encode):
    ids = {d: np.append(encode(t or ""), np.uint32(0)).astype("<u4") for d, t in docs.items()}
    bins = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        mine = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == d)
        assert [(s, n) for _, s, n in mine] == P.cut(len(x)) and [p for p, _, _ in mine] == list(range(len(mine)))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins)


def test_round_trip_over_many_partitions(spark, encode):
    rng = np.random.default_rng(0)
    docs = {i: " ".join(["word"] * int(n)) for i, n in enumerate(rng.integers(0, 1500, 300))}
    docs |= {1000: None, 1001: "", 1002: "x" * 60_000, 1003: "long " * 9000}
    df = spark.createDataFrame([(d, t, 7, "clash") for d, t in docs.items()], DDL).repartition(24)
    rows = P.pack_documents(df).collect()
    n = check(rows, docs, encode)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least * 1.03 + 1


def test_edges(spark, encode):
    df = spark.createDataFrame([(None, "a", 0, ""), (5, "b", 0, ""), (5, "b", 0, "")], DDL)
    rows = P.pack_documents(df).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert P.pack_documents(df.limit(0)).count() == 0
