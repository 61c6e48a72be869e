import numpy as np

from foliant.llm import ann as A

DDL = "vec_id long, embedding array<double>, query_id int, rank int"


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(axis=1)
        ok = ids != ids[i]
        order = np.lexsort((ids[ok], -s[ok]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[ok][order], s[ok][order])]
    return out


def rows(ids, x):
    return [(int(i), [float(v) for v in r], 0, 0) for i, r in zip(ids, x)]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact_with_copies_and_any_length(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, size=(900, 1))
    x[300:420] = x[20]  # a vector that many rows share
    ids = np.arange(900)
    df = spark.createDataFrame(rows(ids, x), DDL)
    assert found(A.nearest(df, df.where("vec_id % 20 = 0"))) == brute(ids, x, 20)


def test_tree_finds_what_a_scan_finds_with_small_leaves():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 4)) + c for c in (0, 8, -8)])
    ids, q = np.arange(len(x)), np.arange(0, len(x), 20)
    old, A.LEAF = A.LEAF, 16
    try:
        rows_, near, score = A.Shard(ids, x).search(q, x[q], 20)
    finally:
        A.LEAF = old
    want = brute(ids, x, 20)
    for i, own in enumerate(q):
        best = sorted((-s, v) for r, v, s in zip(rows_, near, score) if r == i)
        assert [b for _, b in best] == [b for b, _ in want[int(own)]]


def test_a_larger_factor_skips_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    tree = A.VantageTree(x, 32)
    q = rng.normal(size=(50, 3))
    seen = {}
    for factor in (1.0, 2.0, 8.0):
        best = np.full(50, np.inf)
        count = [0]

        def visit(r, p):
            d = np.sqrt(((q[r][:, None] - x[p][None]) ** 2).sum(-1)).min(axis=1)
            best[r] = np.minimum(best[r], d)
            count[0] += len(r) * len(p)

        tree.search(q, visit, lambda r: best[r], factor)
        seen[factor] = (count[0], best.copy())
    exact = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)).min(axis=1)
    assert np.allclose(seen[1.0][1], exact)
    assert seen[1.0][0] > seen[2.0][0] > seen[8.0][0]
    assert seen[1.0][0] < 50 * 2000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (40, None), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in data], DDL)
    got = found(A.nearest(df, df.where("vec_id % 20 = 0")))
    assert got == {0: [(20, 1.0), (7, 0.5), (7, 0.5)], 20: [(0, 1.0), (7, 0.5), (7, 0.5)]}
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    assert A.nearest(df, df.limit(0)).count() == 0


def test_many_shards_in_rounds_find_what_a_scan_finds(spark, monkeypatch):
    """Bounds that are handed on lose nothing, ties and copies included, and every tree is built once."""
    monkeypatch.setattr(A, "SHARD_ROWS", 40)
    monkeypatch.setattr(A, "GROWTH", 3)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 5)), 1)
    x[100:180] = x[40]
    ids = np.arange(700)
    df = spark.createDataFrame(rows(ids, x), DDL)
    got, want = found(A.nearest(df, df.where("vec_id % 20 = 0"), 7)), brute(ids, x, 7)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}


def test_an_id_that_many_rows_share_fills_no_shard(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_ROWS", 50)
    df = spark.createDataFrame([(7, [float(i), 1.0], 0, 0) for i in range(400)] + [(20, [1.0, 0.0], 0, 0)] * 2, DDL)
    got = A.nearest(df, df.where("vec_id = 20"), 3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted([(1, 7, 399.0), (2, 7, 398.0), (3, 7, 397.0)] * 2)


def test_queries_stream_past_a_shard(monkeypatch):
    """More queries than a batch takes, over many batches of rows."""
    import pyarrow as pa

    monkeypatch.setattr(A, "QUERY_ROWS", 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    ids = np.arange(60)
    row = [(0, i, list(x[i]), None, None) for i in range(60)] + [(0, i, list(x[i]), i, None) for i in range(0, 60, 2)] + [(1, 5, list(x[5]), 5, None)]
    cols = list(zip(*row))
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "id", "v", "q", "least"])
    out = [r for b in A._search(4, 1.0)(batch.slice(i, 7) for i in range(0, batch.num_rows, 7)) for r in b.to_pylist()]
    for i in range(0, 60, 2):
        s = x @ x[i]
        want = [int(j) for j in np.lexsort((ids, -s)) if j != i][:4]
        assert sorted(r["vec_id"] for r in out if r["q"] == i) == sorted(want)
