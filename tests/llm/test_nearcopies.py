import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from foliant.llm import nearcopies as N

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))] for _ in range(40)]
    rows = []
    for i in range(300):
        words = list(base[i % 40 if i % 3 else 0])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A  b")]


def test_against_all_pairs_and_wider_than_four_bits(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DDL)
    want = plain(rows)
    assert sorted((r.doc_id, r.component_id) for r in N.near_copies(df).collect()) == want
    assert sorted(r.doc_id for r in C.near_dedup(spark, df, "").collect()) == sorted({c for _, c in want})
    assert N.near_copies(df.limit(0)).count() == 0


def near_sets(n, seed):
    """Sets around one of 60 numbers, from copies to ones that share little with any other."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**40, 60)
    out = []
    for i in range(n):
        x = base.copy()
        k = rng.integers(0, 14)
        x[rng.choice(60, k, replace=False)] = rng.integers(0, 2**40, k)
        out.append(np.unique(x))
    return out


def parts(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def similar(sets, split=None):
    n = len(sets)
    return [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and (split is None or (i < split) != (j < split))]


def test_forest_joins_what_is_similar(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 64)
    for seed in range(4):
        sets = near_sets(50, seed)
        for split in (None, 20):
            got = N.forest(sets, 0.8, split)
            assert parts(50, got) == parts(50, similar(sets, split)) and len(got) < 50


def test_large_groups_go_through_blocks(monkeypatch):
    """A group larger than a block, over many batches: its blocks in pairs join what the whole group joins."""
    monkeypatch.setattr(N, "BLOCK", 16)
    sets = near_sets(90, 9)
    keys = [0] * 3 + [7] * 80 + [9] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(90)), pa.array(sets, pa.list_(pa.int64()))], ["key", "rep", "hashes"])
    out = [r for b in N._sweep(0.8)(batch.slice(i, 11) for i in range(0, 90, 11)) for r in b.to_pylist()]
    blocks = [r for r in out if r["key"] is not None]
    assert {r["key"] for r in blocks} == {7} and sorted(r["a"] for r in blocks) == list(range(3, 83))
    last = max(r["block"] for r in blocks)
    rows = sorted(((7, min(r["block"], o), max(r["block"], o), r["block"], r["a"], r["hashes"]) for r in blocks for o in range(last + 1)), key=lambda r: r[:3])
    cols = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    pairs = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "i", "j", "block", "rep", "hashes"])
    out += [r for b in N._sweep_blocks(0.8)(pairs.slice(i, 13) for i in range(0, pairs.num_rows, 13)) for r in b.to_pylist()]
    got = [(r["a"], r["b"]) for r in out if r["key"] is None]
    want = [(i, j) for i, j in similar(sets) if keys[i] == keys[j]]
    assert parts(90, got) == parts(90, want)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"v{rng.randrange(9000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DDL)
    assert sorted((r.doc_id, r.component_id) for r in N.near_copies(df).collect()) == plain(rows)


def test_the_pipeline_links_what_the_golay_operator_links(spark, sf_dir):
    """Two texts within 4 bits that share few distinct shingles are one group, and copies at 0.8 beyond 4 bits still are."""
    often = "a passage of seven words said again " * 200
    words = [f"w{i}" for i in range(120)]
    texts = [often + " ".join(f"x{i}" for i in range(30)), often + " ".join(f"y{i}" for i in range(30)), " ".join(words), " ".join([*words[:60], "other", *words[61:]]), "quite alone here"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DDL)
    found = lambda f: {r.doc_id: r.component_id for r in f(docs).select("doc_id", "component_id").collect()}
    assert found(N.golay_duplicates)[1] == 0 and found(N.near_copies)[1] == 1
    assert found(N.golay_duplicates)[3] == 3 and found(N.near_copies)[3] == 2
    assert found(C.near_duplicates) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, sf_dir).collect()) == [0, 2, 4]
