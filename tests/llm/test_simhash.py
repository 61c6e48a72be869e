import random

import numpy as np
import xxhash

from foliant.llm import simhash as S

DDL = "doc_id long, text string, fp long, component_id long"


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return {(d, f"{p:016x}", min(groups[find(i)])) for i, (d, p) in enumerate(prints)}


def test_fingerprint_of_edges():
    for t in (None, "", "  \n", "a", "A b", "É é x y z w", "a b c d", "x\x1cy z " * 9, "w " * 70_000):
        assert S.fingerprint(t) == plain_print(t)


def test_golay_keys_cover_two_errors():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 4000)
    others = words ^ (1 << rng.integers(0, 23, 4000)) ^ (1 << rng.integers(0, 23, 4000))
    a, b = S.golay_keys(words), S.golay_keys(others)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))
    assert ((a >= 0).sum(axis=1) <= 6).all()
    codewords, _, _ = S._codewords()
    assert len(set(codewords)) == 4096 and min(int(c).bit_count() for c in codewords if c) == 7


def test_any_four_errors_share_a_key():
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64).view(np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    keys = [{}, {}]
    for side, f in enumerate((fp, other)):
        for r, k in zip(*S.candidate_keys(f)):
            keys[side].setdefault(int(r), set()).add(int(k))
    assert all(keys[0][i] & keys[1][i] for i in range(len(fp)))


def test_every_split_of_four_errors_shares_a_key():
    rng = np.random.default_rng(2)
    segments = (range(41, 64), range(18, 41), range(18))
    for split in [(x, y, z) for x in range(5) for y in range(5 - x) for z in range(5 - x - y)]:
        fp = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64).view(np.uint64)
        other = fp.copy()
        for i in range(len(fp)):
            for errors, bits in zip(split, segments):
                for b in rng.choice(bits, errors, replace=False):
                    other[i] ^= np.uint64(1) << np.uint64(b)
        keys = [{}, {}]
        for side, f in enumerate((fp, other)):
            for r, k in zip(*S.candidate_keys(f)):
                keys[side].setdefault(int(r), set()).add(int(k))
        assert all(keys[0][i] & keys[1][i] for i in range(len(fp))), split


def test_a_long_run_of_one_key_is_sent_off_in_blocks(monkeypatch):
    """A run over many batches never has more than a block in memory, and its rows all arrive."""
    import pyarrow as pa

    monkeypatch.setattr(S, "BLOCK", 32)
    held = []
    add = S._Run.add

    def watched(self, fp, rep):
        yield from add(self, fp, rep)
        held.append(len(self.fp))

    monkeypatch.setattr(S._Run, "add", watched)
    n = [3, 500, 1, 32, 33, 7]
    key = np.repeat(np.arange(len(n)), n)
    fp = np.arange(len(key), dtype=np.int64) << 8
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(np.arange(len(key)))], ["key", "fp", "rep"])
    out = [r for b in S._sweep(batch.slice(i, 50) for i in range(0, len(key), 50)) for r in b.to_pylist() if r["key"] is not None]
    assert max(held) <= 32
    sent = {}
    for r in out:
        sent.setdefault(r["key"], []).append((r["block"], r["a"]))
    assert set(sent) == {1, 4}
    assert sorted(a for _, a in sent[1]) == list(range(3, 503)) and {b for b, _ in sent[1]} == set(range(16))
    assert max(sum(b == x for b, _ in sent[1]) for x in range(16)) == 32


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        words = rng.choice(base[: 5 if i % 3 else len(base)]).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 7 % n, " ".join(words)))
    return rows


def components_of(spark, rows):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], DDL)
    return {(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.near_duplicates(df).collect()}


def test_components_against_all_pairs(spark):
    rows = corpus(400, 5) + [(1000, None), (1001, ""), (1002, " \n")]
    assert components_of(spark, rows) == plain_components(rows)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    # Fingerprints near each other by construction: one chain through a ball, in blocks of 16.
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(4)
    fp = {int(x) for x in rng.integers(0, 2**62, 40)}
    for _ in range(150):
        fp.add(next(iter(fp)) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fps = sorted(fp)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")

    def swept(module):
        got = {r.node: r.root for r in module.components(module.link_edges(df)).collect()}
        return [got.get(i, i) for i in range(len(fps))]

    want = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 4:
                    want[i] = want[j] = min(want[i], want[j])
    assert swept(S) == want


def test_block_pairs_find_what_one_group_finds():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    fp = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64))
    fp = np.unique(fp)
    rep = np.arange(len(fp))
    rows = [(0, min(x, y), max(x, y), i // 30, fp[i], i) for i in range(len(fp)) for x in [i // 30] for y in range(-(-len(fp) // 30))]
    rows.sort(key=lambda r: r[:3])
    cols = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(np.array(cols[4], dtype=np.uint64).view(np.int64)), pa.array(cols[5])],
        ["key", "i", "j", "block", "fp", "a"],
    )
    batches = [batch.slice(k, 37) for k in range(0, batch.num_rows, 37)]
    edges = [(a, b) for out in S._sweep_blocks(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]

    def parts(pairs):
        root = list(rep)
        for _ in rep:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    s, t = S._forest(fp)
    assert parts(edges) == parts(list(zip(s, t)))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {501: 500}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", 0, 0), (3, "a b", 0, 0), (3, "a b", 0, 0), (None, "zz", 0, 0), (9, None, 0, 0)], DDL)
    got = sorted((str(r.doc_id), r.component_id) for r in S.near_duplicates(df).collect() if r.component_id is not None)
    assert got == [("3", 3), ("3", 3), ("9", 9), ("None", 3)]
    assert S.near_duplicates(df.limit(0)).count() == 0
