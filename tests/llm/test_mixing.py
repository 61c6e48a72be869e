import hashlib
import random

from foliant.llm import mixing as M

DDL = "doc_id long, text string, source string, target string"


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Rounds of sharing: what is above a cap is shared anew among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def brute(rows, targets, sizes):
    entries = []
    for s, t in targets.items():
        docs = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, n) for d, n, x in rows if x == s)
        upto = 0
        for h, d, n in docs:
            upto += n
            if t > 0:
                entries += [((e * sizes[s] + upto) / t, e, h, d, n) for e in range(1 + min(2, int(t // sizes[s])))]
    run, taken = 0, {d: 0 for d, _, _ in rows}
    for _, _, _, d, n in sorted(entries):
        run += n
        if run <= int(sum(targets.values()) + 0.5):
            taken[d] += n
    return taken


def test_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 40, 300]), rng.choice(["a"] * 6 + ["b", "c", None, "é"])) for i in range(700)]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), s, "clash") for d, n, s in rows], DDL)
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    got = M.mix_sources(df).collect()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source] and r.epochs <= 3
    taken = brute(rows, {s: next(r.target for r in got if r.source == s) for s in sizes}, sizes)
    assert {r.doc_id: r.epochs * r.size for r in got} == taken
    for s in sizes:
        assert abs(sum(r.epochs * r.size for r in got if r.source == s) - want[s]) <= 600


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a", ""), (1, None, "a", ""), (None, "x y", None, ""), (None, "x y", None, ""), (2, "", "b", ""), (3, "\u00a0 z", "c", "")], DDL)
    got = sorted((str(r.doc_id), r.size) for r in M.mix_sources(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("3", 2), ("None", 2), ("None", 2)]
    assert M.mix_sources(df.limit(0)).count() == 0
    assert M.mix_sources(df.where("source = 'b'")).first().epochs == 0


def test_documents_come_as_often_as_the_mix_takes_them(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", None]), "clash") for i in range(400)] + [(7, "w w", "a", "clash")] * 3
    df = spark.createDataFrame(rows, DDL)
    want, got = {}, {}
    for r in M.mix_sources(df).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + r.epochs
    out = M.mix_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        key = (r.doc_id, len(r.text.split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_order_is_by_finish_time(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 2], "") for i in range(200)], DDL)
    rows = M.mix_order(df).collect()
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert rows == M.mix_order(df).collect()
    assert len(rows) == sum(r.epochs for r in M.mix_sources(df).collect())


def taken_by_source(rows):
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + r.epochs * r.size
    return out


def test_repeated_and_null_ids_are_cut_inside(spark):
    """A source misses its target by less than one document, whatever its rows have in common."""
    lumps = {
        "one text, no ids": [(None, "w " * 10, s) for s in "abc" for _ in range(1000)],
        "no ids": [(None, f"{s}{i} " * 10, s) for s in "abc" for i in range(1000)],
        "one id": [(5, "w " * 10, s) for s in "abc" for _ in range(1000)],
        "mixed": [(None if i % 3 else i, f"{i % 2} " * (i % 7), s) for s in "abc" for i in range(900)],
    }
    for name, rows in lumps.items():
        got = M.mix_sources(spark.createDataFrame([(*r, "") for r in rows], DDL)).collect()
        targets = {r.source: r.target for r in got}
        taken = taken_by_source(got)
        assert len(got) == len(rows) and max(r.epochs for r in got) <= 3, name
        assert all(abs(taken[s] - t) <= 10 for s, t in targets.items()), (name, taken, targets)
        assert sum(taken.values()) <= round(sum(targets.values())), name


def test_repeated_rows_against_a_plain_version(spark):
    """Rows that repeat in id and text, against a list of single copies."""
    rng = random.Random(11)
    rows = [(i, n, s) for i, n, s in ((rng.randint(0, 30), rng.choice([0, 2, 9]), rng.choice(["a", "a", "b", None])) for _ in range(500))]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), s, "") for d, n, s in rows], DDL)
    got = M.mix_sources(df).collect()
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in {s for _, _, s in rows}}
    targets = {s: next(r.target for r in got if r.source == s) for s in sizes}
    assert sorted((str(r.source), r.doc_id, r.size, r.epochs) for r in got if r.size) == sorted(
        (str(s), d, n, e) for (d, n, s), e in zip(rows, epochs_of(rows, targets, sizes)) if n
    )
    copies = {}
    for r in M.mix_documents(df).collect():
        key = (str(r.source), r.doc_id, len(r.text.split()))
        copies[key] = copies.get(key, 0) + 1
    want = {}
    for r in got:
        key = (str(r.source), r.doc_id, r.size)
        want[key] = want.get(key, 0) + r.epochs
    assert copies == {k: n for k, n in want.items() if n}


def epochs_of(rows, targets, sizes):
    entries = []
    for s, t in targets.items():
        own = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, n, k) for k, (d, n, x) in enumerate(rows) if x == s)
        upto = 0
        for h, d, n, k in own:
            upto += n
            if t > 0:
                entries += [((e * sizes[s] + upto) / t, e, h, d, n, k) for e in range(1 + min(2, int(t // sizes[s])))]
    run, epochs = 0, [0] * len(rows)
    for *_, n, k in sorted(entries):
        run += n
        if run <= int(sum(targets.values()) + 0.5):
            epochs[k] += 1
    return epochs


def test_very_long_texts_and_clashing_names(spark):
    rows = [(1, "w " * 400_000, "a", "x"), *((i, "w", "a", "x") for i in range(2, 400)), *((i, "w w", "b", "x") for i in range(400, 700))]
    df = spark.createDataFrame(rows, DDL)
    got = M.mix_sources(df).collect()
    assert {r.size for r in got if r.doc_id == 1} == {400_000} and all(r.epochs <= 3 for r in got)
    odd = df.selectExpr("doc_id", "text", "source", "'t' as `a.b`", "1 as cut", "2 as c_source", "3 as times", "'r' as row")
    out = M.mix_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r.epochs for r in got)
