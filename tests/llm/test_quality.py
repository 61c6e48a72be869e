import zlib

import numpy as np

from foliant.llm import quality as Q

DDL = "doc_id long, text string, score double, quality int"


def test_fit_learns_a_pair_that_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x[:3000], y[:3000])
    assert any({i, j} == {0, 1} for i, j, _ in m.pairs)
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_without_both_labels():
    none = Q.fit(np.zeros((0, len(Q.FEATURES))), np.zeros(0))
    assert none.score(np.zeros((2, len(Q.FEATURES)))).tolist() == [0.5, 0.5]
    ones = Q.fit(np.zeros((3, len(Q.FEATURES))), np.ones(3))
    assert ones.score(np.zeros((1, len(Q.FEATURES))))[0] > 0.9


def test_features_of_edges():
    for t in (None, "", "\n\n", "a", "É" * 200_000, "|" * 10):
        f = Q.features(t)
        assert f.shape == (len(Q.FEATURES),) and np.isfinite(f).all()


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.op8_quality_gam(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and (r.predicted == 1) == (r.score >= 0.5) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0.0, 0), (1, "a b", 0.0, 0), (None, None, 0.0, 0), (2, "", 0.0, 0), (3, "x " * 90_000, 0.0, 0)], DDL)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    rows = Q.score_quality(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    kept = Q.keep_quality(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 5
    assert Q.score_quality(docs.limit(0), Q.train(docs.limit(0), labels.limit(0))).count() == 0
