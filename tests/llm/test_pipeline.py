import corpus_pipeline as C
from foliant.llm.mixing import mix_sources


def test_stages_one_after_another(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    kept = C.quality(spark, docs, sf_dir)
    assert 0 < kept.count() < before and tuple(kept.columns) == C.COLUMNS
    lines = C.line_dedup(spark, kept, sf_dir)
    assert lines.count() == kept.count() and tuple(lines.columns) == C.COLUMNS
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    one = C.near_dedup(spark, lines, sf_dir)
    groups = C.near_duplicates(lines).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in groups})
    mixed = C.mix(spark, one, sf_dir)
    want = {r.doc_id: r.epochs for r in mix_sources(one).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    packed = C.pack(spark, mixed, sf_dir)
    assert packed.where("piece = 0").count() == sum(got.values())


def test_run_and_stage_list(spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]
    assert C.run(spark, sf_dir).count() > 0


def test_edges(spark, sf_dir):
    rows = [(None, "a b c", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for _, stage in C.STAGES[1:]:
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert C.near_dedup(spark, docs, sf_dir).where("doc_id = 3").count() == 1


def test_a_very_long_text_goes_through_every_stage(spark, sf_dir):
    long = "\n".join(f"a line of its own, number {i}" for i in range(40_000))
    rows = [(i, long if i == 7 else f"a short text, number {i}, of a few words", "en", "s", 0, "clash") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.where("doc_id = 7").count() > 0 or name == "quality"
        if name == "quality":
            docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    assert docs.where("doc_id = 7").count() > 100
