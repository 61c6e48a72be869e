from foliant.llm import linededup as L

DDL = "doc_id long, text string, source string, line string, host string, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "y", "z") for d, t, s in rows], DDL)


def plain(rows, ratio=L.RATIO, least=L.MIN_PAGES):
    pages, count = {}, {}
    for _, t, s in rows:
        if t is not None:
            pages.setdefault(s, set()).add(t)
    for s, texts in pages.items():
        for t in texts:
            for line in {x.strip(" \t\r\x0b\x0c") for x in t.split("\n")} - {""}:
                count[s, line] = count.get((s, line), 0) + 1
    drop = {k for k, n in count.items() if n >= least and n > len(pages[k[0]]) * ratio}
    return sorted(
        (str(d), t if t is None or not any(k[0] == s for k in drop) else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\x0b\x0c")) not in drop))
        for d, t, s in rows
    )


def test_against_a_plain_version(spark):
    rows = [(i, f"own {i}\n" + ("  menu \n" if i % 2 else "") + ("rare\n" if i < 3 else "") + "\nend", "ab"[i % 7 == 0]) for i in range(60)]
    rows += [(100 + i, "copied page\nwith lines", "a") for i in range(30)]  # one page, stored many times
    rows += [(200, None, "a"), (201, "", "a"), (None, "menu", "a"), (202, "menu\nmenu", None), (203, "menu", None), (204, "menu\nx", None), (204, "menu\nx", None)]
    df = frame(spark, rows)
    got = sorted((str(r.doc_id), r.text) for r in L.drop_boilerplate(df).collect())
    assert got == plain(rows)
    assert ("100", "copied page\nwith lines") in got
    assert not any("menu" in (t or "") for d, t in got if d in ("1", "3"))
    assert L.drop_boilerplate(df).columns == df.columns


def test_a_page_may_lose_all_its_lines(spark):
    rows = [(i, f"menu\nown {i}", "a") for i in range(9)] + [(9, "menu", "a")]
    assert {r.doc_id: r.text for r in L.drop_boilerplate(frame(spark, rows)).collect()}[9] == ""


def test_empty_table(spark):
    assert L.drop_boilerplate(frame(spark, [(1, "a", "b")]).limit(0)).count() == 0


def test_the_pipeline_drops_lines_well_above_the_wide_ratio(spark):
    import corpus_pipeline as C

    # 400 pages: one line on 9 % of them, one on 1 %, each below the ratio of the query.
    rows = [(i, f"own {i}" + ("\nnine" if i < 36 else "") + ("\none" if i % 100 == 99 else ""), "en", "a", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in C.line_dedup(spark, df, "").collect()]
    assert sum("nine" in t for t in got) == 0 and sum("\none" in t for t in got) == 4 and all("own" in t for t in got)


def test_very_long_texts_and_clashing_names(spark):
    long = "\n".join(f"own {i}" for i in range(60_000))
    rows = [(i, f"menu\nstory {i}", "h", "x", "y") for i in range(20)] + [(99, f"menu\n{long}\nmenu", "h", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, its_host string, its_lines string")
    out = L.drop_boilerplate(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and got[3] == "story 3" and got[99] == long
