"""Orders, which a comparison of rows as a set does not show, and joins by hand."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import jobs as J
from foliant.operators import lines as L
from foliant.operators import matching as M
from foliant.operators import qc as Q
from foliant.operators import ranking as R


def ids(df, c="sample_id"):
    return [r[c] for r in df.collect()]


def test_review_order(spark):
    rows = [("a", False, 9, 9, 9), ("b", True, 0, 5, 1), ("c", True, 1, 0, 0), ("d", True, 0, 5, 2), ("e", True, 0, 5, 2)]
    q = spark.createDataFrame(rows, "sample_id string, review_required boolean, hard_finding_count int, risk_score int, finding_count int")
    assert ids(Q.review_order(q)) == ["c", "d", "e", "b", "a"]
    assert [Q.next_in_queue(q, x).first()[0] for x in ("c", "a", "zz")] == ["d", "c", "c"]
    top = Q.to_review(q, 2).collect()
    assert [(r.sample_id, r.total) for r in top] == [("c", 4), ("d", 4)]


def test_catalog_order_reads_times_not_text(spark):
    rows = [("1", "12/31/2023 10:00:00"), ("2", "01/05/2024 10:00:00"), ("3", "n/a"), ("4", "01/05/2024 10:00:00")]
    items = spark.createDataFrame(rows, "news_item_id string, approve_date string")
    assert ids(C.catalog_order(items), "news_item_id") == ["3", "4", "2", "1"]


def test_curated_last_and_extremes(spark):
    s = spark.createDataFrame([("a", "curated"), ("b", "scratch"), ("c", "curated")], "sample_id string, status string")
    assert ids(Q.curated_last(s)) == ["b", "a", "c"]
    d = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None), ("d", 0.1)], "document_id string, overall double")
    assert ids(R.extremes(d, 2, True), "document_id") == ["a", "b"]
    assert ids(R.extremes(d, 2, False), "document_id") == ["d", "a"]


def test_requested_order_and_limit(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "news_item_id string")
    asked = spark.createDataFrame([("c", 1), ("x", 2), ("a", 3)], "news_item_id string, place int")
    assert ids(C.select_requested(items, asked), "news_item_id") == ["c", "a"]
    assert ids(C.select_requested(items, asked, 1), "news_item_id") == ["c"]


def test_pages_of_jobs_join_up(spark):
    day = dt.datetime(2024, 1, 5)
    jobs = spark.createDataFrame([(f"j{i}", day - dt.timedelta(days=i // 3), "queued") for i in range(7)], "job_id string, created_at timestamp_ntz, status string")
    first = J.page_jobs(jobs, 3).orderBy("place").collect()
    assert [r.job_id for r in first] == ["j2", "j1", "j0"] and [r.next_cursor for r in first] == [None, None, "j0"]
    second = J.page_jobs(jobs, 3, cursor=(str(first[-1].created_at), first[-1].job_id)).orderBy("place").collect()
    assert [r.job_id for r in second] == ["j5", "j4", "j3"]
    last = J.page_jobs(jobs, 3, cursor=(str(second[-1].created_at), second[-1].job_id)).collect()
    assert [(r.job_id, r.next_cursor) for r in last] == [("j6", None)]


def test_titles_by_tier(spark):
    items = spark.createDataFrame([("1", "big red dog runs", "01/05/2024 10:00:00"), ("2", "red dog", "01/06/2024 10:00:00"), ("3", "the reddog barks", "n/a"), ("4", None, "n/a")], "news_item_id string, title string, approve_date string")
    queries = spark.createDataFrame([("q1", "Red Dog"), ("q2", "runs dog red"), ("q3", ""), ("q4", "zebra"), ("q5", None)], "query_id string, query string")
    got = {(r.query_id, r.news_item_id): r["rank"] for r in M.match_titles(queries, items).collect()}
    assert got == {("q1", "2"): 0, ("q1", "1"): 1, ("q1", "3"): 2, ("q2", "1"): 7}
    best = M.best_titles(queries, items).collect()
    assert {(r.query_id, r.news_item_id) for r in best} == {("q1", "2"), ("q2", "1")}


def test_lines_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\n\r\nb\n\n"), (2, ""), (3, None)], "doc_id int, text string")
    lines = L.lines_of(docs, "doc_id")
    assert L.join_lines(L.collapse_blanks(lines, "doc_id"), "doc_id").collect()[0][:] == (1, "a\n\nb")
    units = L.paragraph_units(L.lines_of(spark.createDataFrame([(1, "x\ny\n# H\nz | w\n- i\nk")], "doc_id int, text string"), "doc_id"), "doc_id").orderBy("unit")
    assert [(r.section, r.text) for r in units.collect()] == [("body", "x y"), ("H", "# H"), ("H", "z | w"), ("H", "- i"), ("H", "k")]


def test_ranking_document_rows(spark):
    text = "a\n| rank | t |\n|---|---|\n| 1 | x |\n| 2 | y |\nend\n| 3 | z |"
    got = spark.range(1).select(L.section_rows(F.lit(text), "| rank").alias("r"), L.section_rows(F.lit(text), "| none").alias("n")).first()
    assert got.r == [["1", "x"], ["2", "y"]] and got.n == []


def test_candidates_are_those_of_all_pairs_of_a_date(spark):
    """Against every sample with every item of its dates, for each least score."""
    import random

    rng = random.Random(4)
    words = ["ab", "abc", "doc12", "doc1", "", "12", "x doc12 y"]
    items = [(str(i), rng.choice(words), f"01/0{rng.randint(3, 5)}/2026 10:00:00", i) for i in range(60)]
    files = [(str(rng.randint(0, 59)), rng.choice(words) + rng.choice([".hwpx", ".pdf", ".HWP", ""])) for _ in range(90)]
    samples = [(f"s{i}", rng.choice(words), f"d/26010{rng.randint(3, 5)}_{rng.choice(words)}.hwpx") for i in range(40)] + [("e1", "ab", "d/260104.hwpx"), ("e2", None, None)]
    i = spark.createDataFrame(items, "news_item_id string, title string, approve_date string, place int")
    a = spark.createDataFrame(files, "news_item_id string, file_name string")
    s = spark.createDataFrame(samples, "sample_id string, title string, source string")

    compact = lambda t: "".join(c for c in t if c.isascii() and c.isalnum())
    stem = lambda f: f[: f.rindex(".")] if "." in f[1:] else f

    def score(title, name, item):
        n = 5 if compact(title) == compact(item[1]) else 3 if compact(item[1]) and (compact(title) in compact(item[1]) or compact(item[1]) in compact(title)) else 0
        own = [f for k, f in files if k == item[0]]
        for f in own:
            t = compact(stem(f))
            n += 6 if t == name else 4 if t and (t in name or name in t) else 0
        return n + any(f.lower().endswith(".pdf") for f in own)

    for least in (2, 4, 5):
        want = {}
        for sid, title, source in samples:
            if source:
                day = f"01/{source[6:8]}/2026"
                of_day = [(-score(title, compact(source[2:].replace(".hwpx", "")), x), x[3], x[0]) for x in items if x[2].startswith(day)]
                best = min(of_day, default=(0,))
                if -best[0] >= least:
                    want[sid] = (best[2], -best[0])
        assert {r.sample_id: (r.news_item_id, r.score) for r in M.score_candidates(s, i, a, least).collect()} == want and want


def test_only_the_days_that_reach_n_are_read(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(16)]
    rows = [(f"{d}-{k}", "01/05/2024 10:00:00", days[d]) for d in range(16) for k in range(3)] + [("0-0", "01/05/2024 10:00:00", days[15])]
    path = str(tmp_path / "items")
    spark.createDataFrame(rows, "news_item_id string, approve_date string, approve_day date").write.partitionBy("approve_day").parquet(path)
    for n in (1, 4, 5, 20, 100):
        got = C.latest_of_partitions(spark, path, n)
        want = C.latest_over_days(spark.createDataFrame([(a, b, str(c)) for a, b, c in rows], "news_item_id string, approve_date string, day_file string"), n)
        assert ids(got, "news_item_id") == ids(want, "news_item_id")
    read = {f.split("approve_day=")[1][:10] for f in C.latest_of_partitions(spark, path, 5).inputFiles()}
    assert read == {"2024-01-15", "2024-01-16"}
    assert C.latest_of_partitions(spark, path, 5, lookback=1).count() == 4
