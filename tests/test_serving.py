"""Answers against a loop over requests, stale serving, and replays."""

import datetime as dt
import random

from foliant.streaming import pipelines as P
from foliant.streaming import serving as V
from foliant.streaming import stateful as S

T0 = dt.datetime(2024, 1, 5)
ASKED = "request_id long, day date, asked_at timestamp, ok boolean, reason string"


def plain(rows, brings, days=None, max_age=3600):
    state, out = dict(days or {}), []
    for rid, day, at, ok, reason in sorted(rows, key=lambda r: (r[2], r[0])):
        last, fetch, items = state.get(day, (None, None, 0))
        due = items == 0 if day < at.date() else last is None or (at - last).total_seconds() >= max_age
        if due and ok:
            state[day] = last, fetch, items = at, rid, brings.get(rid, 0)
        answer = "fresh" if not due else "refreshed" if ok else "stale" if items else "failed"
        out.append((rid, answer, reason if answer in ("stale", "failed") else None, last, fetch, items))
    return sorted(out, key=str), state


def asked(n, seed):
    rng, t, out = random.Random(seed), T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 400, 1800, 3600]))
        ok = rng.random() < 0.6
        out.append((i, (t + dt.timedelta(days=rng.choice([-2, -1, 0, 0, 0, 1]))).date(), t, ok, None if ok else "down"))
    return out, {i: rng.choice([0, 1, 3]) for i in range(n)}


def as_rows(df):
    return sorted(((r.request_id, r.answer, r.reason, r.last_refreshed_at, r.fetch_id, r["items"]) for r in df.collect()), key=str)


def test_answers_equal_a_loop(spark):
    rows, brings = asked(300, 1)
    sizes = spark.createDataFrame([(k, v) for k, v in brings.items() if v], "fetch_id long, items long")
    first, second = rows[:170], rows[170:]
    want, state = plain(first, brings)
    none = spark.createDataFrame([], V.DAYS)
    assert as_rows(V.answer_requests(spark.createDataFrame(first, ASKED), sizes, none)) == want
    assert {a for _, a, *_ in want} == {"fresh", "refreshed", "stale", "failed"}
    days = spark.createDataFrame([(d, *s) for d, s in state.items()], V.DAYS)
    assert as_rows(V.answer_requests(spark.createDataFrame(second, ASKED), sizes, days)) == plain(second, brings, state)[0]


def serve(spark, tmp_path, rows, fetches, path):
    spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ASKED).parquet(str(tmp_path / "in"))
    V.serve_catalog_stream(stream, fetches, path, str(tmp_path / "log")).awaitTermination()


def test_a_failed_refresh_serves_what_is_stored(spark, tmp_path):
    day, path = T0.date(), str(tmp_path / "out")
    at = lambda h: T0 + dt.timedelta(hours=h)
    fetches = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (4, "a", "new")], "fetch_id long, news_item_id string, title string")
    serve(spark, tmp_path, [(0, day, at(0), False, "502"), (1, day, at(1), True, None), (2, day, at(1.5), False, "502")], fetches, path)
    serve(spark, tmp_path, [(3, day, at(3), False, "timed out")], fetches, path)
    answers = {r.request_id: r for r in V.read_answers(spark, path).collect()}
    assert [answers[i].answer for i in range(4)] == ["failed", "refreshed", "fresh", "stale"]
    assert answers[3].reason == "timed out" and answers[3].last_refreshed_at == at(1) and answers[3]["items"] == 2
    titles = lambda: sorted((r.news_item_id, r.title) for r in V.read_catalog(spark, path).collect())
    assert titles() == [("a", "old"), ("b", "old")]
    serve(spark, tmp_path, [(4, day, at(4), True, None)], fetches, path)
    assert titles() == [("a", "new")]  # a fetch replaces the whole day


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows, brings = asked(60, 3)
    fetches = spark.createDataFrame([(k, f"{k}-{j}") for k, v in brings.items() for j in range(v)], "fetch_id long, news_item_id string")
    path = str(tmp_path / "out")
    serve(spark, tmp_path, rows[:40], fetches, path)
    serve(spark, tmp_path, rows[40:], fetches, path)
    once, items = as_rows(V.read_answers(spark, path)), sorted(map(str, V.read_catalog(spark, path).collect()))
    assert len(once) == 60
    for name in ("1", ".1.crc"):  # as if the driver had died before the commit
        (tmp_path / "log" / "commits" / name).unlink()
    stream = spark.readStream.schema(ASKED).parquet(str(tmp_path / "in"))
    V.serve_catalog_stream(stream, fetches, path, str(tmp_path / "log")).awaitTermination()
    assert as_rows(V.read_answers(spark, path)) == once
    assert sorted(map(str, V.read_catalog(spark, path).collect())) == items


def test_a_key_with_very_many_rows_is_merged_from_sorted_runs(spark, tmp_path):
    schema = "key string, event_id long, ts timestamp"
    n = 1_000_000
    rows = spark.range(n).selectExpr("'k' as key", "id as event_id", f"timestamp_seconds(1704067200 + (id * 7919) % {n}) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    got = P.run_available(S.rate_limit(stream, 1, 10, stream=True))
    # One a second, so every eleventh is accepted, in order of time.
    assert got.count() == n
    assert got.where("accepted").count() == -(-n // 11)
    assert got.where("accepted and (unix_seconds(ts) - 1704067200) % 11 <> 0").count() == 0


def test_runs_that_do_not_fit_are_put_in_order(monkeypatch):
    class Runs(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.pop

    monkeypatch.setattr(S, "RUN_ROWS", 7)
    monkeypatch.setattr(S, "BLOCK_ROWS", 3)
    schema = S.StructType.fromDDL("key string, event_id long, ts long") if hasattr(S.StructType, "fromDDL") else None
    p = S.StepProcessor(None, ["ts", "event_id"], "", False, schema, [], 0, None)
    p.runs = Runs()
    rows = [S.Row(key="k", event_id=i, ts=(i * 37) % 50) for i in range(40)]
    got = [(r["ts"], r["event_id"]) for r in p._in_order(iter(rows))]
    assert got == sorted((r["ts"], r["event_id"]) for r in rows) and not p.runs
