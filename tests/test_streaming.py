import datetime as dt

import pandas as pd

from foliant.streaming import pipelines as P
from foliant.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def write(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def plain(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_denied_requests_do_not_count(spark):
    rows = [("k", i, at(s)) for i, s in enumerate((0, 1, 2, 10, 11, 12))]
    got = S.rate_limit(spark.createDataFrame(rows, "key string, event_id long, ts timestamp"), 2, 10)
    assert [r.accepted for r in got.orderBy("event_id").collect()] == [True, True, False, False, True, True]


def test_limit_stream_equals_table(spark, tmp_path):
    schema = "key string, event_id long, ts timestamp"
    rows = [(f"k{i % 3}", i, at(i * 7 % 100)) for i in range(60)]
    stream = write(spark, tmp_path, rows, schema).withWatermark("ts", "1 minute")
    got = P.run_available(S.rate_limit(stream, 3, 20, stream=True))
    want = S.rate_limit(spark.createDataFrame(rows, schema), 3, 20)
    assert plain(got, "event_id", "accepted") == plain(want, "event_id", "accepted")


def test_monitor_reminders_and_quiet_hours():
    step = S.monitor_step(2)
    state, alerts = None, []
    # 18:00 UTC is 03:00 at UTC+9, within the quiet hours.
    for hour, ok in ((0, True), (1, False), (1.1, False), (1.5, False), (2.2, False), (18, False), (23.5, False), (23.6, True), (23.7, False), (23.8, True)):
        row = {"server": "s", "event_id": 1, "ts": pd.Timestamp(T0) + pd.Timedelta(hours=hour), "ok": ok}
        state, out = step(state, row)
        alerts.append(out[0][5])
    assert alerts == [None, "degraded", "down", None, "down_reminder", None, "down_reminder", "recovered", "degraded", "recovered"]


def test_threshold_of_one_skips_degraded():
    step = S.monitor_step(1)
    assert step(None, {"server": "s", "event_id": 1, "ts": pd.Timestamp(T0), "ok": False})[1][0][3:] == ("down", 1, "down")


def test_older_job_events_change_nothing_but_the_version():
    row = lambda i, s, k: {"job_id": "j", "event_id": i, "ts": pd.Timestamp(at(s)), "kind": k, "payload": "p"}
    state, _ = S.job_step(None, row(1, 10, "save_text"))
    state, out = S.job_step(state, row(2, 5, "claim"))
    assert out == [] and state[0] == "completed"
    state, out = S.job_step(state, row(3, 6, "save_edit"))
    assert out[0][5] == 2 and state[0] == "completed"


def test_expiry_is_emitted_once_the_watermark_has_passed(spark, tmp_path):
    schema = "job_id string, event_id long, ts timestamp, kind string, payload string"
    write(spark, tmp_path, [("a", 1, at(0), "save_text", None), ("b", 2, at(0), "claim", None)], schema)
    stream = write(spark, tmp_path, [("c", 3, at(400_000), "create", None)], schema).withWatermark("ts", "1 hour")
    assert plain(P.run_available(S.expire_stream(stream, 72)), "job_id", "status") == [("a", "completed")]


def test_upsert_keeps_other_items_and_the_last_version(spark, tmp_path):
    schema = "news_item_id string, title string, approve_day date, ingested_at timestamp"
    day = dt.date(2024, 1, 5)
    out = str(tmp_path / "out")
    for n, rows in enumerate(([("1", "old", day, at(0)), ("2", "two", day, at(0))], [("1", "new", day, at(5))])):
        stream = write(spark, tmp_path, rows, schema)
        P.upsert_catalog_stream(stream, out, str(tmp_path / "log")).awaitTermination()
    assert plain(spark.read.parquet(out), "news_item_id", "title") == [("1", "new"), ("2", "two")]


def test_dedupe_and_media(spark, tmp_path):
    stream = write(spark, tmp_path, [("a", at(0)), ("a", at(1)), ("b", at(2))], "k string, ts timestamp")
    assert plain(P.run_available(P.dedupe_requests(stream, "k")), "k") == [("a",), ("b",)]
    m = write(spark, tmp_path / "m", [("m1", "u", at(1000)), ("m2", "u", at(5000)), ("m3", "u", at(9000))], "message_id string, sender string, ts timestamp")
    f = write(spark, tmp_path / "f", [("u", at(500), "/a.md"), ("u", at(600), "/b.png"), ("u", at(9000), "/z.md")], "sender string, ts timestamp, path string")
    got = plain(P.run_available(P.media_for_messages(m, f)), "message_id", "path")
    assert ("m1", "/a.md") in got and ("m2", None) in got


def test_messages_without_media_wait_no_longer_than_others(spark, tmp_path):
    """Of messages before the watermark none is kept back for the time that files are kept."""
    rows = [(f"m{i}", "u1", f"2024-01-01 10:{i:02d}:00") for i in range(0, 40, 4)]
    files = [("u2", "2024-01-01 10:40:00", "/m/a.md"), ("u1", "2024-01-01 10:01:00", "/m/b.md")]
    at = "to_timestamp(ts) as ts"
    spark.createDataFrame(rows, "message_id string, sender string, ts string").selectExpr("message_id", "sender", at).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(files, "sender string, ts string, path string").selectExpr("sender", at, "path").write.parquet(str(tmp_path / "f"))
    m = spark.readStream.schema("message_id string, sender string, ts timestamp").parquet(str(tmp_path / "m"))
    f = spark.readStream.schema("sender string, ts timestamp, path string").parquet(str(tmp_path / "f"))
    from foliant.streaming.pipelines import media_for_messages, run_available

    got = {(r.message_id, r.path) for r in run_available(media_for_messages(m, f)).collect()}
    assert got == {(f"m{i}", "/m/b.md" if i in (4, 8, 12, 16) else None) for i in range(0, 36, 4)}


def test_what_a_key_emits_is_packed():
    """The Python worker lists all that a key emits in a micro-batch: 20,000 probes make four rows of bounded size."""
    import datetime as dt
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import Row

    from foliant.streaming import stateful as S

    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    probes = (Row(server="s", event_id=i, ts=at + dt.timedelta(seconds=i), ok=i % 3 > 0) for i in range(20_000))
    p = S.StepProcessor(S.monitor_step(), ["ts", "event_id"], "state string, failures long, alerted long", False, None, S.ALERTS, 1000, None)
    p.kept = SimpleNamespace(exists=lambda: False, update=lambda v: None)
    p.handle = SimpleNamespace(listTimers=lambda: [], registerTimer=lambda t: None)
    packed = list(p.handleInputRows(("s",), probes, SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert len(packed) == 4 and sum(len(r.rows) for r in packed) < 40 * 20_000
    rows = [r for b in S._unpacked([pa.RecordBatch.from_pylist([{"rows": r.rows} for r in packed])]) for r in b.to_pylist()]
    assert [r["event_id"] for r in rows] == list(range(20_000)) and rows[3]["alert"] == "degraded" and rows[3]["ts"] == at + dt.timedelta(seconds=3)


def test_messages_and_files_of_one_sender_meet_once_in_order(spark, tmp_path):
    """A busy sender, ends of slots, equal times and several micro-batches: no message meets all files of its minutes."""
    import random

    rng = random.Random(5)
    second = 1_000_000
    files = [(rng.choice("uv"), rng.randrange(9000 * second), f"/m/{i}.md") for i in range(900)]
    files += [("u", s * second, f"/t/{s}{x}.md") for s in (0, 900, 3600, 7200, 7200) for x in "ab"] + [(None, 3600 * second, "/none.md"), ("u", 9001 * second, "/last.md")]
    asked = [(f"m{i}", rng.choice("uvw"), rng.randrange(9000 * second)) for i in range(900)]
    asked += [(f"e{s}", "u", s * second) for s in (0, 900, 1800, 3600, 4500, 7200, 8100)] + [("over", "w", 4000 * second), ("twice", "v", 5000 * second), ("twice", "v", 5000 * second), ("null", None, 3700 * second)]
    asked.append(("last", "u", 9001 * second))
    start = int(at(0).timestamp()) // 3600 * 3600 * second
    kinds = (("m", "message_id string, sender string, us long", asked, 2), ("f", "sender string, us long, path string", files, 1))
    streams = []
    for name, schema, rows, place in kinds:
        rows = sorted(rows, key=lambda r: r[place])
        for k in range(3):
            part = spark.createDataFrame(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], schema)
            part.selectExpr("* except (us)", f"timestamp_micros(us + {start}) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        fields = spark.read.parquet(str(tmp_path / name)).schema
        streams.append(spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    q = P.media_for_messages(*streams).writeStream.format("memory").queryName("t6_busy").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.message_id, r.sender, r.path) for r in spark.table("t6_busy").collect()]
    end = 9001 * second - 60 * second
    near = lambda s, us: max(((f, p) for o, f, p in files if o and o == s and us - 900 * second <= f <= us), default=(None, None))[1]
    assert sorted(got, key=str) == sorted({(m, s, near(s, us)) for m, s, us in asked if us <= end}, key=str)
    rows_kept = sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"])
    assert rows_kept < len(asked) / 2  # a row of state for each message, each file and each pair before
