"""Segmented scans against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators.scans import segmented, spaced_picks
from foliant.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)


def probes(n, seed, keys=3, step=900):
    rng, t, out = random.Random(seed), T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 60, step, step * 20]))
        out.append((rng.choice([f"s{k}" for k in range(keys)]), i, t, rng.random() < 0.2))
    return out


def by_step(step, rows, key, order):
    out, state = [], {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        state[r[key]], emitted = step(state.get(r[key]), r)
        out += emitted
    return sorted(map(str, out))


def test_running_values(spark):
    rows = [(k, i, t, v) for (k, i, t, _), v in zip(probes(300, 1), [random.Random(i).choice([None, i]) for i in range(300)])]
    rows += [(None, 1000 + i, T0 + dt.timedelta(hours=i * 7), i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, id long, ts timestamp, v long")
    got = segmented(df, ["k"], ["ts", "id"], sums={"n": F.col("v")}, lasts={"last": F.col("v")}, befores={"was": F.col("v")}, slot_s=3600).collect()
    state = {}
    for r in sorted(got, key=lambda r: (r.ts, r.id)):
        total, last, was = state.get(r.k, (0, None, None))
        total, last = total + (r.v or 0), r.v if r.v is not None else last
        assert (r.n, r["last"], r.was) == (total, last, was)
        state[r.k] = total, last, r.v
    assert len(got) == len(rows)


@pytest.mark.parametrize("gap", [1, 700, 5000])
def test_picks(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.choice([rng.random() * 20_000, 300_000 + rng.random() * 9_000]))) for _ in range(400)]
    rows += [(k, t) for k, t in rows[:20]]
    first = {k: min(t for x, t in rows if x == k) for k in ("a", "b", None)}
    df = spark.createDataFrame([(k, t, t == first[k]) for k, t in rows], "k string, ts timestamp, start boolean")
    want = set()
    for k in first:
        at = None
        for t in sorted(t for x, t in rows if x == k):
            if at is None or (t - at).total_seconds() >= gap:
                at = t
                want.add((k, round((t - T0).total_seconds() * 1_000_000)))
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert {(r.k, r.at - base) for r in spaced_picks(df, ["k"], "ts", gap, "start").collect()} == want


@pytest.mark.parametrize("threshold,reminder", [(1, 600), (2, 3600), (3, 1800)])
def test_monitor_over_a_table_equals_its_step(spark, threshold, reminder):
    rows = probes(500, threshold)
    df = spark.createDataFrame(rows, "server string, event_id long, ts timestamp, ok boolean")
    dicts = [dict(zip(("server", "event_id", "ts", "ok"), r)) for r in rows]
    want = by_step(S.monitor_step(threshold, reminder), dicts, "server", ("ts", "event_id"))
    got = S.monitor(df, threshold, reminder_s=reminder)
    assert "Python" not in got._jdf.queryExecution().toString()
    alerts = [r.alert for r in got.collect()]
    assert alerts.count("down_reminder") > 5
    as_step = lambda r: str((r.server, r.event_id, S.pd.Timestamp(r.ts), r.state, r.consecutive_failures, r.alert))
    assert sorted(map(as_step, got.collect())) == want


def test_job_states_over_a_table_equal_their_step(spark):
    rng = random.Random(5)
    kinds = ["create", "claim", "save_text", "save_result", "save_html", "save_edit", "fail", "other", None]
    rows = [(k, i, t, rng.choice(kinds), rng.choice([None, "e1", "e2"])) for k, i, t, _ in probes(400, 6, keys=9)]
    names = ("job_id", "event_id", "ts", "kind", "payload")
    df = spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp, kind string, payload string")
    want = by_step(S.job_step, [dict(zip(names, r)) for r in rows], "job_id", ("ts", "event_id"))
    as_step = lambda r: str((r.job_id, r.event_id, S.pd.Timestamp(r.ts), r.status, r.progress, r.result_version, r.error))
    assert sorted(as_step(r) for r in S.job_state(df).collect()) == want


def test_empty(spark):
    df = spark.createDataFrame([], "server string, event_id long, ts timestamp, ok boolean")
    assert S.monitor(df).count() == 0
