"""State machines by key, each written once as a step.

A step takes the key's state (a tuple, or None at first) and one row, and gives the new state and the
rows to emit. Over a stream a stateful processor runs it, whose state, timers and scratch lie in RocksDB; a key's
rows of a micro-batch are put in order there, in sorted runs that are merged, so a key with a third of all rows needs
no more memory than one with few. Over a table the limiter sorts by key and order and carries the state
of one key; the monitor and the job states are computed by segmented scans, without Python (see operators.scans).

Late rows: a stream's rows are put in order within a micro-batch; rows older than the watermark are
dropped by Spark and counted in its progress.
"""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliant.operators.scans import segmented, spaced_picks
from foliant.sources.scratch import stored

Step = Callable[[tuple | None, dict], tuple[tuple | None, list[tuple]]]

#: Rows of a key that are held at a time, and rows of a block of a sorted run.
RUN_ROWS, BLOCK_ROWS = 50_000, 1_000
#: Emitted rows that are packed into one.
PACKED_ROWS = 5_000
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def sweep(df: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The step over a table."""
    names = _columns(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                if row[key] != at:
                    at, state = row[key], None
                state, rows = step(state, row)
                out.extend(rows)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _packed(rows: Iterable[tuple], schema: str) -> Iterator[Row]:
    """Rows of (rows), each an Arrow stream of many. Spark's Python worker holds all that a key emits in a micro-batch as
    one list of dictionaries, which takes a few hundred bytes a row; packed, it takes a few dozen."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    rows = iter(rows)
    while chunk := list(islice(rows, PACKED_ROWS)):
        plain = ([v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in column] for column in zip(*chunk))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, fields, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(plain, fields)], schema=fields))
        yield Row(rows=sink.getvalue().to_pybytes())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("rows"):
            yield from pa.ipc.open_stream(packed.as_buffer())


class StepProcessor(StatefulProcessor):
    """A step by key over a stream. The state is one value or, with ``many``, a list of single numbers.

    A timer goes off once a key was idle for ``keep_ms`` of event time; ``idle`` gives the rows to emit then, from
    the key and the state, and the state is forgotten.
    """

    def __init__(self, step: Step, order: list[str], state: str, many: bool, rows: StructType, out: str, keep_ms: int, idle: Callable | None):
        self.step, self.order, self.schema, self.many, self.rows, self.out, self.keep_ms, self.idle = step, order, state, many, rows, out, keep_ms, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("state", self.schema) if self.many else handle.getValueState("state", self.schema)
        self.runs = handle.getMapState("runs", "run int, block int", f"rows array<{self.rows.simpleString()}>")

    def _load(self) -> tuple | None:
        if not self.kept.exists():
            return None
        return ([v for (v,) in self.kept.get()],) if self.many else self.kept.get()

    def _store(self, state: tuple | None) -> None:
        if state is None or self.many and not state[0]:
            self.kept.clear()
        elif self.many:
            self.kept.put([(v,) for v in state[0]])
        else:
            self.kept.update(state)

    def _place(self, row: Row) -> tuple:
        return tuple(row[c] for c in self.order)

    def _in_order(self, rows: Iterator[Row]) -> Iterator[Row]:
        """A key's rows of a micro-batch in order: sorted where they fit, else by runs that lie in the state store."""
        run = sorted(islice(rows, RUN_ROWS), key=self._place)
        if len(run) < RUN_ROWS:
            yield from run
            return
        blocks: list[int] = []
        while run:
            for k in range(0, len(run), BLOCK_ROWS):
                self.runs.updateValue((len(blocks), k // BLOCK_ROWS), ([tuple(r) for r in run[k : k + BLOCK_ROWS]],))
            blocks.append(-(-len(run) // BLOCK_ROWS))
            run = sorted(islice(rows, RUN_ROWS), key=self._place)
        yield from heapq.merge(*(self._read(i, n) for i, n in enumerate(blocks)), key=self._place)

    def _read(self, run: int, blocks: int) -> Iterator[Row]:
        named = Row(*self.rows.names)
        for k in range(blocks):
            found = self.runs.getValue((run, k))[0]
            self.runs.removeKey((run, k))
            yield from (named(*r) for r in found)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return _packed(self._emitted(rows, timerValues), self.out)

    def _emitted(self, rows: Iterator[Row], timerValues) -> Iterator[tuple]:
        now, last = self._load(), None
        for row in self._in_order(rows):
            now, emitted = self.step(now, row.asDict())
            last = row["ts"]
            yield from emitted
        self._store(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is not None and last is not None:
            at = int(pd.Timestamp(last).timestamp() * 1000)
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + self.keep_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        self.kept.clear()
        yield from _packed(self.idle(key[0], state) if self.idle and state is not None else [], self.out)


def over_stream(df: DataFrame, key: str, order: list[str], step: Step, schema: str, state: str, keep_ms: int, idle: Callable | None = None, many: bool = False) -> DataFrame:
    """The step over a stream with a watermark on ``ts``. The session's state store becomes RocksDB's."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = StepProcessor(step, order, state, many, df.schema, schema, keep_ms, idle)
    return df.groupBy(key).transformWithState(processor, "rows binary", "append", "eventTime").mapInArrow(_unpacked, schema)


# A limiter that counts accepted requests only

LIMITED = "key string, event_id long, ts timestamp, accepted boolean"


def limit_step(n: int, seconds: float) -> Step:
    def step(state, row):
        at = pd.Timestamp(row["ts"])
        recent = [t for t in (state[0] if state else []) if t >= at.value - int(seconds * 1_000_000_000)]
        accepted = len(recent) < n
        if accepted:
            recent.append(at.value)
        return (recent,), [(row["key"], row["event_id"], at, accepted)]

    return step


def rate_limit(requests: DataFrame, n: int = 12, seconds: float = 60, stream: bool = False) -> DataFrame:
    """Per key at most ``n`` accepted requests in any ``seconds``; denied ones do not count."""
    step = limit_step(n, seconds)
    if not stream:
        return sweep(requests, "key", ["ts", "event_id"], step, LIMITED)
    return over_stream(requests, "key", ["ts", "event_id"], step, LIMITED, "accepted long", int(seconds * 1000), many=True)


# A server monitor

ALERTS = "server string, event_id long, ts timestamp, state string, consecutive_failures long, alert string"


def monitor_step(threshold: int = 2, reminder_s: int = 3600, quiet: tuple[int, int] = (2, 8), utc_hours: int = 9) -> Step:
    """State: (state, failures, time of the last alert in ns or -1)."""

    def step(state, row):
        was, failures, alerted = state or ("up", 0, -1)
        at, alert = pd.Timestamp(row["ts"]), None
        if row["ok"]:
            alert = "recovered" if was in ("degraded", "down") else None
            now, failures = "up", 0
        else:
            failures += 1
            if was == "down":
                now = "down"
                hour = (at + dt.timedelta(hours=utc_hours)).hour
                due = alerted < 0 or at.value - alerted >= reminder_s * 1_000_000_000
                alert = "down_reminder" if due and not quiet[0] <= hour < quiet[1] else None
            elif failures >= threshold:
                now = alert = "down"
            else:
                now = "degraded"
                alert = "degraded" if was == "up" else None
        if alert:
            alerted = at.value
        return (now, failures, alerted), [(row["server"], row["event_id"], at, now, failures, alert)]

    return step


def monitor_table(probes: DataFrame, threshold: int = 2, reminder_s: int = 3600, quiet: tuple[int, int] = (2, 8), utc_hours: int = 9) -> DataFrame:
    """T2 over a table, by segmented scans: a server's probes are cut into days and never meet in one task.

    The number of failures in a row is a running count less its value at the last success. A run of failures is down from
    its ``threshold``th on, which alerts, so reminders hang on their own run alone: each is the first probe
    outside quiet hours at least ``reminder_s`` after the alert before it.
    """
    order, ok = ["ts", "event_id"], F.col("ok")
    counted = segmented(probes.select("server", *order, F.coalesce("ok", F.lit(False)).alias("ok")), ["server"], order, sums={"run": ok.cast("long"), "failed": (~ok).cast("long")}, befores={"was_ok": ok})
    since = segmented(counted, ["server"], order, lasts={"settled": F.when(ok, F.col("failed"))})
    k = F.when(ok, 0).otherwise(F.col("failed") - F.coalesce("settled", F.lit(0)))
    hour = F.pmod(F.floor(F.col("at") / 3_600_000_000) + utc_hours, F.lit(24))
    runs = stored(since.withColumn("k", k).withColumn("at", F.unix_micros("ts")).drop("failed", "settled"), "monitor")
    down = runs.where((F.col("k") == threshold) | (F.col("k") > threshold) & ~((hour >= quiet[0]) & (hour < quiet[1])))
    picks = spaced_picks(down.withColumn("start", F.col("k") == threshold), ["server", "run"], "ts", reminder_s, "start")
    # Of probes at one time the first is the one that reminds, and none at the time of the alert itself.
    due = down.groupBy("server", "run", "at").agg(F.min("k").alias("k"), F.min("event_id").alias("event_id"))
    due = due.where(F.col("k") > threshold).join(picks, ["server", "run", "at"], "left_semi")
    due = due.select("server", "at", "event_id", F.lit(True).alias("due"))
    state = F.when(ok, "up").when(F.col("k") >= threshold, "down").otherwise("degraded")
    alert = (
        F.when(ok & (~F.coalesce("was_ok", F.lit(True))), "recovered")
        .when(F.col("k") == threshold, "down")
        .when(~ok & (F.col("k") == 1) & F.lit(threshold > 1), "degraded")
        .when(F.col("due"), "down_reminder")
    )
    return runs.join(due, ["server", "at", "event_id"], "left").select("server", "event_id", "ts", state.alias("state"), F.col("k").alias("consecutive_failures"), alert.alias("alert"))


def monitor(probes: DataFrame, threshold: int = 2, stream: bool = False, keep_days: int = 30, **options) -> DataFrame:
    """Each probe with the server's state after it and the alert it raises (or null)."""
    if not stream:
        return monitor_table(probes, threshold, **options)
    step = monitor_step(threshold, **options)
    state = "state string, failures long, alerted long"
    return over_stream(probes, "server", ["ts", "event_id"], step, ALERTS, state, keep_days * 86_400_000)


# T5: job states

JOB_STATE = "job_id string, event_id long, ts timestamp, status string, progress int, result_version int, error string"
_JOB = {"create": ("queued", 0), "claim": ("processing", 25), "save_text": ("completed", 100), "save_result": ("completed", 100), "fail": ("failed", 100)}


def job_step(state, row):
    """State: (status, progress, version, error, time and id of the newest event). Older events change nothing but the version."""
    status, progress, version, error, last_ts, last_id = state or ("queued", 0, 0, None, -1, -1)
    at = pd.Timestamp(row["ts"])
    if row["kind"] in ("save_text", "save_result", "save_html", "save_edit"):
        version += 1
    if (at.value, row["event_id"]) >= (last_ts, last_id):
        last_ts, last_id = at.value, row["event_id"]
        if row["kind"] in _JOB:
            status, progress = _JOB[row["kind"]]
            error = row["payload"] if row["kind"] == "fail" else None
    new = (status, progress, version, error, last_ts, last_id)
    changed = state is None or new[:4] != tuple(state[:4])
    return new, [(row["job_id"], row["event_id"], at, status, progress, version, error)] if changed else []


def job_table(events: DataFrame) -> DataFrame:
    """T5 over a table, by segmented scans: the last event that sets a status, and the number of saved versions so far."""
    order, kind = ["ts", "event_id"], F.col("kind")
    saved = kind.isin("save_text", "save_result", "save_html", "save_edit").cast("int")
    setting = F.when(kind.isin(*_JOB), F.struct("kind", F.when(kind == "fail", F.col("payload")).alias("error")))
    so_far = segmented(events.select("job_id", *order, "kind", "payload"), ["job_id"], order, sums={"version": saved}, lasts={"set": setting})

    def of(place: int, otherwise: Column) -> Column:
        out = otherwise
        for name, values in _JOB.items():
            out = F.when(F.col("set.kind") == name, F.lit(values[place])).otherwise(out)
        return out

    now = F.struct(of(0, F.lit("queued")).alias("status"), of(1, F.lit(0)).alias("progress"), F.col("version").cast("int").alias("result_version"), F.col("set.error").alias("error"))
    states = segmented(so_far.select("job_id", *order, now.alias("now")), ["job_id"], order, befores={"was": F.col("now")})
    return states.where(~F.col("now").eqNullSafe(F.col("was"))).select("job_id", "event_id", "ts", "now.*")


def job_state(events: DataFrame, stream: bool = False, keep_days: int = 30) -> DataFrame:
    """T5: a row whenever a job's state changes; the last one of a job is its state."""
    order = ["ts", "event_id"]
    if not stream:
        return job_table(events)
    state = "status string, progress int, version int, error string, last_ts long, last_id long"
    return over_stream(events, "job_id", order, job_step, JOB_STATE, state, keep_days * 86_400_000)


# The newest file before each message

#: A slot of a sender's time is so many times as long as files count.
SLOT_SPANS = 4
FOUND = "message string, sender string, us long, path string, media_us long"
_WAITING = pa.schema([("us", pa.int64()), ("is_file", pa.bool_()), ("name", pa.string())])


def newest_before(rows: pa.Table, upto: int, span: int) -> pa.Table:
    """(us, message, path, media_us) of each different message up to ``upto``: the newest file of the ``span`` before it, or nulls.

    One pass over rows of (us, is_file, name) in order; of files of one time the last path counts.
    """
    rows = rows.group_by(["us", "is_file", "name"]).aggregate([])
    rows = rows.take(pc.sort_indices(rows, [("us", "ascending"), ("is_file", "descending"), ("name", "ascending")]))
    us, is_file = rows.column("us").to_numpy(), rows.column("is_file").to_numpy()
    newest = np.maximum.accumulate(np.where(is_file, np.arange(len(us)), -1))
    asks = np.flatnonzero(~is_file & (us <= upto))
    found = newest[asks]
    none = (found < 0) | (us[found] < us[asks] - span)
    asking, media = rows.take(pa.array(asks)), rows.take(pa.array(found, mask=none))
    return pa.table({"us": asking["us"], "message": asking["name"], "path": media["name"], "media_us": media["us"]})


class RecentMedia(StatefulProcessor):
    """T6 in one slot of one sender: what comes in waits, packed, until the watermark has passed a message.

    A slot holds its own messages and files, and of those of the span before it the newest alone. Its state goes once the watermark
    has passed its end. A timer is set a millisecond before what it waits for, as it goes off when the watermark is behind it.
    """

    def __init__(self, span: int):
        self.span, self.length = span, SLOT_SPANS * span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begin, before, due = key[1], None, None
        for frame in rows:
            came = pa.Table.from_pandas(frame[_WAITING.names], _WAITING, preserve_index=False)
            own = pc.greater_equal(came["us"], begin)
            earlier = came.filter(pc.invert(own)).sort_by([("us", "descending"), ("name", "descending")]).slice(0, 1).to_pylist()
            before = max([*earlier, *([before] if before else [])], key=lambda r: (r["us"], r["name"].encode()), default=None)
            came = came.filter(own)
            asked = pc.min(came.filter(pc.invert(came["is_file"]))["us"]).as_py()
            due = asked if due is None else due if asked is None else min(due, asked)
            self._keep(came)
        self._keep(pa.Table.from_pylist([before] if before else [], _WAITING))
        self._wait(due, begin)
        return iter(())

    def _keep(self, rows: pa.Table) -> None:
        if len(rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            self.waiting.appendValue((sink.getvalue().to_pybytes(),))

    def _wait(self, due: int | None, begin: int) -> None:
        self.handle.registerTimer(-(-(begin + self.length if due is None else due) // 1000) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.concat_tables([pa.ipc.open_stream(packed).read_all() for (packed,) in self.waiting.get()])
        self.waiting.clear()
        if upto < key[1] + self.length:
            left = rows.filter(pc.or_(rows["is_file"], pc.greater(rows["us"], upto)))
            self._keep(left)
            self._wait(pc.min(left.filter(pc.invert(left["is_file"]))["us"]).as_py(), key[1])
        found = newest_before(rows, upto, self.span)
        if len(found):
            found = found.add_column(1, "sender", pa.array([key[0]] * len(found), pa.string()))
            yield found.select([c.split()[0] for c in FOUND.split(", ")]).to_pandas(integer_object_nulls=True)


def recent_media(both: DataFrame, span: int) -> DataFrame:
    """The newest file of the ``span`` (microseconds) before each message, once the watermark has passed it, as FOUND.

    ``both`` is a stream of messages and files with a watermark on ``ts``: sender, ts, us (its microseconds), is_file, name (an id or
    a path). The session's state store becomes RocksDB's.
    """
    both.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = lambda us: us - F.pmod(us, F.lit(SLOT_SPANS * span))
    us = F.col("us")
    slots = F.when(F.col("is_file"), F.array_distinct(F.array(begin(us), begin(us + span)))).otherwise(F.array(begin(us)))
    dealt = both.select("sender", F.explode(slots).alias("slot"), "ts", "us", "is_file", "name")
    return dealt.groupBy("sender", "slot").transformWithStateInPandas(RecentMedia(span), FOUND, "append", "eventTime")


# Expiry of idle terminal jobs

EXPIRED = "job_id string, status string"


def _last_status(state, row):
    status = _JOB.get(row["kind"], (state[0] if state else "queued",))[0]
    return (status,), []


def expire_stream(events: DataFrame, ttl_hours: int = 72) -> DataFrame:
    """A row when a completed or failed job has been idle for ``ttl_hours``; a new event starts the time anew."""
    idle = lambda ident, state: [(ident, state[0])] if state[0] in ("completed", "failed") else []
    return over_stream(events, "job_id", ["ts", "event_id"], _last_status, EXPIRED, "status string", ttl_hours * 3_600_000, idle)


def last_states(changes: DataFrame) -> DataFrame:
    """The last of each job's rows of :func:`job_state`."""
    return changes.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "result_version", "error"), F.struct("ts", "event_id", "result_version")).alias("s")
    ).select("job_id", "s.*")
