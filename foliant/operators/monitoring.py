"""Servers, tunnels and quotas over batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def probe_transitions(probes: DataFrame, threshold: int = 2) -> DataFrame:
    """Probes with the failures so far, the state, and the transition they make (or null).

    A failure's number in its run tells everything, so no state is carried: the first makes a server
    degraded, the one at the threshold down, and the first success after any recovers it.
    """
    w = Window.partitionBy("server").orderBy("ts", "event_id")
    runs = probes.withColumn("run", F.count_if("ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("server", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumn("consecutive_failures", F.count_if(~F.col("ok")).over(in_run))
    k = F.col("consecutive_failures")
    failed_before = F.coalesce(~F.lag("ok").over(w), F.lit(False))
    state = F.when(F.col("ok"), "up").when(k >= threshold, "down").otherwise("degraded")
    change = (
        F.when(F.col("ok") & failed_before, "recovered").when(~F.col("ok") & (k == threshold), "down")
        .when(~F.col("ok") & (k == 1) & F.lit(threshold > 1), "degraded")
    )
    return counted.withColumn("state", state).withColumn("transition", change).drop("run")


def server_status(probes: DataFrame, primary: str) -> DataFrame:
    """One row over each server's last probe: is the primary healthy, who is, who could take over."""
    last = probes.groupBy("server").agg(F.max_by("ok", F.struct("ts", "event_id")).alias("ok"))
    ok = F.col("ok")
    healthy = F.array_sort(F.collect_list(F.when(ok, F.col("server"))))  # one entry per server of the fleet
    a = last.agg(
        F.coalesce(F.bool_or((F.col("server") == primary) & ok), F.lit(False)).alias("primary_healthy"),
        healthy.alias("healthy"),
        F.bool_or(ok).alias("any_ok"), F.bool_and(ok).alias("all_ok"),
    )
    fallback = F.filter("healthy", lambda s: s != primary)
    return a.select(
        "primary_healthy",
        F.array_join("healthy", ",").alias("healthy"),
        F.array_join(fallback, ",").alias("fallback"),
        (F.col("any_ok") & ~F.col("all_ok")).alias("mismatch"),
        F.when(F.col("primary_healthy"), primary).otherwise(F.get(fallback, F.lit(0))).alias("recommended"),
    )


def connector_health(connectors: DataFrame) -> DataFrame:
    """Per tunnel the newest connector stays, all others are stale."""
    newest = F.max(F.struct("created", "connector_id"))
    a = connectors.groupBy("tunnel").agg(F.count(F.lit(1)).alias("total"), newest.alias("n"))
    return a.select("tunnel", F.col("n.connector_id").alias("kept"), "total", (F.col("total") - 1).alias("stale"), F.lit(1).cast("long").alias("healthy"))


def over_quota(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Requests for which their key has more than ``limit`` in the ``seconds`` up to them, denied ones included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("__at").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return requests.withColumn("__at", at).withColumn("in_window", F.count(F.lit(1)).over(w)).drop("__at").where(F.col("in_window") > limit)
