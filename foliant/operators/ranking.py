"""Engine scores over a corpus: means, boards, best and worst documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.scores import overall_score

ALL_SCORES = ("overall", "nid", "nid_s", "teds", "teds_s", "mhs", "mhs_s")


def with_overall(scores: DataFrame) -> DataFrame:
    """A1 over rows."""
    return scores.withColumn("overall", overall_score(F.col("nid"), F.col("teds"), F.col("mhs")))


def corpus_metrics(scores: DataFrame, metrics: tuple[str, ...] = ALL_SCORES) -> DataFrame:
    """A2: per engine the means of what is scored, how many are, and what is missing or over budget."""
    present = [m for m in metrics if m in scores.columns]
    aggs = [F.avg(m).alias(f"{m}_mean") for m in present]
    aggs += [F.count(m).alias(f"{m}_count") for m in ("nid", "teds", "mhs")]
    if "prediction_available" in scores.columns:
        aggs.append(F.count_if(~F.col("prediction_available")).alias("missing_predictions"))
    if "table_timed_out" in scores.columns:
        aggs.append(F.count_if("table_timed_out").alias("table_timeouts"))
    return scores.groupBy("engine").agg(F.count(F.lit(1)).alias("documents"), *aggs)


def run_summary(runs: DataFrame) -> DataFrame:
    """A3: per engine successes, total seconds and seconds per document (0 without any)."""
    a = runs.groupBy("engine").agg(F.count_if("succeeded").alias("document_count"), F.sum("elapsed").alias("total_elapsed"))
    return a.withColumn("elapsed_per_doc", F.when(F.col("document_count") == 0, 0.0).otherwise(F.col("total_elapsed") / F.col("document_count")))


def leaderboard(metrics: DataFrame, about: DataFrame) -> DataFrame:
    """A4: engines with what is known of them; the published speed if the row has one, else the measured.

    ``about`` is a dimension of one row per engine: (engine, label, has_speed, speed)."""
    j = metrics.join(about, "engine", "left")
    speed = F.when(F.coalesce("has_speed", F.lit(False)), F.col("speed")).otherwise(F.col("elapsed_per_doc"))
    return j.select("engine", F.coalesce("label", "engine").alias("label"), "overall_mean", speed.alias("speed")).orderBy(
        F.desc_nulls_last("overall_mean"), "engine"
    )


def corpus_counts(documents: DataFrame, truths: DataFrame, failures: DataFrame) -> DataFrame:
    """A5: one row of three counts."""
    parts = [d.select(F.lit(n).alias("what")) for n, d in (("documents", documents), ("ground_truths", truths), ("failures", failures))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.agg(*(F.count_if(F.col("what") == n).alias(n) for n in ("documents", "ground_truths", "failures")))


def extremes(scores: DataFrame, n: int, best: bool, key: str = "overall", ident: str = "document_id") -> DataFrame:
    """K1, K2, K9: ``n`` rows by ``key``, nulls left out; ties keep the order of ids in both directions."""
    return scores.where(F.col(key).isNotNull()).orderBy(F.desc(key) if best else F.asc(key), ident).limit(n)


def largest_differences(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """K3: documents that both engines have, by absolute difference; a null score counts as 0."""
    j = a.select("document_id", F.coalesce("overall", F.lit(0.0)).alias("x")).join(b.select("document_id", F.coalesce("overall", F.lit(0.0)).alias("y")), "document_id")
    return j.withColumn("difference", F.abs(F.col("x") - F.col("y"))).orderBy(F.desc("difference"), "document_id").limit(n)


def choose_examples(deltas: DataFrame, by_delta: int = 4, by_best: int = 2, total: int = 6) -> DataFrame:
    """K4: the largest differences, then each engine's best, without repeats; the first ``total``."""
    lists = [("delta", F.abs("delta"), by_delta), ("a_overall", F.col("a_overall"), by_best), ("b_overall", F.col("b_overall"), by_best)]
    ranked = None
    for k, (_, key, n) in enumerate(lists):
        top = deltas.withColumn("__k", key).where("__k is not null").orderBy(F.desc("__k"), "document_id").limit(n)
        rows = top.select("document_id", F.lit(k).alias("list"), F.row_number().over(Window.orderBy(F.desc("__k"), "document_id")).alias("rank"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    once = ranked.groupBy("document_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    place = F.row_number().over(Window.orderBy("at", "document_id"))
    return once.orderBy("at", "document_id").limit(total).withColumn("place", place).select("place", "document_id")


def ends(scores: DataFrame, n: int = 3) -> DataFrame:
    """K8: the first and the last ``n`` of the ranking; with fewer rows the two overlap."""
    first = scores.orderBy(F.desc("overall"), "document_id").limit(n).select(F.lit("top").alias("side"), "document_id", "overall")
    last = scores.orderBy(F.asc("overall"), F.desc("document_id")).limit(n).select(F.lit("bottom").alias("side"), "document_id", "overall")
    return first.unionByName(last)


def common_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that both have."""
    return a.select("document_id").intersect(b.select("document_id"))


def all_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that either has."""
    return a.select("document_id").union(b.select("document_id")).distinct()
