"""Scores of conversion engines, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("nid", "teds", "mhs")
#: Verdict codes of the three parts of a commentary, from the best band to the worst.
ORDER_VERDICTS = ("order_stable", "order_mostly_stable", "order_unstable")
TABLE_VERDICTS = ("table_not_scored", "table_strong", "table_partial", "table_weak")
HEADING_VERDICTS = ("heading_kept", "heading_partial", "heading_lost")


def overall_score(*metrics: Column) -> Column:
    """A1: the mean of those that are not null; null if none is."""
    total, n = F.lit(0.0), F.lit(0)
    for m in metrics:
        total = total + F.coalesce(m, F.lit(0.0))
        n = n + m.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def score_band(overall: Column, strong: float = 0.6, mixed: float = 0.45) -> Column:
    """Strong, mixed or weak."""
    return F.when(overall >= strong, "strong").when(overall >= mixed, "mixed").otherwise("weak")


def metric_commentary(nid: Column, teds: Column, mhs: Column) -> Column:
    """A verdict on reading order, tables and headings; a null order or heading score counts as 0."""
    n, m = F.coalesce(nid, F.lit(0.0)), F.coalesce(mhs, F.lit(0.0))
    a, t, h = ORDER_VERDICTS, TABLE_VERDICTS, HEADING_VERDICTS
    return F.array(
        F.when(n >= 0.9, a[0]).when(n >= 0.8, a[1]).otherwise(a[2]),
        F.when(teds.isNull(), t[0]).when(teds >= 0.75, t[1]).when(teds >= 0.4, t[2]).otherwise(t[3]),
        F.when(m >= 0.3, h[0]).when(m > 0, h[1]).otherwise(h[2]),
    )


def assess_result(results: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The first rule of each result's engine whose metric passes its threshold.

    ``results`` has ``keys``, engine, status and a map ``metrics``; ``rules`` has engine, rank, metric,
    at_least, below and verdict (a null metric always passes, a null bound is open). Results that
    are not available get ``not_assessed``.
    """
    value = F.col("metrics")[F.col("metric")]
    passes = F.col("metric").isNull() | (
        (F.col("at_least").isNull() | (value >= F.col("at_least"))) & (F.col("below").isNull() | (value < F.col("below")))
    )
    first = Window.partitionBy(*keys, "engine").orderBy("rank")
    ranked = (
        results.join(rules, "engine", "left")
        .where((F.col("status") != "available") | F.col("rank").isNull() | F.coalesce(passes, F.lit(False)))
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
    )
    verdict = F.when(F.col("status") != "available", "not_assessed").otherwise(F.coalesce("verdict", F.lit("check_structure")))
    return ranked.select(*keys, "engine", verdict.alias("verdict"))
