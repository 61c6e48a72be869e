"""Running values of a key's rows in order, computed in ranges of time.

A window over a hot key is one task. Here a key's rows are cut into slots of time; each slot is summed up
into one row, a window over those few rows carries what came before, and rows only meet the rows of
their own slot. A key with a third of all rows is so spread over as many tasks as it has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import stored

DAY_S = 86_400


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def segmented(
    df: DataFrame,
    key: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    befores: dict[str, Column] | None = None,
    slot_s: int = DAY_S,
) -> DataFrame:
    """``df`` with running values by ``key`` in ``order``, whose first column is a time.

    ``sums``: sums up to the row, nulls as 0; ``lasts``: the last value that is not null, up to the row; ``befores``: the value of the
    row before, null for a key's first. Rows must differ in ``order`` within a key. Null keys are a key.
    """
    sums, lasts, befores = sums or {}, lasts or {}, befores or {}
    at = F.struct(*order)
    rows = df.withColumns(
        {"__slot": F.floor(_micros(order[0]) / (slot_s * 1_000_000))}
        | {f"__s_{n}": c for n, c in sums.items()}
        | {f"__l_{n}": c for n, c in lasts.items()}
        | {f"__b_{n}": c for n, c in befores.items()}
    )
    # An array tells a last row whose value is null from there being no row.
    whole = rows.groupBy(*key, "__slot").agg(
        *(F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums),
        *(F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), at)).alias(f"__l_{n}") for n in lasts),
        *(F.max_by(F.array(f"__b_{n}"), at).alias(f"__b_{n}") for n in befores),
        F.count(F.lit(1)).alias("__rows"),
    )
    earlier = Window.partitionBy(*key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(
        *(F.col(k).alias(f"__k_{i}") for i, k in enumerate(key)),
        F.col("__slot").alias("__k_slot"),
        *(F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__cs_{n}") for n in sums),
        *(F.last(f"__l_{n}", True).over(earlier).alias(f"__cl_{n}") for n in lasts),
        *(F.last(f"__b_{n}", True).over(earlier).alias(f"__cb_{n}") for n in befores),
    )
    same = F.col("__slot") == F.col("__k_slot")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    own = Window.partitionBy(*key, "__slot").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(carry, same).select(
        *df.columns,
        *((F.col(f"__cs_{n}") + F.coalesce(F.sum(f"__s_{n}").over(so_far), F.lit(0))).alias(n) for n in sums),
        *(F.coalesce(F.last(f"__l_{n}", True).over(so_far), F.col(f"__cl_{n}")).alias(n) for n in lasts),
        *(F.coalesce(F.lag(F.array(f"__b_{n}")).over(own), F.col(f"__cb_{n}"))[0].alias(n) for n in befores),
    )


def spaced_picks(rows: DataFrame, key: list[str], ts: str, gap_s: float, start: str) -> DataFrame:
    """(key, at) in microseconds: the rows picked when each pick is the first at least ``gap_s`` after the one before.

    Rows where ``start`` is true begin a chain, one for each key, and are picks. Of rows at one time one is picked.

    Every row points at the pick that would follow it; pointers are followed two, four, eight steps at a time, so a
    chain of n picks needs log n joins, whose rows are spread by key and time. Rows meet only those of the gap-long
    slot that their successor falls into; where that has none, a window over slots finds the next that has.
    """
    gap = int(gap_s * 1_000_000)
    base = rows.select(*key, _micros(ts).alias("at"), F.col(start).alias("start")).groupBy(*key, "at").agg(F.max("start").alias("start"))
    base = stored(base.withColumn("slot", F.floor(F.col("at") / gap)), "picks")
    seek = base.select(*key, (F.col("slot") + 1).alias("slot"), (F.col("at") + gap).alias("place"), F.col("at").alias("origin"), F.lit(None).cast("long").alias("here"))
    have = base.where(~F.col("start")).select(*key, "slot", F.col("at").alias("place"), F.lit(None).cast("long").alias("origin"), F.col("at").alias("here"))
    down = Window.partitionBy(*key, "slot").orderBy(F.desc("place"), F.asc_nulls_first("origin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = have.unionByName(seek)
    firsts = marks.groupBy(*key, "slot").agg(F.min("here").alias("first"))
    later = Window.partitionBy(*key).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(key)), F.col("slot").alias("__slot"), F.min("first").over(later).alias("beyond"))
    same = F.col("slot") == F.col("__slot")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    pointers = (
        marks.withColumn("found", F.min("here").over(down))
        .where("origin is not null")
        .join(after, same)
        .select(*key, F.col("origin").alias("at"), F.coalesce("found", "beyond").alias("next"))
        .where("next is not null")
    )
    pointers, picked = stored(pointers, "picks"), base.where("start").select(*key, "at")
    while True:
        hop = pointers.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(key)), F.col("at").alias("__at"), F.col("next").alias("__next"))
        meet = lambda left: [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(key)] + [F.col(left) == F.col("__at")]
        reached = stored(picked.join(hop, meet("at")).select(*key, F.col("__next").alias("at")), "picks")
        if reached.isEmpty():
            return picked
        picked = stored(picked.unionByName(reached).distinct(), "picks")
        pointers = stored(pointers.join(hop, meet("next")).select(*key, "at", F.col("__next").alias("next")), "picks")
