"""Mixing sources to target weights by weighted fair queueing.

Each source's share of the budget follows its weight, but never beyond ``max_epochs`` times what
the source holds; what a full source cannot take is shared among the others by weight. Documents
are shuffled within their source by a hash of their id. An entry is one epoch of one document; its
virtual finish time is its source's cumulative size up to and including it, divided by the
source's target. In the global order of finish times (then epoch, hash, id, size, hash of the text),
entries are taken while their running sum stays within the budget.

Rows with equal source, id and text are one lump with a count, and a lump is cut inside where the
budget ends in it. Sources are range-sorted by their own order, so a running sum is the total of the
ranges before and the place within the range; no window holds a whole source, nor all rows of one id.
Finish times grow along a source's own order, so what the mix takes of a source is a prefix of that
order: one cut a source describes the whole mix, and documents are held against it where they lie.
Entries that finish before the budget can end are taken as they are; only those around its end are
put in their global order.

Null texts have size 0, and a null source is a source of its own (last in order). Rows with a null id
share the empty id's place in the shuffle and are told apart by their texts; of rows that repeat in
id and text, as many are taken once more as the cut says. Very long texts are documents like any other:
a source misses its target by less than its next document. Sources without words get target 0 and are
not taken; other entries of size 0 go with the document before them. Reruns agree. An empty table gives
an empty mix. Columns other than id, text and source are ignored, or kept by :func:`mix_documents`
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, table, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Least entries of a cell of finish times; only the cell in which the budget ends is put in full order.
CELL_ROWS = 256
MOST_CELLS = 65_536
#: Copies of one row that a single output row is turned into at a time.
COPIES = 100_000
#: A source's own order.
OWN_ORDER = ("shuffled", "doc_id", "size", "content")
#: Entries with a smaller finish time are taken for sure: targets add up to the budget at finish time 1.
SURE = 1 - 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, largest, weight, target): one row per source; ``sizes`` has source, size and its count n.

    Water-filling in closed form: sources are ranked by cap over weight; the level is the first one
    at which the sources below it are at their caps and the rest share what is left. One row a source
    is all that meets in its windows.
    """
    per_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("largest"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = (
        per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1)))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy(F.lit(1))
    below = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    levels = ranked.withColumn("own_level", left / open_weight)
    level = F.min(F.when(F.col("own_level") <= F.col("ratio"), F.struct("ratio", "own_level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        "largest",
        "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(level["own_level"] * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _shuffled(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _place(id_col: str, text_col: str) -> tuple[Column, ...]:
    """A row's place in its source's order, by the names of ``OWN_ORDER``."""
    return _shuffled(F.col(id_col)), F.col(id_col), word_count(F.col(text_col)), F.xxhash64(text_col)


def _placed(docs: DataFrame, weights, max_epochs: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, shuffled, doc_id, size, content, n, source_size, largest, target, upto): one row a lump of ``n`` equal rows.

    ``upto`` is the cumulative size in the source's order, the lump included.
    """
    rows = require(docs, id_col, text_col, source_col)
    _, own_id, size, content = _place(id_col, text_col)
    lumps = durable(
        rows.select(F.col(source_col).alias("source"), own_id.alias("doc_id"), size.alias("size"), content.alias("content"))
        .groupBy("source", "doc_id", "size", "content")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranged = durable(
        lumps.withColumn("shuffled", _shuffled(F.col("doc_id")))
        .repartitionByRange("source", *OWN_ORDER)
        .withColumn("range", F.spark_partition_id())
    )
    mass = F.col("size") * F.col("n")
    totals = ranged.groupBy("source", "range").agg(F.sum(mass).alias("total"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    t = source_targets(lumps, weights, max_epochs).drop("weight").withColumnRenamed("source", "t_source")
    within = Window.partitionBy("source", "range").orderBy(*OWN_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        ranged.withColumn("inner_sum", F.sum(mass).over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
    )
    return durable(
        summed.select("source", *OWN_ORDER, "n", "source_size", "largest", "target", (F.col("offset") + F.col("inner_sum")).alias("upto"))
    )


def _lump_entries(placed: DataFrame, max_epochs: int) -> DataFrame:
    """``placed`` once for each epoch, with ``start``: its source's cumulative size before the lump."""
    last = F.least(F.lit(max_epochs - 1), F.floor(F.col("target") / F.col("source_size")).cast("int"))
    entries = placed.where(F.col("target") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    return entries.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size") * F.col("n"))


def _copies_upto(finish: float) -> Column:
    """How many of a lump's copies finish by then. Copies of size 0 finish together."""
    at = F.floor((F.lit(finish) * F.col("target") - F.col("start")) / F.col("size"))
    none = F.when(F.col("start") <= F.lit(finish) * F.col("target"), F.col("n")).otherwise(0)
    return F.when(F.col("size") == 0, none).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), at))).cast("long")


def _ends(entries: DataFrame) -> DataFrame:
    """(source, epoch, *OWN_ORDER, last): entries around the end of the budget that the mix takes, up to the copy ``last``."""
    bounds = entries.groupBy("source").agg(F.max("target").alias("t"), F.max("largest").alias("z")).agg(F.sum("t"), F.sum("z")).first()
    if bounds[0] is None:
        return None
    total, reach = bounds
    budget, last = int(total + 0.5), 1 + (reach + 2) / total
    split = entries.withColumn("sure", _copies_upto(SURE)).withColumn("most", _copies_upto(last))
    taken = split.agg(F.coalesce(F.sum(F.col("sure") * F.col("size")), F.lit(0))).first()[0]
    near = split.where("most > sure").select("source", "epoch", *OWN_ORDER, "target", "start", "sure", "most")
    # Copies of size 0 stay together: the last one stands for all.
    first = F.when(F.col("size") == 0, F.col("most")).otherwise(F.col("sure") + 1)
    copies = near.withColumn("last", F.explode(F.sequence(first, F.col("most"))))
    copies = durable(copies.select("source", "epoch", *OWN_ORDER, "last", ((F.col("start") + F.col("last") * F.col("size")) / F.col("target")).alias("finish")))
    n, lo, hi = copies.agg(F.count(F.lit(1)), F.min("finish"), F.max("finish")).first()
    if not n:
        return copies.drop("finish")
    cells = min(MOST_CELLS, -(-n // CELL_ROWS))
    width = (hi - lo) or 1.0
    ranged = copies.withColumn("cell", F.floor((F.col("finish") - F.lit(lo)) / F.lit(width) * F.lit(float(cells))))
    upto = F.sum("t").over(Window.orderBy("cell"))
    sums = ranged.groupBy("cell").agg(F.sum("size").alias("t")).select("cell", (upto - F.col("t") + F.lit(taken)).alias("before"), (upto + F.lit(taken)).alias("after"))
    at = sums.where(F.col("after") > budget).orderBy("cell").first()
    if at is None:
        return copies.drop("finish")
    in_order = Window.partitionBy("cell").orderBy("finish", "epoch", *OWN_ORDER, "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_cell = ranged.where(F.col("cell") == at["cell"]).withColumn("running", F.lit(at["before"]) + F.sum("size").over(in_order))
    kept = ranged.where(F.col("cell") < at["cell"]).unionByName(last_cell.where(F.col("running") <= budget).drop("running"))
    return kept.drop("finish", "cell")


def _cuts(placed: DataFrame, max_epochs: int) -> DataFrame:
    """(c_source, cut): the last entry that the mix takes of each source, as (epoch, *OWN_ORDER, last copy)."""
    entries = _lump_entries(placed, max_epochs)
    cut = F.struct("epoch", *OWN_ORDER, "last")
    sure = entries.withColumn("last", _copies_upto(SURE)).where("last > 0").select("source", cut.alias("cut"))
    ends = _ends(entries)
    everything = sure if ends is None else sure.unionByName(ends.select("source", cut.alias("cut")))
    return everything.groupBy(F.col("source").alias("c_source")).agg(F.max("cut").alias("cut"))


def _against(cut: Column, own: tuple[Column, ...]) -> Column:
    """-1, 0 or 1: whether a place lies before, at or after the cut. What comes after the hash is read for ties alone."""
    rest = F.struct(*(c.alias(n) for c, n in zip(own[1:], OWN_ORDER[1:])))
    limit = F.struct(*(cut[n].alias(n) for n in OWN_ORDER[1:]))
    tie = F.when(rest < limit, -1).when(rest == limit, 0).otherwise(1)
    return F.when(own[0] < cut["shuffled"], -1).when(own[0] > cut["shuffled"], 1).otherwise(tie)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs): one row per input row, with how often the mix takes it."""
    placed = _placed(docs, weights, max_epochs, id_col, text_col, source_col)
    cut = F.col("cut")
    j = placed.join(_cuts(placed, max_epochs), F.col("source").eqNullSafe(F.col("c_source")), "left").withColumn("at", _against(cut, tuple(map(F.col, OWN_ORDER))))
    more = F.when(F.col("at") < 0, F.col("n")).when(F.col("at") == 0, cut["last"]).otherwise(0)
    lumps = j.select(
        "doc_id", "source", "size", "source_size", "target", "n", F.coalesce(cut["epoch"], F.lit(0)).alias("epoch"), F.when(cut.isNull(), 0).otherwise(more).alias("more")
    )
    # Large lumps are spread over tasks before they become rows again.
    part = lumps.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    few, many = part.where(F.col("n") <= COPIES), part.where(F.col("n") > COPIES).repartition("doc_id", "source", "size", "part")
    copies = few.unionByName(many).withColumn(
        "copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least(F.col("n"), (F.col("part") + 1) * COPIES)))
    )
    epochs = (F.col("epoch") + (F.col("copy") <= F.col("more")).cast("int")).cast("int")
    return copies.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"))


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it. Texts stay where they are as long
    as Spark broadcasts the cuts, of which there is one a source. Rows that repeat the one at which a source is cut
    are numbered, over the ranges in which they lie, and the first of them are taken once more."""
    placed = _placed(docs, weights, max_epochs, id_col, text_col, source_col)
    cuts = durable(_cuts(placed, max_epochs))
    # The whole row goes into one column, so that no name of its own can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = (_shuffled(F.col(f"row.`{id_col}`")), F.col(f"row.`{id_col}`"), word_count(F.col(f"row.`{text_col}`")), F.xxhash64(F.col(f"row.`{text_col}`")))
    cut = F.col("cut")
    j = whole.join(cuts, F.col(f"row.`{source_col}`").eqNullSafe(F.col("c_source"))).withColumn("at", _against(cut, own))
    epoch = cut["epoch"]
    apart = j.where("at <> 0").select("row", (epoch + (F.col("at") < 0).cast("int")).cast("int").alias("times"))
    at_cut = durable(j.where("at = 0").select("row", "c_source", "cut", F.monotonically_increasing_id().alias("place")))
    slot = F.shiftright("place", 33)
    counts = at_cut.groupBy("c_source", slot.alias("slot")).agg(F.count(F.lit(1)).alias("t"))
    before = Window.partitionBy("c_source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("c_source").alias("o_source"), F.col("slot").alias("o_slot"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    numbered = at_cut.withColumn("slot", slot).withColumn("number", F.row_number().over(Window.partitionBy("c_source", "slot").orderBy("place")))
    numbered = numbered.join(offsets, F.col("c_source").eqNullSafe(F.col("o_source")) & (F.col("slot") == F.col("o_slot")))
    tied = numbered.select("row", (epoch + (F.col("offset") + F.col("number") <= cut["last"]).cast("int")).cast("int").alias("times"))
    copies = apart.unionByName(tied).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def mix_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, **columns) -> DataFrame:
    """The mix itself: (doc_id, epoch, finish), range-sorted by virtual finish time."""
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    placed = _placed(docs, weights, max_epochs, **names)
    cut = F.col("cut")
    entries = _lump_entries(placed, max_epochs).join(_cuts(placed, max_epochs), F.col("source").eqNullSafe(F.col("c_source")))
    at = _against(cut, tuple(map(F.col, OWN_ORDER)))
    last = F.when(F.col("epoch") < cut["epoch"], F.col("n")).when(F.col("epoch") > cut["epoch"], 0).when(at < 0, F.col("n")).when(at == 0, cut["last"]).otherwise(0)
    copies = entries.withColumn("of", last.cast("long")).where("of > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("of"))))
    taken = copies.withColumn("finish", (F.col("start") + F.col("copy") * F.col("size")) / F.col("target"))
    order = ("finish", "epoch", *OWN_ORDER)
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "epoch", "finish")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '')) as shuffled from documents),
p as (select source, sum(size)::bigint as source_size, count(*) as docs from d group by source),
w as (select *, [{", ".join(map(str, WEIGHTS))}][((row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} + 1)] as weight,
    source_size * {MAX_EPOCHS} as cap from p),
r as (select *, cap::double / weight as ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as own_level
    from r window b as (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding)),
v as (select min({{'ratio': ratio, 'own': own_level}}) filter (own_level <= ratio) as lv from l),
t as (select source, source_size, least(cap::double, coalesce((select lv.own from v) * weight, cap)) as target from l),
k as (select d.*, t.source_size, t.target, sum(d.size) over (partition by d.source order by shuffled, d.doc_id nulls first, d.size) as upto
    from d join t on d.source is not distinct from t.source),
e as (select *, unnest(range(0, 1 + least({MAX_EPOCHS - 1}, floor(target / source_size)::int))) as epoch from k where target > 0),
f as (select *, (epoch * source_size + upto)::double / target as finish from e),
g as (select rid, sum(size) over (order by finish, epoch, shuffled, doc_id nulls first, size) as running from f),
n as (select rid, count(*) as epochs from g where running <= (select floor(sum(target) + 0.5) from t) group by rid)
select k.doc_id, k.size, k.source_size, k.target, (coalesce(n.epochs, 0) * k.size)::bigint as taken from k left join n using (rid)"""
