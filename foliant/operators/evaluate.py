"""Texts against ground truth: reading order, tables, headings and differences, set by set.

A Dice score of two multisets is twice their common size over the sum of their sizes; two empty ones
score 1, one empty one 0. An absent prediction is the empty text and scores like it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.lines import lines_of, paragraph_units

KEYS = ("engine", "doc_id")
HEADING = re.compile(rb"#{1,6}\s+\S")


def _both(pairs: DataFrame) -> DataFrame:
    """(engine, doc_id, side, pos, line): lines of either side, 1 the truth and 2 the prediction."""
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("truth").alias("text")), F.struct(F.lit(2).alias("side"), F.col("prediction").alias("text")))
    return lines_of(pairs.select(*KEYS, F.explode(sides).alias("s")).select(*KEYS, "s.side", "s.text"), *KEYS, "side")


def _dice(a: Counter, b: Counter) -> float | None:
    n = a.total() + b.total()
    return 2 * sum(min(k, b[x]) for x, k in a.items() if x in b) / n if n else None


def _counted(text: bytes) -> tuple[Counter, dict[bytes, int], Counter, Counter, Counter, Counter]:
    """What is counted of a text: tokens, places of lines that occur once, cells and shapes of table rows, headings and their levels."""
    at: dict[bytes, int] = {}
    cells, shapes, heads, levels = [], [], [], []
    for i, line in enumerate(text.split(b"\n") if text else []):
        line = line.strip(b" ")
        if not line:
            continue
        at[line] = -1 if line in at else i
        if line.startswith(b"|"):
            row = line[1:].removesuffix(b"|").split(b"|")
            shapes.append(len(row))
            cells.extend((len(row), c.strip(b" ")) for c in row)
        elif HEADING.match(line):
            bare = line.lstrip(b"#")
            levels.append(len(line) - len(bare))
            heads.append((levels[-1], bare.strip(b" ")))
    # bytes.split cuts at the six ASCII white-space characters.
    return Counter(text.split()), {x: i for x, i in at.items() if i >= 0}, Counter(cells), Counter(shapes), Counter(heads), Counter(levels)


def _order(a: dict[bytes, int], b: dict[bytes, int]) -> float | None:
    """Of lines that occur once in either text, in the order of the first, the share of neighbours that the second keeps in order."""
    places = [b[x] for x in a if x in b]
    return sum(q > p for p, q in zip(places, places[1:])) / (len(places) - 1) if len(places) > 1 else None


def _score(truth: str | None, prediction: str | None) -> tuple:
    a, b = (_counted((t or "").encode("utf-8", "surrogatepass")) for t in (truth, prediction))
    table, heading = bool(a[2]), bool(a[4])
    return (
        _dice(a[0], b[0]), _order(a[1], b[1]), a[2].total(), b[2].total(),
        _dice(a[2], b[2]) if table else None, _dice(a[3], b[3]) if table else None,
        _dice(a[4], b[4]) if heading else None, _dice(a[5], b[5]) if heading else None,
    )


_SCORES = {"tokens": "double", "order": "double", "cells": "long", "cells_2": "long", "table": "double", "table_s": "double", "heading": "double", "heading_s": "double"}


def _score_rows(kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                scores = zip(*(_score(t, p) for t, p in zip(batch.column("truth").to_pylist(), batch.column("prediction").to_pylist())))
                columns = [pa.array(v, pa.int64() if d == "long" else pa.float64()) for v, d in zip(scores, _SCORES.values())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *columns], [*batch.schema.names[:kept], *_SCORES])

    return run


def _scored(pairs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, more, scores) of each row of (keys, more, truth, prediction); ``cells`` and ``cells_2`` are how many either side has."""
    rows = pairs.select(*KEYS, *more, "truth", "prediction")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(_score_rows(len(KEYS) + len(more)), kept + "".join(f", `{c}` {d}" for c, d in _SCORES.items()))


def _unix(pairs: DataFrame) -> DataFrame:
    """The pairs with lines that end in a line feed alone."""
    return pairs.withColumns({c: F.replace(c, F.lit("\r\n"), F.lit("\n")) for c in ("truth", "prediction")})


def reading_order_score(pairs: DataFrame) -> DataFrame:
    """(engine, doc_id, tokens, order): Dice of the tokens, and among lines that occur once in either text
    the share of neighbours (in the truth's order) that the prediction keeps in order. Null without such pairs."""
    return _scored(_unix(pairs)).select(*KEYS, F.coalesce("tokens", F.lit(1.0)).alias("tokens"), "order")


def table_score(pairs: DataFrame, max_cells: int | None = None) -> DataFrame:
    """(engine, doc_id, table, table_s, table_timed_out): Dice of (row shape, cell), and of row shapes alone.

    Null where the truth has no table, and where either side has more than ``max_cells`` cells.
    """
    has, over = F.col("cells") > 0, F.greatest("cells", "cells_2") > F.lit(max_cells if max_cells is not None else 2**31 - 1)
    keep = lambda c: F.when(has & ~over, F.col(c)).alias(c)
    return _scored(_unix(pairs)).select(*KEYS, keep("table"), keep("table_s"), (has & over).alias("table_timed_out"))


def heading_score(pairs: DataFrame) -> DataFrame:
    """(engine, doc_id, heading, heading_s): Dice of (level, text) and of levels; null where the truth has none."""
    return _scored(_unix(pairs)).select(*KEYS, "heading", "heading_s")


def pair_all(truth: DataFrame, predictions: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """J1 for many engines: every truth with every engine's prediction."""
    every = truth.select("doc_id", F.col("text").alias("truth"), F.explode(F.array(*(F.lit(e) for e in engines))).alias("engine"))
    p = predictions.select("engine", "doc_id", F.col("text").alias("prediction"), F.lit(True).alias("prediction_available"))
    return every.join(p, ["engine", "doc_id"], "left").fillna({"prediction": "", "prediction_available": False})


def evaluate_corpus(truth: DataFrame, predictions: DataFrame, engines: tuple[str, ...], max_cells: int | None = None) -> DataFrame:
    """E5: every document's scores for every engine; ``overall`` is the mean of what is scored.

    One join pairs the texts; each pair is scored in its row, so nothing that is counted is shuffled or sorted.
    """
    from foliant.functions.scores import overall_score

    scores = _scored(pair_all(truth, predictions, engines), ("prediction_available",))
    has, over = F.col("cells") > 0, F.greatest("cells", "cells_2") > F.lit(max_cells if max_cells is not None else 2**31 - 1)
    kept = lambda c: F.when(has & ~over, F.col(c)).alias(c)
    out = scores.select(
        *KEYS, "prediction_available", F.coalesce("tokens", F.lit(1.0)).alias("tokens"), "order",
        kept("table"), kept("table_s"), (has & over).alias("table_timed_out"), "heading", "heading_s",
    )
    return out.withColumn("overall", overall_score(F.col("tokens"), F.col("table"), F.col("heading")))


def corpus_diff(pairs: DataFrame) -> DataFrame:
    """(engine, doc_id, section, k, kind, before, after): what was removed, added or changed, section by section.

    Units that a section has equally often on both sides cancel. What is left is paired in order within its
    section: a removed and an added unit of the same number are one change. Units that only moved within a
    section are not reported.
    """
    units = paragraph_units(_both(pairs), *KEYS, "side")
    nth = Window.partitionBy(*KEYS, "side", "section", "text").orderBy("unit")
    numbered = units.withColumn("n", F.row_number().over(nth))
    left = numbered.groupBy(*KEYS, "section", "text", "n").agg(F.count(F.lit(1)).alias("sides"), F.min("side").alias("side"), F.min("unit").alias("unit")).where("sides = 1")
    place = Window.partitionBy(*KEYS, "side", "section").orderBy("unit")
    rest = left.withColumn("k", F.row_number().over(place))
    met = rest.groupBy(*KEYS, "section", "k").agg(
        F.max(F.when(F.col("side") == 1, F.col("text"))).alias("before"), F.max(F.when(F.col("side") == 2, F.col("text"))).alias("after")
    )
    kind = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("changed")
    return met.select(*KEYS, "section", "k", kind.alias("kind"), "before", "after")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Per document what was added, removed and changed, and in how many sections."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return diff.groupBy(*KEYS).agg(count("added"), count("removed"), count("changed"), F.count_distinct("section").alias("sections"))


def changed_words(before: Column, after: Column) -> Column:
    """How many positions differ between the words of two texts."""
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    zipped = F.zip_with(words(before), words(after), lambda a, b: (~a.eqNullSafe(b)).cast("int"))
    return F.aggregate(zipped, F.lit(0), lambda acc, x: acc + x)


def document_header(title: Column, source: Column, department: Column, at: Column, links: Column) -> Column:
    """Title, what is known of the document, and its attachments as list lines; absent parts are left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {label}: "), c))
    files = F.transform(links, lambda a: F.concat(F.lit("  - ["), a["file_name"], F.lit("]("), a["file_url"], F.lit(")")))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), line("source", source), line("department", department), line("time", at), files)
