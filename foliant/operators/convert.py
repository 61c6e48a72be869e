"""Pluggable steps: converters over a corpus, and named stages whose rows land in one report."""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "doc_id string, engine string, status string, text string, html string, error string, elapsed double, quarantined boolean"

Converter = Callable[[bytes], str | tuple[str, str]]


def _serve(pipe, converter: Converter) -> None:
    """A child's life: one document after another, until its parent goes."""
    while True:
        content = pipe.recv()
        try:
            got = converter(content)
            pipe.send((None, *(got if isinstance(got, tuple) else (got, got))))
        except Exception as e:  # a converter is the user's; whatever it raises is that document's result
            pipe.send((f"{type(e).__name__}: {e}", None, None))


class _Child:
    """A converter in a process of its own, so that one that hangs or ends its process takes nothing along."""

    def __init__(self, converter: Converter):
        self.converter, self.process = converter, None

    def ask(self, content: bytes, deadline_s: float) -> tuple[str | None, str | None, str | None, bool]:
        """(error, text, html, whether the document is to be kept away from converters)."""
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.process = context.Process(target=_serve, args=(theirs, self.converter), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.pipe.send(content)
            if self.pipe.poll(deadline_s):
                return (*self.pipe.recv(), False)
            error = f"TimeoutError: no answer within {deadline_s:g} s"
        except (EOFError, OSError):
            self.process.join(1)
            error = f"ProcessEnded: exit code {self.process.exitcode}"
        self.end()
        return error, None, None, True

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def convert_corpus(docs: DataFrame, engine: str, converter: Converter | None, deadline_s: float = 60, quarantine: DataFrame | None = None) -> DataFrame:
    """``converter`` over (doc_id, content); a failure becomes a row with its error and never ends the run.

    A converter gives text, or (text, html). Status: available, failed, missing_input, or missing_tool where
    there is no converter. Each task has one child process that converts; where it gives no answer within ``deadline_s`` or
    ends, that document failed and is marked as quarantined, and the next one gets a new child. Documents of ``quarantine``
    (doc_id, of earlier runs) are not tried again.
    """
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    if quarantine is None:
        known = known.withColumn("kept_away", F.lit(False))
    else:
        bad = quarantine.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("kept_away")).distinct()
        known = known.join(bad, "doc_id", "left").na.fill(False, ["kept_away"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = _Child(converter)

        def one(content, kept_away: bool) -> tuple:
            if converter is None:
                return "missing_tool", None, None, None, 0.0, False
            if content is None or not len(content):
                return "missing_input", None, None, None, 0.0, False
            if kept_away:
                return "failed", None, None, "quarantined", 0.0, True
            began = time.perf_counter()
            error, text, html, quarantined = child.ask(bytes(content), deadline_s)
            return "failed" if error else "available", text, html, error, time.perf_counter() - began, quarantined

        try:
            for batch in batches:
                rows = [(d, engine, *one(c, k)) for d, c, k in zip(batch["doc_id"], batch["content"], batch["kept_away"])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        finally:
            child.end()

    return known.mapInPandas(run, OUT)


def run_stages(df: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(stage, payload): each stage's rows as JSON in one table."""
    report = None
    for name, stage in stages.items():
        rows = stage(df).select(F.lit(name).alias("stage"), F.to_json(F.struct("*")).alias("payload"))
        report = rows if report is None else report.unionByName(rows)
    return report
