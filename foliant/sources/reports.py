"""Reports: JSON payloads and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(df: DataFrame, name: str) -> Column:
    """A value as a table cell: n/a for null, four decimals for a double."""
    c = F.col(name)
    text = F.format_string("%.4f", c) if df.schema[name].dataType.simpleString() in ("double", "float") else c.cast("string")
    return F.when(c.isNull(), "n/a").otherwise(text)


def markdown_cells(df: DataFrame, *columns: str) -> Column:
    """A row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(df, c) for c in columns)), F.lit(" |"))


def markdown_table(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the whole table as text, for reports of a bounded number of rows such as one per engine."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    rows = F.array_sort(F.collect_list(markdown_cells(df, *columns)))
    return df.agg(F.concat_ws("\n", F.lit(head), rows).alias("markdown"))


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """The rows as JSON lines, or as one Markdown table."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        markdown_table(df, *df.columns).write.mode("overwrite").text(path)
