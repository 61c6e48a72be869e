"""HTML pages to Markdown, with nested lists and tables, without a parser and without Python.

A page is cut at its block tags into pieces, in order. What a piece is in follows from running sums over the page: list and
table depth are opening less closing tags, and rows, cells and items are counts of openings. Text behind an inner block so goes
back to the item or cell around it. Cells are joined to rows, rows to tables, and all to one text; each step groups by the
page first, so that a page is shuffled once. One page is one task's work, whatever their number.

Only texts in headings, paragraphs, items and cells are written. Repeated pages each give a row. A null or empty page, or one
without blocks, gives none. Tables within cells are read as text of the outer cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.titles import normalize_title

#: Elements at which a page is cut.
TAGS = r"(?i)<(/?)(h[1-6]|p|li|th|td|tr|table|ul|ol|div|article|section|nav|footer|header|body)\b([^>]*)>"
#: Columns that one cell may span, by the HTML standard.
WIDEST = 1000


@dataclass(frozen=True)
class Rules:
    """Word lists of a publisher. Indents are in points, at which a paragraph or bullet goes one level in."""

    labels: tuple[str, ...] = ()  # a table or paragraph of this text alone: dropped as a table, a title as a paragraph
    dropped: tuple[str, ...] = ()  # short paragraphs with one of these are left out
    bold: tuple[str, ...] = ()  # paragraphs that begin so are in bold
    appendix: tuple[str, ...] = ()  # paragraphs and tables that begin so are sections
    contacts: tuple[str, ...] = ()  # tables that begin so list contacts
    agenda: tuple[str, ...] = ()  # tables whose first cell this is list an agenda
    indents: tuple[float, float] = (24, 50)
    large: float = 20  # points from which centred text is a heading


def _begins(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.startswith(text, F.lit(w))
    return out


def _points(style: Column, key: str) -> Column:
    return F.coalesce(F.regexp_extract(style, rf"(?i){key}\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)pt", 1).try_cast("double"), F.lit(0.0))


def _indent(style: Column, rules: Rules) -> Column:
    left, first = _points(style, "margin-left"), _points(style, "text-indent")
    whole = F.greatest(left + F.least(first, F.lit(0.0)), left)
    return F.when(whole >= rules.indents[1], 2).when(whole >= rules.indents[0], 1).otherwise(0)


def _spaces(level: Column) -> Column:
    return F.repeat(F.lit("  "), level.cast("int"))


def _paragraph(text: Column, style: Column, rules: Rules) -> Column:
    """A paragraph's line; null where it is left out. The first rule that fits."""
    level, n = _indent(style, rules), F.length(text)
    section = F.concat(F.lit("## "), text)
    within = lambda a, b: F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)) & (n > 1)
    centred = F.lower(style).rlike(r"text-align\s*:\s*center")
    out = F.when(F.lit(False), "")
    for word in rules.dropped:
        out = out.when(F.contains(text, F.lit(word)) & (n < 80), F.lit(None))
    return (
        out.when(text.isin(*rules.labels) if rules.labels else F.lit(False), F.concat(F.lit("# "), text))
        .when(_begins(text, rules.bold), F.concat(F.lit("**"), text, F.lit("**")))
        .when(within("[", "]"), section)
        .when(_begins(text, rules.appendix), section)
        .when(within("<", ">"), F.concat(F.lit("## "), F.trim(F.substr(text, F.lit(2), n - 2))))
        .when(_begins(text, rules.contacts), F.concat(F.lit("## "), text))
        .when(F.startswith(text, F.lit("- ")), F.concat(_spaces(level), F.lit("- "), F.trim(F.substr(text, F.lit(3)))))
        .when(centred & (_points(style, "font-size") >= rules.large), section)
        .when(centred, text)
        .otherwise(F.concat(_spaces(level), text))
    )


def _filled(rows: Column) -> Column:
    """Texts by row and column: a cell stands in every place that it spans. ``rows``: arrays of (text, columns, rows)."""
    empty = F.array().cast("array<struct<left:int,text:string>>")

    def lay(state: Column, row: Column) -> Column:
        over = state["over"]
        cells = F.flatten(F.transform(row, lambda c: F.array_repeat(F.struct((c["rows"] - 1).alias("left"), c["text"].alias("text")), c["columns"])))
        taken = lambda upto: F.size(F.filter(F.slice(over, 1, upto), lambda o: o["left"] > 0))
        width = F.greatest(F.size(over), F.size(cells) + taken(F.size(over)))

        def at(c: Column) -> Column:
            held = F.get(over, c)
            free = F.get(cells, c - F.when(c > 0, taken(c)).otherwise(0))
            return F.when(F.coalesce(held["left"], F.lit(0)) > 0, F.struct((held["left"] - 1).alias("left"), held["text"].alias("text"))).otherwise(
                F.struct(F.coalesce(free["left"], F.lit(0)).alias("left"), F.coalesce(free["text"], F.lit("")).alias("text"))
            )

        now = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), at)).otherwise(empty)
        return F.struct(now.alias("over"), F.concat(state["out"], F.array(F.transform(now, lambda x: x["text"]))).alias("out"))

    laid = F.aggregate(rows, F.struct(empty.alias("over"), F.array().cast("array<array<string>>").alias("out")), lay)["out"]
    spans = F.exists(rows, lambda r: F.exists(r, lambda c: (c["columns"] > 1) | (c["rows"] > 1)))
    return F.when(spans, laid).otherwise(F.transform(rows, lambda r: F.transform(r, lambda c: c["text"])))


def _tables(units: DataFrame, rules: Rules) -> DataFrame:
    """``units`` with ``table``: a table's lines by its kind (dropped label, section, list, contacts, agenda or grid) from its ``grid``.

    What is used more than once is a column of its own, else it would be computed again at each use, and for each row of a grid.
    """
    rows, is_table = F.col("grid"), F.col("in_cell")
    full = F.filter(F.transform(rows, lambda r: F.filter(F.transform(r, lambda c: c["text"]), lambda t: t != "")), lambda r: F.size(r) > 0)
    parts = F.col("parts")
    first, rest = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    top = F.coalesce(F.get(F.get(rows, F.lit(0)), F.lit(0))["text"], F.lit(""))
    head = F.get(first, F.lit(0))
    section = lambda text: F.array(F.concat(F.lit("## "), text))
    dashed = F.forall(rest, lambda r: F.startswith(r[0], F.lit("-")))
    bullet = lambda text: F.concat(F.lit("- "), F.trim(F.regexp_replace(text, "^-+", "")))
    single = F.forall(parts, lambda r: F.size(r) == 1)
    label = head.isin(*rules.labels) if rules.labels else F.lit(False)

    def contact(r: Column) -> Column:
        two = lambda i: F.concat(r[i], F.lit(" / "), r[i + 1], F.lit(" "), r[i + 2])
        start = F.concat(F.lit("- "), r[0], F.lit(": "))
        return (
            F.when(F.size(r) >= 6, F.concat(start, two(1), F.lit(" "), r[4], F.lit(" / "), r[5]))
            .when(F.size(r) >= 4, F.concat(start, two(1)))
            .otherwise(F.concat(F.lit("- "), F.array_join(r, " / ")))
        )

    def item(r: Column) -> Column:
        full = F.array(F.concat(F.lit("- "), r[0]), F.concat(F.lit("  - "), r[1]), F.concat(F.lit("  - "), r[2], F.lit(" / "), r[3]))
        return F.when(F.size(r) >= 4, full).otherwise(F.array(F.concat(F.lit("- "), F.array_join(r, " / "))))

    filled, width = F.col("filled"), F.col("width")
    laid = F.filter(_filled(rows), lambda r: F.exists(r, lambda t: t != ""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(filled, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    lines = F.col("padded")
    grid = F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))))
    kinds = (
        (F.size(parts) == 0, F.array().cast("array<string>")),
        (single & label, F.array().cast("array<string>")),
        (_begins(head, rules.appendix), F.concat(section(F.array_join(first, " ")), F.transform(rest, lambda r: F.array_join(r, " ")))),
        (single & dashed, F.concat(section(head), F.transform(rest, lambda r: bullet(r[0])))),
        (_begins(top, rules.contacts), F.concat(section(top), F.transform(parts, contact))),
        (top.isin(*rules.agenda) if rules.agenda else F.lit(False), F.concat(section(top), F.flatten(F.transform(rest, item)))),
    )
    kind = F.when(~is_table, None)
    for k, (fits, _) in enumerate(kinds):
        kind = kind.when(fits, k)
    staged = units.withColumn("parts", F.when(is_table, full)).withColumn("kind", kind.otherwise(len(kinds)))
    staged = staged.withColumn("filled", F.when(F.col("kind") == len(kinds), laid)).withColumn("width", F.array_max(F.transform(filled, lambda r: F.size(r))))
    table = F.when(F.col("kind") == len(kinds), grid)
    for k, (_, out) in enumerate(kinds):
        table = table.when(F.col("kind") == k, out)
    return staged.withColumn("padded", padded).withColumn("table", table).drop("parts", "kind", "filled", "width", "padded")


def page_pieces(pages: DataFrame) -> DataFrame:
    """(page, page_id, pos, tag, attrs, text, lists, tables, ...): a page's pieces with what they stand in."""
    bare = F.regexp_replace(F.translate("html", "\x01\x02", "  "), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    parts = F.split(F.regexp_replace(bare, TAGS, "\x01$1$2\x02$3\x02"), "\x01")
    numbered = pages.select("page_id", F.monotonically_increasing_id().alias("page"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("parts"))
    cut = numbered.select("page_id", "page", F.posexplode("parts").alias("pos", "part"))
    piece = lambda n: F.split_part("part", F.lit("\x02"), F.lit(n))
    rows = cut.select("page", "page_id", "pos", F.lower(piece(1)).alias("tag"), piece(2).alias("attrs"), normalize_title(F.regexp_replace(piece(3), r"<[^>]*>", " ")).alias("text"))
    so_far = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag = F.col("tag")
    steps = lambda *names: F.when(tag.isin(*names), 1).when(tag.isin(*(f"/{n}" for n in names)), -1).otherwise(0)
    rows = rows.withColumns({"lists": F.sum(steps("ul", "ol")).over(so_far), "tables": F.sum(steps("table")).over(so_far)})
    outer = F.col("tables") == 1
    count = lambda *names: F.sum((tag.isin(*names) & outer).cast("int")).over(so_far)
    rows = rows.withColumns(
        {
            "table_pos": F.max(F.when((tag == "table") & outer, F.col("pos"))).over(so_far),
            "row": count("tr"),
            "cell": count("td", "th"),
            "row_pos": F.max(F.when((tag == "tr") & outer, F.col("pos"))).over(so_far),
            "cell_pos": F.max(F.when(tag.isin("td", "th") & outer, F.col("pos"))).over(so_far),
        }
    )
    same_depth = Window.partitionBy("page", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("item", F.sum((tag == "li").cast("int")).over(same_depth))


def page_lines(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page, page_id, pos, lines): the lines of each block, tables as one block, in order of ``pos``."""
    tag, text = F.col("tag"), F.col("text")
    rows = page_pieces(pages)
    in_cell = F.coalesce((F.col("tables") >= 1) & (F.col("cell_pos") >= F.greatest("table_pos", "row_pos")), F.lit(False))
    in_item = ((F.col("lists") >= 1) & (F.col("item") >= 1) | (tag == "li")) & ~in_cell  # an item may lack its list
    written = in_cell | (text != "") & (in_item | tag.rlike("^(h[1-6]|p|li|th|td)$"))
    rows = rows.where(written).withColumns({"in_cell": in_cell, "in_item": in_item & ~tag.rlike("^h[1-6]$")})
    first_of_item = Window.partitionBy("page", "lists", "item", "in_item").orderBy("pos")
    rows = rows.withColumn("begins", F.row_number().over(first_of_item) == 1)
    inner = F.concat(_spaces(F.greatest("lists", F.lit(1)) - F.when(F.col("begins"), 1).otherwise(0)), F.when(F.col("begins"), "- ").otherwise(""), text)
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(F.substring(tag, 2, 1).try_cast("int"), F.lit(1))), F.lit(" "), text)
    line = F.when(F.col("in_cell"), None).when(F.col("in_item"), inner).when(tag.rlike("^h[1-6]$"), heading).otherwise(_paragraph(text, F.col("attrs"), rules))
    unit = F.when(F.col("in_cell"), F.col("table_pos")).otherwise(F.col("pos"))
    span = lambda key, most: F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.regexp_extract("attrs", rf"(?i)\b{key}\s*=\s*[\"']?([0-9]{{1,9}})", 1).try_cast("int"), F.lit(1))))
    opens = (F.col("pos") == F.col("cell_pos")) & F.col("in_cell")
    cells = (
        rows.select(
            "page", "page_id", unit.alias("unit"), "in_cell", F.when(F.col("in_cell"), F.col("row")).otherwise(0).alias("row"), F.when(F.col("in_cell"), F.col("cell")).otherwise(0).alias("cell"),
            "pos", "text", line.alias("line"), F.when(opens, span("colspan", WIDEST)).alias("columns"), F.when(opens, span("rowspan", 2**31 - 2)).alias("rows"),
        )
        .groupBy("page", "page_id", "unit", "in_cell", "row", "cell")
        .agg(
            F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), lambda t: t != ""), " ").alias("text"),
            F.max("line").alias("line"), F.coalesce(F.max("columns"), F.lit(1)).alias("columns"), F.coalesce(F.max("rows"), F.lit(1)).alias("rows"),
        )
    )
    by_row = cells.groupBy("page", "page_id", "unit", "in_cell", "row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "text", "columns", "rows"))), lambda c: F.struct(c["text"].alias("text"), c["columns"].alias("columns"), c["rows"].alias("rows"))).alias("cells"),
        F.max("line").alias("line"),
    )
    by_unit = by_row.groupBy("page", "page_id", "unit", "in_cell").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("grid"), F.max("line").alias("line")
    )
    by_unit = _tables(by_unit, rules)
    lines = F.when(F.col("in_cell"), F.col("table")).when(F.col("line").isNotNull(), F.array("line")).otherwise(F.array().cast("array<string>"))
    return by_unit.select("page", "page_id", F.col("unit").alias("pos"), lines.alias("lines"))


def pages_to_markdown(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, markdown)."""
    blocks = page_lines(pages, rules).where(F.size("lines") > 0)
    listed = F.array_sort(F.collect_list(F.struct("pos", "lines")))
    return blocks.groupBy("page", "page_id").agg(F.array_join(F.flatten(F.transform(listed, lambda b: b["lines"])), "\n").alias("markdown")).drop("page")
