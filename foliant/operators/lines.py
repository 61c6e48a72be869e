"""Documents as lines: sections, units, blanks and indents, by windows over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+(.+)$"
#: Lines that stand alone: headings, quotes, images, list items, rules, fences.
ALONE = r"^(#{1,6}\s+|>|!\[[^\]]*\]\([^)]+\)$|[-*]\s+|[0-9]+\.\s+|(-{3,}|\*{3,}|_{3,})$|```)"
DEFAULT_SECTION = "body"


def lines_of(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, line): a document's lines from 0; an empty text has none."""
    text = F.when(F.coalesce("text", F.lit("")) != "", F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"))
    return docs.select(*keys, F.posexplode(text).alias("pos", "line"))


def _doc(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("pos")


def assign_sections(lines: DataFrame, *keys: str, default: str = DEFAULT_SECTION) -> DataFrame:
    """Each line with the last heading at or above it."""
    heading = F.nullif(F.trim(F.regexp_extract(F.trim("line"), HEADING, 1)), F.lit(""))
    last = F.last(heading, ignorenulls=True).over(_doc(keys).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", F.coalesce(last, F.lit(default)))


def paragraph_units(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, unit, section, text): neighbouring plain lines in one unit, all other lines alone."""
    line = F.trim("line")
    plain = (line != "") & ~line.rlike(ALONE) & ~F.contains(line, F.lit("|"))
    before = F.lag("plain", 1, False).over(_doc(keys))
    marked = assign_sections(lines, *keys).withColumn("line", line).withColumn("plain", plain)
    starts = F.when(F.col("line") == "", 0).when(~F.col("plain") | ~before, 1).otherwise(0)
    unit = F.sum("starts").over(_doc(keys).rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("starts", starts).withColumn("unit", unit).where("line <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    text = F.trim(F.regexp_replace(joined, r"\s+", " "))
    return numbered.groupBy(*keys, "unit").agg(F.min("section").alias("section"), text.alias("text"))


def drop_marked_sections(lines: DataFrame, *keys: str, appendix: str, image: str, note: str) -> DataFrame:
    """From a heading that names an image appendix to the next other appendix heading, only a note stays."""
    line = F.trim("line")
    head = F.startswith(line, F.lit("## "))
    event = F.when(head & F.contains(line, F.lit(image)), 1).when(head & F.contains(line, F.lit(appendix)), 0)
    state = F.coalesce(F.last(event, ignorenulls=True).over(_doc(keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    marked = lines.withColumn("event", event).withColumn("skip", state).where((F.col("skip") == 0) | (F.col("event") == 1))
    return marked.select(*keys, "pos", F.explode(F.when(F.col("event") == 1, F.array("line", F.lit(note))).otherwise(F.array("line"))).alias("line"))


def collapse_blanks(lines: DataFrame, *keys: str, most: int = 1) -> DataFrame:
    """Runs of blank lines cut to ``most``, none at the end."""
    blank = F.trim("line") == ""
    full_before = F.sum(F.when(F.trim("line") != "", 1).otherwise(0)).over(_doc(keys).rowsBetween(Window.unboundedPreceding, 0))
    full_after = F.sum(F.when(F.trim("line") != "", 1).otherwise(0)).over(_doc(keys).rowsBetween(0, Window.unboundedFollowing))
    run = Window.partitionBy(*keys, "__run").orderBy("pos")
    marked = lines.withColumn("__run", full_before).withColumn("__after", full_after).withColumn("__blank", blank)
    # In a run, the line that is not blank comes first, so a blank line's number in the run tells its place.
    place = F.row_number().over(run) - F.when(F.col("__run") > 0, 1).otherwise(0)
    kept = marked.withColumn("__place", place).where(~F.col("__blank") | ((F.col("__place") <= most) & (F.col("__after") > 0)))
    return kept.select(*keys, "pos", F.when(F.col("__blank"), "").otherwise(F.col("line")).alias("line"))


def indent_normalize(lines: DataFrame, *keys: str) -> DataFrame:
    """Nested list and quote lines get four spaces a level; blank lines go in front of lists after plain
    text, in front of quotes after tables, and around rules. (keys, pos, sub, line), in order of pos and sub."""
    lead = F.length("line") - F.length(F.ltrim("line"))
    bare = F.ltrim("line")
    item = r"^([-*+]|[0-9]+[.)])\s+"
    nested = (bare.rlike(item) | F.startswith(bare, F.lit(">"))) & (lead >= 2)
    line = F.when(nested, F.concat(F.repeat(F.lit(" "), (F.floor(lead / 2) * 4).cast("int")), bare)).otherwise(F.col("line"))
    marked = lines.withColumn("line", line)
    previous = F.last(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(_doc(keys).rowsBetween(Window.unboundedPreceding, -1))
    touching = F.coalesce(F.trim(F.lag("line").over(_doc(keys))) != "", F.lit(False))
    now = F.trim("line")
    rule = now.rlike(r"^(-{3,}|\*{3,}|_{3,})$")
    after_plain = F.col("line").rlike(r"^[-*+]\s+") & F.col("previous").isNotNull() & ~F.col("previous").rlike(item) & ~F.startswith("previous", F.lit("#"))
    after_table = F.startswith(now, F.lit(">")) & F.coalesce(F.startswith("previous", F.lit("|")), F.lit(False)) & F.col("touching")
    out = (
        F.when(rule & F.col("touching"), F.array(F.lit(""), F.lit("<hr />"), F.lit("")))
        .when(rule, F.array(F.lit("<hr />"), F.lit("")))
        .when(after_plain | after_table, F.array(F.lit(""), F.col("line")))
        .otherwise(F.array("line"))
    )
    state = marked.withColumn("previous", previous).withColumn("touching", touching)
    return state.select(*keys, "pos", F.posexplode(out).alias("sub", "line"))


def join_lines(lines: DataFrame, *keys: str, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(keys, text): a document's lines put together again."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def section_fields(text: Column, labels: dict[str, str], id_pattern: str) -> Column:
    """(sample_id, title, *labels) of each numbered section that names a sample, as an array.

    A section starts with ``## `` and a number; ``id_pattern`` has the id as its first group. A field is what stands
    behind the last line that starts with its label, and empty without one.
    """
    sections = F.split(F.concat(F.lit("\n"), text), r"\n##\s+[0-9]+\.\s+")

    def one(section: Column) -> Column:
        lines = F.split(section, "\n")
        body = F.slice(lines, 2, F.size(lines))
        value = lambda label: F.trim(F.substring(F.element_at(F.filter(body, lambda x: F.startswith(x, F.lit(label))), -1), len(label) + 1, 10**9))
        found = F.regexp_extract(F.array_join(body, "\n"), id_pattern, 1)
        fields = (
            F.when(F.size(F.filter(body, lambda x: F.startswith(x, F.lit(label)))) > 0, value(label)).otherwise("").alias(name) for name, label in labels.items()
        )
        return F.struct(found.alias("sample_id"), F.trim(F.element_at(lines, 1)).alias("title"), *fields)

    return F.filter(F.transform(F.slice(sections, 2, F.greatest(F.size(sections) - 1, F.lit(0))), one), lambda s: s["sample_id"] != "")


def section_rows(text: Column, header: str) -> Column:
    """Cells of the piped rows behind the row that starts with ``header``, as an array of arrays."""
    after = F.substring_index(F.concat(F.lit("\n"), text), "\n" + header, -1)
    has = F.contains(F.concat(F.lit("\n"), text), F.lit("\n" + header))
    body = F.regexp_extract(after, r"^[^\n]*\n((?:[ \t]*\|[^\n]*(?:\n|$))*)", 1)
    rows = F.filter(F.split(body, "\n"), lambda r: F.startswith(F.trim(r), F.lit("|")) & ~r.rlike(r"^[ \t]*\|[ \t:|-]*$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.when(has, cells).otherwise(F.array().cast("array<array<string>>"))
