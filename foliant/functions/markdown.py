"""Markdown documents: titles, departments and structure, worked out inside each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How organisation names end, and the labels that a press document starts with.
ORGANISATION_ENDS = ("과", "팀", "실", "관", "국", "센터")
PRESS_LABELS = ("보도자료", "보도참고자료")


def extract_title(text: Column) -> Column:
    """The first line that starts with one hash and a space, else null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def extract_heading(text: Column, fallback: Column) -> Column:
    """The first line that starts with any hash, without its hashes, else the fallback."""
    line = F.regexp_extract(text, r"(?m)^[ \t]*(#[^\n]*)$", 1)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(line, "^#+", "")), F.lit("")), fallback)


def extract_department(text: Column, ends: tuple[str, ...] = ORGANISATION_ENDS) -> Column:
    """The first list line's name up to an organisation's ending, else null."""
    pattern = rf"(?m)^- ([^\n]+?(?:{'|'.join(ends)}))(?:[^\p{{L}}\p{{N}}_]|$)"
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def inject_department(text: Column, department: Column, labels: tuple[str, ...] = PRESS_LABELS) -> Column:
    """The first line that is exactly a press label gets the department in front.

    Blank lines never end the search; it ends after the first other line at index 9 or later.
    """
    dept = F.trim(F.coalesce(department, F.lit("")))
    lines = F.split(text, "\n")
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("line")))
    first = lambda keep: F.array_min(F.transform(F.filter(at, keep), lambda e: e["i"]))
    stop = F.coalesce(first(lambda e: (e["i"] >= 9) & (e["line"] != "")), F.size(lines))
    hit = first(lambda e: e["line"].isin(*labels))
    label = F.trim(F.get(lines, hit))
    changed = F.array_join(
        F.concat(F.slice(lines, 1, hit), F.array(F.concat_ws(" ", dept, label, F.lit("/"))), F.slice(lines, hit + 2, F.size(lines))),
        "\n",
    )
    blank = (dept == "") | (F.coalesce(text, F.lit("")) == "")
    return F.when(blank | hit.isNull() | (hit > stop), text).otherwise(changed)


def markdown_structure(text: Column) -> Column:
    """Counts of lines, piped lines, images, page marks, headings and quote lines."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n\z", "")
    lines = F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(body, "\n")))
    return F.struct(
        lines.alias("lines"),
        count(r"(?m)^[ \t]*\|").alias("tables"),
        count(r"!\[[^\]]*\]\([^)]+\)").alias("images"),
        count(r"(?m)^[ \t]*-?[ \t]*[0-9]+[ \t]*-?[ \t]*$").alias("page_marks"),
        count(r"(?m)^#{1,6}[ \t]+").alias("headings"),
        count(r"(?m)^>").alias("quotes"),
    )


#: Elements that go with all they hold, those of which the tags alone go, and what a URL must not start with.
ACTIVE, TAGS_ONLY = ("script", "iframe", "object"), ("embed", "form")
URL_ATTRIBUTES, SCHEMES = ("href", "src", "action"), ("javascript", "data", "vbscript")
#: An attribute's value, in either kind of quotes or in none.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def strip_unsafe_html(html: Column) -> Column:
    """Active elements and event attributes go, script URLs become harmless.

    Whole elements go first, then the tags that are left of all listed elements, be they unclosed or closed in themselves.
    """
    either = "|".join
    steps = (
        (rf"(?is)<({either(ACTIVE)})\b(?:[^>]*[^>/])?>.*?</\1\s*>", ""),
        (rf"(?i)</?(?:{either(ACTIVE + TAGS_ONLY)})\b[^>]*>", ""),
        (rf"(?i)(?<=\s)on[a-z]+\s*=\s*{VALUE}", ""),
        (rf"(?i)\b({either(URL_ATTRIBUTES)})(\s*=\s*[\"']?)\s*(?:{either(SCHEMES)})\s*:", "$1$2#"),
    )
    for pattern, replacement in steps:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def normalize_text_rules(text: Column, rules: list[tuple[str, str]], literals: dict[str, str]) -> Column:
    """Patterns in their order, then literal replacements in theirs, as one expression."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    for old, new in literals.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
