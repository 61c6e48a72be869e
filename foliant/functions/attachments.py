"""Attachments: kinds, appendices and payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an appendix's file name starts with.
APPENDIX_WORDS = ("붙임", "별첨", "첨부")
#: The first bytes of a zip container, and how an HTML page starts.
ZIP_MAGIC = "504B0304"
HTML_STARTS = ("<!doctype html", "<html", "<?xml")


def attachment_extension(file_name: Column) -> Column:
    """The lower-cased text after the last dot, with the dot; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(file_name, F.lit(""))), r"\.[^.]*$", 0)


def is_appendix(file_name: Column, words: tuple[str, ...] = APPENDIX_WORDS) -> Column:
    """An appendix word first, behind an optional date and an optional bracket."""
    name = F.regexp_replace(F.trim(F.coalesce(file_name, F.lit(""))), r"^\s*[0-9]{6,8}(?:[\s_-]+)?", "")
    name = F.regexp_replace(name, r"^[ _-]+", "")
    return name.rlike(rf"^(?:[\[<(]\s*)?(?:{'|'.join(words)})(?:[^\p{{L}}_]|$)")


def has_appendix(attachments: Column, extension: str, words: tuple[str, ...] = APPENDIX_WORDS) -> Column:
    """Any attachment of that extension is an appendix."""
    return F.exists(
        attachments, lambda a: (attachment_extension(a["file_name"]) == extension) & is_appendix(a["file_name"], words)
    )


def primary_attachment(attachments: Column, extension: str, words: tuple[str, ...] = APPENDIX_WORDS) -> Column:
    """P5: the first of that extension that is no appendix, else the first of it, else null."""
    typed = F.filter(attachments, lambda a: attachment_extension(a["file_name"]) == extension)
    return F.coalesce(F.get(F.filter(typed, lambda a: ~is_appendix(a["file_name"], words)), F.lit(0)), F.get(typed, F.lit(0)))


def payload_kind(content: Column) -> Column:
    """Zip, html, other, or empty (also for null)."""
    head = F.lower(F.ltrim(F.translate(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), "\t\n\r\x0b\x0c", "     ")))
    html = F.lit(False)
    for start in HTML_STARTS:
        html = html | F.startswith(head, F.lit(start))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
        .when(F.hex(F.substring(content, 1, 4)) == ZIP_MAGIC, "zip")
        .when(html, "html")
        .otherwise("other")
    )


def status_of_attachment(primary: Column, kind: Column) -> Column:
    """Ok, missing, html_error or wrong_container."""
    return (
        F.when(primary.isNull() | (kind == "empty"), "missing")
        .when(kind == "html", "html_error")
        .when(kind == "zip", "ok")
        .otherwise("wrong_container")
    )


def placeholder_document(status: Column, title: Column, notices: dict[str, tuple[str, str]], detail: Column) -> Column:
    """The document that stands in for a conversion; null where the status is ok."""
    message = F.coalesce(*(F.when(status == s, m) for s, (m, _) in notices.items()))
    about = F.coalesce(*(F.when(status == s, d) for s, (_, d) in notices.items()))
    return F.when(status != "ok", F.concat_ws("\n\n", F.concat(F.lit("# "), title), message, about, detail))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
