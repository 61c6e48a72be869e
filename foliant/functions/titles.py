"""Titles and keys: cleaning, comparing and splitting them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML entities that titles carry; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}
#: What title keys replace (in this order), and words that no title is told by.
SYNONYMS = (("ai", "인공지능"), ("a.i.", "인공지능"))
STOP_TOKENS = ("보도자료", "보도참고", "보도참고자료", "국정브리핑")
#: White space, with the no-break and ideographic spaces that Unicode adds.
SPACE = r"[\s 　]+"
NOT_KEY = r"[^\p{L}\p{N}_\s()-]"


def _blank_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def unescape(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    for name, value in entities.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def normalize_title(text: Column) -> Column:
    """Entities decoded, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(unescape(_blank_to_empty(text)), SPACE, " "))


def _key(text: Column) -> Column:
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), SPACE, " ")
    return F.trim(F.regexp_replace(spaced, NOT_KEY, ""))


def title_key(text: Column, synonyms: tuple[tuple[str, str], ...] = SYNONYMS) -> Column:
    """The form under which titles are searched. Synonyms apply inside words, too."""
    out = F.lower(F.trim(_blank_to_empty(text)))
    for word, other in synonyms:
        out = F.replace(out, F.lit(word), F.lit(other))
    return _key(out)


def storage_key(text: Column) -> Column:
    """As :func:`title_key` without synonyms; a trailing zone marker goes first."""
    return _key(F.lower(F.trim(F.regexp_replace(_blank_to_empty(text), r"(?i):zone.identifier$", ""))))


def compact_key(text: Column) -> Column:
    """P10: ASCII letters, digits and Hangul syllables only."""
    return F.regexp_replace(_blank_to_empty(text), "[^0-9A-Za-z가-힣]", "")


def title_tokens(text: Column, synonyms=SYNONYMS, stop: tuple[str, ...] = STOP_TOKENS, distinct: bool = True) -> Column:
    """The key's tokens of two characters or more without stop words, then the whole without spaces.

    With ``distinct`` false, repeated tokens stay, as counts of hits need them.
    """
    key = title_key(text, synonyms)
    whole = F.replace(key, F.lit(" "), F.lit(""))
    kept = F.filter(F.split(key, r"[\s()/-]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*stop))
    if distinct:
        tokens = F.array_union(kept, F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))
    else:
        tokens = F.when((whole != "") & ~F.array_contains(kept, whole), F.array_append(kept, whole)).otherwise(kept)
    return F.when(key != "", tokens).otherwise(F.array().cast("array<string>"))


def clean_title(text: Column) -> Column:
    """Without one leading bracketed tag."""
    return F.trim(F.regexp_replace(_blank_to_empty(text), r"^\s*\[[^\]]*\]\s*", ""))


def search_filter(q: str, *columns: Column) -> Column:
    """Case-insensitive literal match in any column; a blank query matches everything."""
    needle = q.strip().lower()
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(_blank_to_empty(c)), F.lit(needle))
    return hit


def storage_title(file_name: Column) -> Column:
    """The stem without its job prefix."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    return F.trim(F.regexp_replace(stem, r"^job_[^-]*-", ""))


def safe_filename(file_name: Column, default: str = "document") -> Column:
    """The base name with risky characters replaced."""
    base = F.regexp_replace(_blank_to_empty(file_name), r"^.*/", "")
    return F.coalesce(F.nullif(F.regexp_replace(base, r"[^\p{L}\p{N}_\s.()-]", "_"), F.lit("")), F.lit(default))


def excerpt(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(_blank_to_empty(text), 1, n)


def shorten(text: Column, n: int = 180) -> Column:
    """Trimmed, and cut to ``n`` with an ellipsis where longer."""
    t = F.trim(_blank_to_empty(text))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def sample_id(item_id: Column, approved: Column, prefix: str = "policy_briefing") -> Column:
    """P20: prefix, date and id in one identifier."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(approved, "yyyy_MM_dd"), item_id)


def sample_item(sample: Column) -> Column:
    """P20: the nine digits at the end of a sample's identifier, or null."""
    return F.nullif(F.regexp_extract(sample, r"(\d{9})$", 1), F.lit(""))


def item_in_text(text: Column) -> Column:
    """P20: the first identifier in free text: as a query parameter, or nine digits standing alone."""
    named = F.nullif(F.regexp_extract(text, r"(?i)newsid=(\d{9})", 1), F.lit(""))
    alone = F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])(\d{9})(?:[^0-9]|$)", 1), F.lit(""))
    return F.coalesce(named, alone)
