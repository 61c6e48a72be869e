"""Operator messages, verdicts and errors: reading what free text and JSON hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of an upstream that does not answer.
TIMEOUT_SIGNS = ("timed out", "timeout", "load failed", "failed to fetch", "bad gateway", "network", "signal is aborted")
VERDICT = "decision string, confidence string, blocking_findings array<string>, next_fix_instruction string, user_summary string"
DECISIONS = ("pass", "retry", "defer")


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def classify_error(message: Column, timeout: str = "upstream_timeout", signs: tuple[str, ...] = TIMEOUT_SIGNS) -> Column:
    """The timeout category if any sign occurs, else the message itself."""
    low = F.lower(_empty(message))
    hit = F.lit(False)
    for s in signs:
        hit = hit | F.contains(low, F.lit(s))
    return F.when(hit, timeout).otherwise(F.trim(_empty(message)))


def parse_verdict(text: Column) -> Column:
    """A judge's JSON with defaults; unknown decisions become retry, blank findings go."""
    v = F.from_json(text, VERDICT)
    decision = F.trim(_empty(v["decision"]))
    findings = F.coalesce(v["blocking_findings"], F.array().cast("array<string>"))
    return F.struct(
        F.when(decision.isin(*DECISIONS), decision).otherwise("retry").alias("decision"),
        F.coalesce(F.nullif(F.trim(v["confidence"]), F.lit("")), F.lit("medium")).alias("confidence"),
        F.filter(F.transform(findings, lambda f: F.trim(_empty(f))), lambda f: f != "").alias("blocking_findings"),
        F.trim(_empty(v["next_fix_instruction"])).alias("next_fix_instruction"),
        F.trim(_empty(v["user_summary"])).alias("user_summary"),
    )


#: What opens the block of metadata, a tag of an attached file, and an element that names one.
METADATA, ATTACHED, FILE_ELEMENT = "Conversation info (untrusted metadata):", "media attached:", "file"
FENCE = "`{3}(?:json)?"


def _bracketed(opening: str) -> str:
    """A tag in square brackets, whatever follows its opening."""
    return rf"\[{opening}[^\]]*\]"


def message_metadata(text: Column) -> Column:
    """Sender and message id from the embedded JSON, else from its raw text, else the header's id;
    and the text without its wrappers."""
    parts = F.split(text, F.lit(rf"\Q{METADATA}\E"), 2)
    behind = F.ltrim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), rf"^\s*(?:{FENCE})?\s*", ""))
    block = F.when(F.startswith(behind, F.lit("{")), F.concat(F.substring_index(behind, "}", 1), F.lit("}")))
    after = F.when(block.isNull(), behind).otherwise(F.regexp_replace(F.substring(behind, F.length(block) + 1, F.length(behind)), rf"^\s*{FENCE}", ""))
    bare = F.concat_ws(" ", F.get(parts, F.lit(0)), after)
    for opening in ("[A-Z][a-z]+ ", ATTACHED):
        bare = F.regexp_replace(bare, _bracketed(opening), "")

    def field(name: str) -> Column:
        own = F.nullif(F.trim(F.get_json_object(block, f"$.{name}")), F.lit(""))
        quoted = F.split(text, F.lit(f'"{name}"\\s*:\\s*"'), 2)
        return F.coalesce(own, F.nullif(F.substring_index(F.get(quoted, F.lit(1)), '"', 1), F.lit("")))

    header = F.regexp_extract(text, _bracketed("[A-Z][a-z]+ "), 0)
    number = F.nullif(F.regexp_extract(header, r"\bid:(\d+)", 1), F.lit(""))
    return F.struct(
        F.coalesce(field("sender_id"), number).alias("sender_id"),
        field("message_id").alias("message_id"),
        F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("body"),
    )


def message_media(text: Column) -> Column:
    """Paths of both tag forms, tags in brackets first, each with whether it is Markdown.

    A tag holds a path, after it perhaps a type in parentheses, and after a bar what else is known; an element
    holds the path as its name.
    """
    tags = F.transform(F.regexp_extract_all(text, F.lit(_bracketed(ATTACHED)), 0), lambda t: F.btrim(t, F.lit("[]")))
    in_tags = F.transform(tags, lambda t: F.regexp_replace(F.substring_index(F.substring(t, len(ATTACHED) + 1, 10**9), "|", 1), r"\s\([^()]*\)\s*$", ""))
    elements = F.regexp_extract_all(text, F.lit(rf"<{FILE_ELEMENT}\s[^>]*>"), 0)
    in_elements = F.transform(elements, lambda e: F.regexp_extract(e, r'\sname="([^"]*)"', 1))
    paths = F.filter(F.transform(F.concat(in_tags, in_elements), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lower(p).rlike(r"\.(md|markdown)$").alias("is_markdown")))


@dataclass(frozen=True)
class IntentRule:
    """Matches where ``pattern`` is found; ``count`` is a pattern whose first group is a number."""

    intent: str
    pattern: str
    count: str | None = None


#: The slash commands, in the order in which they are tried.
COMMANDS = (
    IntentRule("qc-status", r"^\s*/qc\s+today(\s|$)"),
    IntentRule("qc-failures", r"^\s*/qc\s+failures(\s|$)"),
    IntentRule("qc-issue", r"^\s*/qc\s+issue(\s|$)"),
    IntentRule("qc-rerun", r"^\s*/qc\s+rerun\s+\d{4}-\d{2}-\d{2}(\s|$)"),
    IntentRule("qc-promote", r"^\s*/qc\s+promote\s+\d{4}-\d{2}-\d{2}\s+\S+(\s|$)"),
    IntentRule("server-status", r"^\s*/server\s+status(\s|$)"),
    IntentRule("server-failover-check", r"^\s*/server\s+failover-check(\s|$)"),
    IntentRule("auto_start", r"(?i)start qc", r"(?i)recent\s*(\d{1,9})"),
    IntentRule("open_sample", r"policy_briefing_\d{4}_\d{2}_\d{2}_\d{9}"),
)


def classify_intent(text: Column, rules: tuple[IntentRule, ...] = COMMANDS, default_count: int = 10, most: int = 50) -> Column:
    """Intent of the first rule that matches, and its count within 1 and ``most``."""
    intent, count = F.lit(None).cast("string"), F.lit(None).cast("int")
    for r in reversed(rules):
        hit = text.rlike(r.pattern)
        intent = F.when(hit, r.intent).otherwise(intent)
        own = F.lit(None).cast("int")
        if r.count:
            own = F.coalesce(F.nullif(F.regexp_extract(text, r.count, 1), F.lit("")).cast("int"), F.lit(default_count))
            own = F.greatest(F.lit(1), F.least(F.lit(most), own))
        count = F.when(hit, own).otherwise(count)
    return F.struct(intent.alias("intent"), count.alias("count"))


def inspect_summary(passed: Column, findings: Column) -> Column:
    """PASS, or FAIL with the number of findings and what the first three are about."""
    blank = lambda c: F.nullif(F.trim(_empty(c)), F.lit(""))
    names = F.filter(
        F.transform(F.slice(findings, 1, 3), lambda f: F.coalesce(blank(f["category"]), blank(f["assertion_id"]), blank(f["message"]))),
        lambda x: x.isNotNull(),
    )
    top = F.when(F.size(names) > 0, F.concat(F.lit(" top="), F.array_join(names, ","))).otherwise("")
    return F.when(passed, "inspect=PASS findings=0").otherwise(
        F.concat(F.lit("inspect=FAIL findings="), F.size(findings).cast("string"), top)
    )


def mask_spec(spec: Column) -> Column:
    """P25: credentials in a URL replaced by stars."""
    return F.regexp_replace(F.trim(_empty(spec)), r"://([^/@]+)@", "://***@")


def version_parts(version: Column) -> Column:
    """Leading numeric parts, as an array that compares like a tuple."""
    digits = F.regexp_extract(F.regexp_replace(_empty(version), "-", "."), r"^([0-9]+(?:\.[0-9]+)*)(?:\.|$)", 1)
    return F.when(digits == "", F.array().cast("array<int>")).otherwise(F.split(digits, r"\.").cast("array<int>"))


def fleet_version_check(version: Column, module_path: Column, minimum: str, expected: str) -> Column:
    """Below the minimum, differs from what is expected, and where the module was installed."""
    bare = lambda c: F.regexp_replace(F.trim(_empty(c)), "^v", "")
    site = module_path.rlike(r"(^|/)(site|dist)-packages(/|$)")
    known = _empty(version) != ""
    return F.struct(
        (version_parts(version) < version_parts(F.lit(minimum))).alias("below_minimum"),
        (bare(version) != bare(F.lit(expected))).alias("differs"),
        F.when(site & known, "package").when(F.contains(module_path, F.lit("packages/")) & ~site, "bundled").when(known, "package").otherwise("unknown").alias("backend"),
    )


def result_view(jobs_columns: dict[str, Column]) -> Column:
    """Edited text wins over a variant, a variant over the primary text; blank counts as missing."""
    c = {k: F.nullif(_empty(v), F.lit("")) for k, v in jobs_columns.items()}
    return F.struct(
        F.coalesce(c["edited_markdown"], c["markdown"]).alias("primary_text"),
        F.coalesce(c["edited_markdown"], c["markdown_text"], c["markdown"]).alias("text_variant"),
        F.coalesce(c["edited_markdown"], c["markdown_html"], c["markdown"]).alias("html_variant"),
    )


def format_alert(kind: Column, label: Column, server: Column, detail: Column, failures: Column, url: Column, time: Column) -> Column:
    """One transition as text."""
    head = F.concat_ws(
        "",
        F.upper(F.when(kind == "down_reminder", "down").otherwise(kind)),
        F.lit(" "), label, F.lit(" ("), server, F.lit(") - "), detail,
        F.when(kind != "recovered", F.concat(F.lit(" - failures="), failures.cast("string"))).otherwise(""),
        F.when(kind == "down_reminder", " - reminder").otherwise(""),
    )
    return F.concat_ws("\n", head, F.concat(F.lit("url: "), url), F.concat(F.lit("time: "), time))
