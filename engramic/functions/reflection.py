"""Lines and sections of reflection reports in Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramic.functions.text import any_of, squeeze, trim

# Patterns, without regard to case.
PLACEHOLDERS = [r"^\(none( captured)?\)$", r"^(invariants?|reflections?|derived)[:：]$", r"apply this session'?s deltas next run", r"apply this session'?s distilled changes next run", "investigate why embedded reflection generation failed"]
UNSAFE = [
    r"^\s*(?:(?:next|this)\s+run\s+)?(?:ignore|disregard|forget|override|bypass)\b(?s:.{0,80})\b(?:instructions?|guardrails?|policy|developer|system)\b",
    r"\b(?:reveal|print|dump|show|output)\b(?s:.{0,80})\b(?:system prompt|developer prompt|hidden prompt|hidden instructions?|full prompt|prompt verbatim|secrets?|keys?|tokens?)\b",
    r"<\s*/?\s*(?:system|assistant|user|tool|developer|inherited-rules|derived-focus)\b[^>]*>", r"^(?:system|assistant|user|developer|tool)\s*:",
]
INVARIANT = [r"^(always|never|when\b|if\b|before\b|after\b|prefer\b|avoid\b|require\b|only\b|do not\b|must\b|should\b)", r"\b(must|should|never|always|prefer|avoid|required?)\b"]
DERIVED = [r"^(this run|next run|going forward|follow-up|re-check|retest|verify|confirm|avoid repeating|adjust|change|update|retry|keep|watch)\b", r"\b(this run|next run|delta|change|adjust|retry|re-check|retest|verify|confirm|avoid repeating|follow-up)\b"]
OPEN_LOOP = [r"^(investigate|verify|confirm|re-check|retest|update|add|remove|fix|avoid|keep|watch|document)\b"]
# Sections whose bullets become rows: heading, category, kind, stored category.
MAPPED = [
    ("User model deltas (about the human)", "preference", "user-model", "preferences"),
    ("Agent model deltas (about the assistant/system)", "preference", "agent-model", "patterns"),
    ("Lessons & pitfalls (symptom / cause / fix / prevention)", "fact", "lesson", "cases"),
    ("Decisions (durable)", "decision", "decision", "cases"),
]
# Midpoint in days, slope, weight and quality of the fading of rows, by kind.
FADING = {
    "decision": (45.0, 0.25, 1.1, 1.0), "user-model": (21.0, 0.3, 1.0, 0.95), "agent-model": (10.0, 0.35, 0.95, 0.93), "lesson": (7.0, 0.45, 0.9, 0.9),
    "invariant": (45.0, 0.22, 1.1, 1.0), "derived": (7.0, 0.65, 1.0, 0.95),
}
GOVERNANCE = "Learning governance candidates (.learnings / promotion / skill extraction)"


def plain_line(line: Column) -> Column:
    """Without marks of bold type and a leading label."""
    return trim(F.regexp_replace(F.regexp_replace(line, r"\*\*", ""), r"(?iu)^(invariants?|reflections?|derived)[:：]\s*", ""))


def is_placeholder(line: Column) -> Column:
    s = trim(F.regexp_replace(line, r"\*\*", ""))
    return (s == "") | any_of(s, PLACEHOLDERS)


def is_unsafe(line: Column) -> Column:
    s = plain_line(line)
    return (s == "") | any_of(s, UNSAFE)


def line_key(line: Column) -> Column:
    return F.lower(squeeze(line))


def section(markdown: Column, heading: str) -> Column:
    """The lines between ``## heading`` and the next heading of that rank; the heading may come again right after itself."""
    lines = F.split(markdown, r"\r?\n", -1)
    needle = f"## {heading}".lower()

    def step(s: Column, line: Column) -> Column:
        low = F.lower(trim(line))
        head = F.startswith(low, F.lit("## "))
        closed = s.closed | (head & s.inside & (low != needle))
        inside = F.when(head, ~closed & (low == needle)).otherwise(s.inside)
        taken = F.when(~head & ~s.closed & s.inside, F.concat(s.taken, F.array(line))).otherwise(s.taken)
        return F.struct(inside.alias("inside"), closed.alias("closed"), taken.alias("taken"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("closed"), F.array().cast("array<string>").alias("taken"))
    return F.aggregate(lines, start, step, lambda s: trim(F.array_join(s.taken, "\n")))


def bullets(markdown: Column, heading: str) -> Column:
    lines = F.transform(F.split(section(markdown, heading), r"\r?\n", -1), trim)
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* ")))
    return F.filter(F.transform(marked, lambda x: trim(F.substring(x, 3, 1 << 30))), lambda x: x != "")


def clean(lines: Column) -> Column:
    return F.filter(F.transform(lines, plain_line), lambda x: ~is_placeholder(x))


def slices(markdown: Column) -> Column:
    """struct(invariants, derived): at most 8 and 10 lines, from their own sections or from older ones."""
    only = lambda lines, *rules: F.filter(lines, lambda x: any_of(x, rules[0]) & (any_of(x, rules[1]) if len(rules) > 1 else F.lit(True)))
    merged = bullets(markdown, "Invariants & Reflections")
    own = only(clean(bullets(markdown, "Invariants")), INVARIANT)
    old = only(clean(F.filter(merged, lambda x: any_of(x, ["invariant|stable|policy|rule"]))), INVARIANT)
    durable = only(clean(bullets(markdown, "Decisions (durable)")), INVARIANT)
    invariants = F.when(F.size(own) > 0, own).when(F.size(old) > 0, old).otherwise(durable)
    new = only(clean(bullets(markdown, "Derived")), DERIVED)
    loops = only(clean(bullets(markdown, "Open loops / next actions")), OPEN_LOOP, DERIVED)
    changes = only(clean(F.filter(merged, lambda x: any_of(x, ["reflect|inherit|derive|change|apply"]))), DERIVED)
    derived = F.when(F.size(new) > 0, new).otherwise(F.concat(changes, loops))
    return F.struct(F.slice(invariants, 1, 8).alias("invariants"), F.slice(derived, 1, 10).alias("derived"))


def mapped_items(markdown: Column) -> Column:
    """array of struct(kind, category, heading, ordinal, group_size, text) of the sections that become rows."""
    def items(heading: str, category: str, kind: str) -> Column:
        lines = clean(bullets(markdown, heading))
        return F.transform(lines, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit(heading).alias("heading"), i.alias("ordinal"), F.size(lines).alias("group_size"), x.alias("text")))

    return F.concat(*[items(h, c, k) for h, c, k, _ in MAPPED])


def governance(markdown: Column) -> Column:
    """array of struct(priority, status, area, summary, details, suggested_action) of the ``### Entry`` blocks with a summary."""
    body = section(markdown, GOVERNANCE)
    blocks = F.filter(F.split(F.regexp_replace(F.concat(F.lit("\n"), body), r"(?im)^###\s+Entry\b", "\x1e"), "\x1e"), lambda b: trim(b) != "")
    blocks = F.transform(blocks, lambda b: trim(F.regexp_replace(b, r"^[^\n]*\n?", "")))
    field = lambda b, name: F.nullif(trim(F.regexp_extract(b, rf"(?im)^\*\*{name}\*\*:\s*(.+)$", 1)), F.lit(""))
    part = lambda b, name: F.nullif(trim(F.regexp_extract(b, rf"(?is)(?:^|\n)###\s+{name}\s*\n(.*?)(?:\n###\s|$)", 1)), F.lit(""))
    entries = F.transform(blocks, lambda b: F.struct(field(b, "Priority").alias("priority"), field(b, "Status").alias("status"), field(b, "Area").alias("area"), part(b, "Summary").alias("summary"), part(b, "Details").alias("details"), part(b, "Suggested Action").alias("suggested_action")))
    return F.filter(entries, lambda e: e.summary.isNotNull())


def fading(kind: Column) -> Column:
    """struct(midpoint_days, k, weight, quality) by which a row of a kind fades; null for unknown kinds."""

    def one(values: tuple[float, float, float, float]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("midpoint_days", "k", "weight", "quality"), values, strict=True)])

    return F.coalesce(*[F.when(kind == k, one(v)) for k, v in FADING.items()])
