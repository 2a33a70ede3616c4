"""What channels and models wrap around texts: metadata blocks, wrapper lines, speaker tags, and JSON in prose.

Rules on tags and lines are columns. Scanners that keep a state (fences with balanced bodies, strings
of broken JSON) run over Arrow batches; each passes over its text once, whatever the text holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from engramic.functions.text import bound, replaced_if, trim

# Names of speaker tags, and invisible characters that may pad them.
SPEAKERS = ["user_message", "assistant_message"]
INVISIBLE = r"\x{AD}\x{34F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}"
BLANKS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Labels of metadata blocks, what a reset session begins with, and what subagents are told.
BLOCK_LABELS = [
    "Conversation info (untrusted metadata):", "Sender (untrusted metadata):", "Thread starter (untrusted, for context):",
    "Replied message (untrusted, for context):", "Forwarded message context (untrusted metadata):", "Chat history since last reply (untrusted, for context):",
]
RESET = "A new session was started via /new or /reset. Execute your Session Startup sequence now"
TOLD = ["Results auto-announce to your requester", "do not busy-poll for status", "Reply with a brief acknowledgment only", "Do not use any memory tools"]
WRAPPER = r"^\[(?:Subagent Context|Subagent Task)\]"
SUBAGENT = r"You are running as a subagent\b"
SYSTEM_LINE = r"(?m)^System:\s*\[[\d\-: +GMT]+\]\s+\S+\[.*?\].*$"
BLOCK_LABEL = r"(?:Conversation info|Sender|Replied message)\s*\(untrusted[^)]*\):\s*$"
LABEL_REACH = 160


def without_spoofed_tags(text: Column) -> Column:
    """Speaker tags inside a message in guillemets, so that they cannot be taken for the transcript's own.

    Padding, a slash and attributes do not hide a tag; one that no ``>`` closes is none. What comes
    after the last ``>`` is not searched, so every search ends at a match and none is repeated.
    """
    pad = f"[{BLANKS}{INVISIBLE}]*+"
    tag = f"<({pad}(?:/{pad})?(?i:{'|'.join(SPEAKERS)})(?![A-Za-z0-9_])[^>]*+)>"
    rest = F.when(F.contains(text, F.lit(">")), F.substring_index(text, ">", -1)).otherwise(text)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
    return F.concat(F.regexp_replace(head, tag, "‹$1›"), rest)


def _without_metadata(text: Column) -> Column:
    """Without lines of system events and labelled JSON blocks, as often as removals uncover more, six times at most."""
    labels = "|".join(re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", s) for s in BLOCK_LABELS)

    def once(t: Column) -> Column:
        event = r"(?im)^System:\s*\[[^\n]*?\]\s*Exec\s+(?:completed|failed|started)\b.*$"
        t = bound(t, lambda x: F.when(F.contains(F.lower(x), F.lit("system:")), F.regexp_replace(x, event, "\n")).otherwise(x))
        t = replaced_if(t, "```json", rf"(?:^|\n)\s*(?:{labels})\s*\n```json[\s\S]*?\n```\s*", "\n")
        return trim(replaced_if(t, "\n\n\n", r"\n{3,}", "\n\n"))

    # a text that a step left as it was is left so by all that follow
    start = F.struct(text.alias("t"), F.lit(True).alias("changed"))
    step = lambda s, _: F.when(s.changed, bound(once(s.t), lambda t: F.struct(t.alias("t"), (t != s.t).alias("changed")))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda s: s.t)


def _without_reset(text: Column) -> Column:
    """Without the first paragraph (or, without a blank line, the first two lines) of a reset session."""

    def rest(t: Column) -> Column:
        after = F.regexp_extract(t, r"^[\s\S]*?\n\n([\s\S]*)$", 1)
        lines = F.array_join(F.slice(F.split(t, "\n", -1), F.lit(3), F.greatest(F.lit(0), F.size(F.split(t, "\n", -1)) - 2)), "\n")
        return F.when(F.startswith(t, F.lit(RESET)), trim(F.when(F.contains(t, F.lit("\n\n")), after).otherwise(lines))).otherwise(t)

    return bound(trim(text), rest)


def _without_wrappers(text: Column) -> Column:
    """Without the wrapper and blank lines that a message begins with; what stands behind a wrapper stays."""
    told = "|".join([rf"{SUBAGENT}.*?(?:\z|(?<=\.)\s+)", *[rf"{t}\.?\s*" for t in TOLD]])

    def line(raw: Column) -> Column:
        return bound(trim(raw), lambda t: F.when(t.rlike(f"(?i){WRAPPER}"), wrapped(t)).otherwise(F.struct(raw.alias("kept"), (t != "").alias("ends"))))

    def wrapped(t: Column) -> Column:
        inner = trim(F.regexp_replace(F.regexp_replace(trim(F.regexp_replace(t, rf"(?i){WRAPPER}\s*", "")), f"(?i)(?:{told})", ""), r"\s{2,}", " "))
        return bound(inner, lambda x: F.struct(x.alias("kept"), (x != "").alias("ends")))

    def without(raw: Column) -> Column:
        # the first line that neither is blank nor only wraps ends the lead-in
        first = F.array_position(F.transform(raw, lambda x: line(x).ends), F.lit(True)).cast("int")
        return bound(first, lambda at: told_from(raw, at))

    def told_from(raw: Column, at: Column) -> Column:
        later = F.slice(raw, at + 1, F.greatest(F.lit(0), F.size(raw) - at))
        return F.when(at > 0, trim(F.array_join(F.concat(F.array(line(F.try_element_at(raw, at)).kept), later), "\n"))).otherwise("")

    return bound(F.split(trim(text), "\n", -1), without)


def capture_text(role: Column, text: Column) -> Column:
    """What a message says, without what was injected into it; null where nothing is left or there is no role.

    Messages of others than users are only trimmed.
    """

    def said(t: Column) -> Column:
        t = replaced_if(t, "<", r"(?i)<relevant-memories>\s*[\s\S]*?</relevant-memories>\s*", "")
        t = replaced_if(t, "[", r"(?i)\[UNTRUSTED DATA[^\n]*\][\s\S]*?\[END UNTRUSTED DATA\]\s*", "")
        t = _without_metadata(_without_reset(t))
        t = trim(F.regexp_replace(t, r"^(?:<@!?[0-9]+>|@[A-Za-z0-9_.-]+)\s*", ""))
        return trim(replaced_if(_without_metadata(_without_wrappers(t)), "\n\n\n", r"\n{3,}", "\n\n"))

    found = bound(trim(text), lambda t: F.when(role == "user", said(t)).otherwise(t))
    return F.when(role.isNotNull(), bound(found, lambda t: F.when(t != "", t)))


_TRIM = re.compile("^(?:\\s|\ufeff)+|(?:\\s|\ufeff)+$")
_WRAPPER_LINE = re.compile(WRAPPER + r"(?:\s|$)?", re.IGNORECASE)
_TOLD_LINE = re.compile("^(?:" + "|".join(rf"{t}\.?" for t in TOLD) + ")$", re.IGNORECASE)
_TOLD_INLINE = re.compile("^(?:" + "|".join([rf"{SUBAGENT}.*?(?:(?<=\.)\s+|$)", *[rf"{t}\.?\s*" for t in TOLD]]) + ")+", re.IGNORECASE)
_SUBAGENT_LINE = re.compile(f"^{SUBAGENT}", re.IGNORECASE)
_BODY = re.compile(r'"(?:[^"\\]|\\[\s\S])*+"|[{}"]')


def one_object(body: str) -> bool:
    """Whether the body is a single object by its braces, those in strings aside."""
    body = body.strip()
    if not (body.startswith("{") and body.endswith("}")):
        return False
    depth = 0
    for m in _BODY.finditer(body):
        if m[0] == '"':
            return False  # a string without an end
        depth += (m[0] == "{") - (m[0] == "}")
        if depth <= 0 and m.end() < len(body):
            return False
    return depth == 0


def without_json_blocks(text: str) -> str:
    """Without fenced JSON objects that a label marks as metadata, or that name both a message and its sender."""
    out, at = [], 0
    while (fence := text.find("```json", at)) >= 0 and (close := text.find("```", fence + 7)) >= 0:
        body, cut = text[fence + 7 : close], close + 3
        if one_object(body):
            label = re.search(BLOCK_LABEL, text[max(at, fence - LABEL_REACH) : fence])
            if label:
                cut = fence - len(label[0])
            elif re.search(r'"message_id"\s*:', body) and re.search(r'"sender_id"\s*:', body):
                cut = fence
        out.append(text[at:cut])
        at = close + 3
    return "".join([*out, text[at:]])


def without_envelope(text: str) -> str:
    """A message without the lines and blocks of the channel that brought it."""
    out, leading, wrapped, after_wrapper = [], True, False, False
    for raw in text.split("\n"):
        line = _TRIM.sub("", raw)
        if not leading:
            out.append(raw)
        elif wrapper := _WRAPPER_LINE.match(line):
            wrapped = after_wrapper = True
            inner = _TOLD_INLINE.sub("", _TRIM.sub("", line[wrapper.end() :]))
            out.append(_TRIM.sub("", re.sub(r"\s{2,}", " ", inner)))
        elif not line:
            out.append("")
        elif _TOLD_LINE.match(line):
            out.append("" if wrapped else raw)
        elif after_wrapper and _SUBAGENT_LINE.match(line):
            out.append("")
        else:
            leading = False
            out.append(raw)
    cleaned = without_json_blocks(re.sub(SYSTEM_LINE, "", "\n".join(out)))
    return _TRIM.sub("", re.sub(r"\n{3,}", "\n\n", cleaned))


_STRING = re.compile(r'"((?:[^"\\]|\\(?:[\s\S]|\Z)|"(?!\s*(?:[,}\]:]|\Z)))*+)("?)|,(?=\s*[}\]])')
_INSIDE = re.compile(r'\\[\s\S]|["\n\r\t]')
_AS = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def repaired(text: str) -> str:
    """JSON with quotes, line ends and tabs inside strings escaped, and without commas before a closing bracket.

    A quote ends a string if a comma, colon or closing bracket, or nothing, comes next.
    """

    def mend(m: re.Match) -> str:
        if m[1] is None:
            return ""
        return '"' + _INSIDE.sub(lambda x: _AS.get(x[0], x[0]), m[1]) + m[2]

    return _STRING.sub(mend, text)


def extracted(text: str) -> str | None:
    """The JSON of a model's answer: after its reasoning, inside the first fence, or from the first brace to the one that closes it."""
    low = text.lower().rfind("</think>")
    if low >= 0:
        text = text[low + len("</think>") :].strip()
    fence = re.search(r"```(?:json)?\s*\n?([\s\S]*?)```", text)
    if fence:
        return fence[1].strip()
    first, depth = text.find("{"), 0
    for m in re.finditer("[{}]", text[first:]) if first >= 0 else ():
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return text[first : first + m.end()]
    return None


def usable(text: str) -> str | None:
    """Valid JSON of an answer, repaired where it must be, or None."""
    found = extracted(text)
    for candidate in () if found is None else (found, repaired(found)):
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None


def _batched(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return of


envelope_free, repaired_json, extracted_json, usable_json = map(_batched, (without_envelope, repaired, extracted, usable))
