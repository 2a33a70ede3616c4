"""Chunks that keep to the structure of program code, and to the limits of a model that embeds them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramic.sources import files

# Tokens that models take, shares of them for a chunk, its overlap and least size, and the share of
# Chinese, Japanese and Korean characters from which a text's limits are divided.
LIMITS = {
    "jina-embeddings-v5-text-small": 8192, "jina-embeddings-v5-text-nano": 8192, "text-embedding-3-small": 8192, "text-embedding-3-large": 8192, "text-embedding-004": 8192,
    "gemini-embedding-001": 2048, "nomic-embed-text": 8192, "all-MiniLM-L6-v2": 512, "all-mpnet-base-v2": 512,
}
USUAL_LIMIT, MOST, OVERLAP, LEAST, LINES = 8192, 0.7, 0.05, 0.1, 50
WIDE_SHARE, WIDE_DIVISOR = 0.3, 2.5
WIDE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
# What begins a unit of code, after the end of the line before it.
SCRIPT_UNIT = re.compile(r"\n[ \t]*+(?:(?:export|declare)\s++)*+(?:default\s+)?(?:(?:abstract\s+)?class\s+[$A-Z_a-z][$\w]*|(?:async\s+)?function\s+[$A-Z_a-z][$\w]*|(?:const|let|var)\s+[$A-Z_a-z][$\w]*\s*=\s*(?:async\s*)?(?:\([^)]*\)|[$A-Z_a-z][$\w]*)\s*=>)")
PYTHON_UNIT = re.compile(r"\n([ \t]*)(?:async[^\S\n]+def|def|class)[^\S\n]+\w")
#: Comments and strings, which hide what they hold, and braces; each begins with a character of its own, by which they are found fast.
_HIDDEN = r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\Z)|"(?:\\[\s\S]|[^"\\])*+(?:"|\Z)|`(?:\\[\s\S]|[^`\\])*+(?:`|\Z)"""
SCRIPT_PARTS = re.compile(_HIDDEN + r"|\{|\}")
#: The same with line ends of the code itself.
SCRIPT_LINES = re.compile(_HIDDEN + r"|\n")


def script_units(text: str) -> list[tuple[int, int]] | None:
    """Start and end of the declarations outside all braces, whole lines each; None if one of them does not close."""
    at, depth, outer, level = [], [], [], 0
    for m in SCRIPT_PARTS.finditer(text):
        c = text[m.start()]
        if c == "{":
            level += 1
            depth.append(level)
        elif c == "}":
            level = max(0, level - 1)
            depth.append(-level - 1)
            if not level:
                outer.append(m.start())
        else:
            continue
        at.append(m.start())
    ends: list[int] | None = None
    out: list[tuple[int, int]] = []
    for m in SCRIPT_UNIT.finditer("\n" + text):
        start = m.start()  # of the line: the text is one character on
        opens = bisect_left(at, start)
        if opens and depth[opens - 1] != -1:
            continue
        while opens < len(at) and depth[opens] < 0:
            opens += 1
        if opens == len(at):
            return None
        stop = text.find(";", start, at[opens])
        if stop >= 0:
            if ends is None:
                ends = [x.start() for x in SCRIPT_LINES.finditer(text) if text[x.start()] == "\n"]
            # a statement that ends before its line does has no body
            if bisect_left(ends, at[opens]) > bisect_right(ends, stop):
                return None
        closes = bisect_left(outer, at[opens])
        if closes == len(outer):
            return None
        end = text.find("\n", outer[closes] + 1) + 1 or len(text)
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out or None


def python_units(text: str) -> list[tuple[int, int]] | None:
    """Start and end of the functions and classes of the least indent, with their decorators, each up to the next."""
    # most texts begin without an indent
    base = 0 if text[:1].strip() else min((len(x) - len(x.lstrip(" \t")) for x in text.split("\n") if x.strip()), default=0)
    starts = []
    for m in PYTHON_UNIT.finditer("\n" + text):
        if len(m[1]) != base:
            continue
        start = m.start()
        while start:  # decorators stand in the lines above
            above = text.rfind("\n", 0, start - 1) + 1
            if not text[above:start].lstrip(" \t").startswith("@"):
                break
            start = above
        starts.append(start)
    return list(zip(starts, [*starts[1:], len(text)], strict=True)) if starts else None


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    return start, end


def unit_chunks(text: str, units: list[tuple[int, int]], most: int) -> list[tuple[int, int, str]] | None:
    """As many whole units as fit into each chunk, with what stands before them; None if one alone does not fit."""
    cuts = [0, *(end for _, end in units), len(text)]
    out: list[list[int]] = []
    for start, end in zip(cuts, cuts[1:], strict=False):
        a, b = trimmed(text, start, end)
        if a >= b:
            continue
        if b - a > most:
            return None
        if out and b - out[-1][0] <= most:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b, text[a:b]) for a, b in out] or None


def limits(text: str, model: str | None) -> tuple[int, int, int]:
    """Most characters, overlap and least characters of a chunk of this text for a model."""
    base = LIMITS.get(model or "", USUAL_LIMIT)
    wide = 0 if text.isascii() else len(WIDE.findall(text))
    divisor = WIDE_DIVISOR if wide and wide / len("".join(text.split())) > WIDE_SHARE else 1
    return max(200, int(base * MOST / divisor)), max(0, int(base * OVERLAP / divisor)), max(100, int(base * LEAST / divisor))


def smart_chunks(text: str | None, language: str | None, model: str | None = None) -> list[tuple[int, int, str]]:
    """Start, end and text of each chunk: by units of code where the language is known and all units fit, else by sentences and lines."""
    text = text or ""
    most, overlap, least = limits(text, model)
    units = python_units(text) if language == "python" else script_units(text) if language else None
    by_units = unit_chunks(text, units, most) if units else None
    return by_units or list(files.chunks_of(text, most, overlap, least, LINES))


def chunked(rows: DataFrame, model: str | None = None) -> DataFrame:
    """id, chunk, start, end, text of rows(id, text), within the limits of a model; null and empty texts have no chunks."""
    kind = rows.schema["id"].dataType.simpleString()
    told = rows.select("id", "text", files.code_language(F.coalesce("text", F.lit(""))).alias("language"))
    cut = lambda text, language: smart_chunks(text, language, model)
    return told.mapInArrow(lambda batches: files.cut_batches(batches, cut, ("text", "language")), f"id {kind}, chunk int, start int, end int, text string")


def long_vectors(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str | None = None) -> DataFrame:
    """id, vector of texts too long for a model: the mean of their chunks' vectors.

    ``embed`` gives rows(id, chunk, text) a vector. Sums go element by element on both sides of the shuffle.
    """
    each = embed(chunked(rows, model).select("id", "chunk", "text")).select("id", F.posexplode("vector").alias("at", "x"))
    mean = each.groupBy("id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p.x).alias("vector"))
