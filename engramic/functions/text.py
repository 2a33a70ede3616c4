"""Text helpers that other functions build on: trimming, ASCII word boundaries, spaces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, also at the ends of a text.
SPACE = r"[\s\p{Z}\x{FEFF}\x0B]"
#: The same characters.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    r"""The pattern for Spark, with `\b` between ASCII word characters only."""
    return pattern.replace(r"\b", _EDGE)


def _whole(pattern: str) -> bool:
    """Whether the pattern has no alternatives outside of its groups."""
    rest = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while "(" in rest:
        rest = re.sub(r"\([^()]*\)", "", rest)
    return "|" not in rest


def _in_word(pattern: str) -> bool:
    """Whether a pattern surely begins with an ASCII word character: it, or each alternative of the group that it begins with."""
    group = re.match(r"\((?:\?:)?((?:[^()]|\([^()]*\))*)\)(?![?*{])", pattern)
    parts = re.sub(r"\([^()]*\)", "(", group[1]).split("|") if group else [pattern]
    return all(re.match(r"[A-Za-z0-9_](?![?*{])", p) for p in parts)


def any_of(text: Column, patterns: list[str]) -> Column:
    """True where one of the patterns is found, without regard to case; letters beyond ASCII in patterns are in lower case.

    What many patterns begin with, a word boundary or a letter beyond ASCII, is looked for before any of them is tried.
    """
    edged = [p for p in patterns if p.startswith(r"\b") and _whole(p)]
    far = [p for p in patterns if re.fullmatch(r"\(?[^\x00-\x7f]+(?:\|[^\x00-\x7f]+)*\)?", p)]
    # before a word character, a boundary is where none comes before
    sides = [("(?<![A-Za-z0-9_])", [p for p in edged if _in_word(p[2:])]), (_EDGE, [p for p in edged if not _in_word(p[2:])])]
    parts = [f"{side}(?:{'|'.join(java(p[2:]) for p in some)})" for side, some in sides if some]
    parts += [r"(?=[^\x00-\x7F])(?:" + "|".join(far) + ")"] if far else []
    return F.lower(text).rlike("(?i)" + "|".join([*parts, *(f"(?:{java(p)})" for p in patterns if p not in edged + far)]))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def replaced_if(text: Column, mark: str, pattern: str, by: str) -> Column:
    """``regexp_replace`` of texts that hold ``mark``, without which the pattern finds nothing."""
    return bound(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, pattern, by)).otherwise(t))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, an ellipsis in place of the rest."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))
