"""Whether a candidate is let into the store: five features, their weighted sum and the decision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType

from engramic.functions import rules
from engramic.functions.scoring import unit

# The presets.
WEIGHTS = {
    "balanced": {"utility": 0.1, "confidence": 0.1, "novelty": 0.1, "recency": 0.1, "type_prior": 0.6},
    "conservative": {"utility": 0.16, "confidence": 0.16, "novelty": 0.18, "recency": 0.08, "type_prior": 0.42},
    "high-recall": {"utility": 0.08, "confidence": 0.1, "novelty": 0.08, "recency": 0.14, "type_prior": 0.6},
}
THRESHOLDS = {"balanced": (0.45, 0.6), "conservative": (0.52, 0.68), "high-recall": (0.34, 0.52)}  # reject below, admit from
PRIORS = {
    "balanced": {"profile": 0.95, "preferences": 0.9, "entities": 0.75, "events": 0.45, "cases": 0.8, "patterns": 0.85},
    "conservative": {"profile": 0.98, "preferences": 0.94, "entities": 0.78, "events": 0.28, "cases": 0.78, "patterns": 0.8},
    "high-recall": {"profile": 0.96, "preferences": 0.92, "entities": 0.8, "events": 0.58, "cases": 0.84, "patterns": 0.88},
}
SIMILAR = 0.55


def type_prior(category: Column, fiction: Column, preset: str = "balanced") -> Column:
    """A category's prior; in fiction at most that of events."""
    priors = PRIORS[preset]
    raw = F.try_element_at(F.create_map(*[F.lit(x) for p in priors.items() for x in p]), category)
    return F.when(fiction, F.least(raw, F.lit(priors["events"]))).otherwise(raw)


def novelty(best: Column) -> Column:
    """1 less the greatest cosine to a match; 1 without matches."""
    return unit(1 - F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0)))


def lcs_length(left: list[str], right: list[str]) -> int:
    """By bits: one for each word of ``left``, cleared where a common subsequence grows; a word of ``right`` costs one pass of whole numbers."""
    places: dict[str, int] = {}
    for i, x in enumerate(left):
        places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(left)) - 1
    for y in right:
        if hit := row & places.get(y, 0):
            row = (row + hit | row - hit) & every
    return len(left) - row.bit_count()


@pandas_udf(IntegerType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays."""
    return pd.Series([lcs_length(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(left, right, strict=True)], dtype="int32")


def rouge_f1(left: Column, right: Column) -> Column:
    """2PR / (P + R) on the longest common subsequence of two token arrays."""
    n = lcs(left, right)
    return F.when(n > 0, 2.0 * n / (F.size(left) + F.size(right))).otherwise(0.0)


@pandas_udf(DoubleType())
def best_support(candidate: pd.Series, spans: pd.Series) -> pd.Series:
    """The best F1 of a candidate's tokens with those of a span."""

    def best(tokens: list[str], parts: list[list[str]]) -> float:
        return max((2.0 * n / (len(tokens) + len(p)) for p in parts if len(p) and (n := lcs_length(tokens, list(p)))), default=0.0)

    return pd.Series([best(list(c) if c is not None else [], list(s) if s is not None else []) for c, s in zip(candidate, spans, strict=True)])


def coverage(candidate: Column, conversation: Column) -> Column:
    """The share of a text's distinct tokens that the other has."""
    own = F.array_distinct(rules.tokens(candidate))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, rules.tokens(conversation))) / F.size(own)).otherwise(0.0)


def confidence(candidate: Column, conversation: Column) -> Column:
    spans = F.transform(rules.support_spans(conversation), rules.tokens)
    covered = coverage(candidate, conversation)
    score = unit(0.7 * best_support(rules.tokens(candidate), spans) + 0.3 * covered - 0.25 * (1 - covered))
    return F.when(F.size(rules.tokens(candidate)) > 0, score).otherwise(0.0)


def decision(features: dict[str, Column], best: Column, preset: str = "balanced") -> Column:
    """struct(score, decision, hint) of named features and the greatest cosine to a match."""
    reject, admit = THRESHOLDS[preset]
    score = sum((features[name] * w for name, w in WEIGHTS[preset].items()), F.lit(0.0))
    hint = F.when(score < reject, None).when((score >= admit) & (F.coalesce(best, F.lit(0.0)) < SIMILAR), "add").otherwise("update_or_merge")
    return F.struct(score.alias("score"), F.when(score < reject, "reject").otherwise("pass_to_dedup").alias("decision"), hint.alias("hint"))
