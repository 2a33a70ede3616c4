"""Scores of rows and hits as columns. Ages are in days; times are milliseconds; `now` is given."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
# Fixed values of the scoring rules.
HALF_LIFE, MODULATION = 30.0, 1.5
BETA = {"core": 0.8, "working": 1.0, "peripheral": 1.3}
TIER_FLOOR = {"core": 0.9, "working": 0.7, "peripheral": 0.5}
RECENCY_WEIGHT, FREQUENCY_WEIGHT, INTRINSIC_WEIGHT = 0.4, 0.3, 0.3
STALE_BELOW, BOOST_MIN = 0.3, 0.3


def unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def days(now: Column, at: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - at) / F.lit(float(DAY)))


def by_tier(tier: Column, values: dict[str, float]) -> Column:
    return F.when(tier == "core", values["core"]).when(tier == "peripheral", values["peripheral"]).otherwise(values["working"])


def weibull_recency(importance: Column, tier: Column, dynamic: Column, last_active: Column, now: Column) -> Column:
    base = F.when(dynamic, HALF_LIFE / 3).otherwise(HALF_LIFE)
    rate = F.lit(math.log(2)) / (base * F.exp(MODULATION * importance))
    return F.exp(-rate * F.pow(days(now, last_active), by_tier(tier, BETA)))


def frequency(accesses: Column, created: Column, last_active: Column) -> Column:
    base = 1 - F.exp(-accesses / 5)
    gap = F.greatest(F.lit(1.0), (last_active - created) / F.lit(float(DAY))) / F.greatest(accesses - 1, F.lit(1))
    return F.when(accesses <= 1, base).otherwise(base * (0.5 + 0.5 * F.exp(-gap / 30)))


def composite(recency: Column, freq: Column, intrinsic: Column) -> Column:
    return RECENCY_WEIGHT * recency + FREQUENCY_WEIGHT * freq + INTRINSIC_WEIGHT * intrinsic


def search_boost(tier: Column, comp: Column, recency: Column) -> Column:
    floor = F.greatest(by_tier(tier, TIER_FLOOR), comp, recency)
    return F.least(F.lit(1.0), F.greatest(F.lit(BOOST_MIN), BOOST_MIN + (1 - BOOST_MIN) * floor))


def next_tier(tier: Column, accesses: Column, comp: Column, importance: Column, created: Column, now: Column) -> Column:
    """The tier a row moves to, or null where it stays."""
    age = (now - created) / F.lit(float(DAY))
    return (
        F.when((tier == "peripheral") & (accesses >= 3) & (comp >= 0.4), F.lit("working"))
        .when((tier == "working") & (accesses >= 10) & (comp >= 0.7) & (importance >= 0.8), F.lit("core"))
        .when((tier == "working") & ((comp < 0.15) | ((age > 60) & (accesses < 3))), F.lit("peripheral"))
        .when((tier == "core") & (comp < 0.15) & (accesses < 3), F.lit("working"))
    )


def recency_boost(score: Column, at: Column, now: Column) -> Column:
    return unit(score + 0.1 * F.exp(-(now - at) / F.lit(float(DAY)) / 14))


def importance_weight(score: Column, importance: Column) -> Column:
    return unit(score * (0.7 + 0.3 * F.coalesce(importance, F.lit(0.7))))


def length_norm(score: Column, length: Column, is_corpus: Column, anchor: int = 500) -> Column:
    return F.when(is_corpus, score).otherwise(unit(score / (1 + 0.5 * F.log2(F.greatest(length / anchor, F.lit(1.0))))))


def effective_half_life(base: Column, accesses: Column, last: Column, now: Column, factor: float = 0.5, most: float = 3.0) -> Column:
    fresh = accesses * F.exp(-days(now, last) * math.log(2) / 30)
    longer = F.least(base + base * factor * F.log1p(fresh), base * most)
    return F.when(accesses <= 0, base).otherwise(longer)


def time_decay(score: Column, at: Column, half_life: Column, is_corpus: Column, now: Column) -> Column:
    return F.when(is_corpus, score).otherwise(unit(score * (0.5 + 0.5 * F.exp(-(now - at) / F.lit(float(DAY)) / half_life))))


def rerank_floor(score: Column, lexical: Column, unreturned: Column) -> Column:
    b = F.coalesce(lexical, F.lit(0.0))
    kept, low = F.when(b >= 0.75, 0.95).when(b >= 0.6, 0.9).otherwise(0.5), F.when(b >= 0.75, 1.0).when(b >= 0.6, 0.95).otherwise(0.8)
    return score * F.when(unreturned, low).otherwise(kept)


def logistic(age: Column, midpoint: Column, k: Column) -> Column:
    safe_mid, safe_k = F.when(midpoint > 0, midpoint).otherwise(1.0), F.when(k > 0, k).otherwise(0.1)
    return 1 / (1 + F.exp(safe_k * (F.greatest(F.lit(0.0), age) - safe_mid)))


def reflection_score(age: Column, midpoint: Column, k: Column, weight: Column, quality: Column, fallback: Column) -> Column:
    return logistic(age, midpoint, k) * F.when(weight > 0, weight).otherwise(1.0) * unit(quality) * F.when(fallback, 0.75).otherwise(1.0)


def line_quality(lines: Column) -> Column:
    return F.when(lines <= 0, 0.2).otherwise(F.least(F.lit(1.0), 0.55 + F.least(F.lit(6), lines) * 0.075))


def deep_score(importance: Column, confidence: Column, accesses: Column, at: Column, now: Column, recalls: int = 3, half_life: float = 14.0) -> Column:
    access = F.least(F.lit(1.0), accesses / float(max(1, recalls * 2)))
    return unit(importance * 0.45 + confidence * 0.2 + access * 0.25 + F.exp(-days(now, at) / max(1.0, half_life)) * 0.1)


def canonical_score(importance: Column, length: Column, at: Column) -> Column:
    return importance * 10 + F.least(F.lit(2.0), length / 400) + at / 1e13


def lexical_hit(query: Column, text: Column, weight: float) -> Column:
    """0 unless the text holds the query; both are to be normalised."""
    hit = F.least(F.lit(0.95), 0.72 + F.length(query) * 0.02) * weight
    return F.when((query != "") & F.contains(text, query), hit).otherwise(0.0)


def recency_gap(latest: Column, now: Column, half_life: float) -> Column:
    gap = days(now, latest)
    return F.when(latest.isNull() | (latest <= 0), 1.0).otherwise(unit(1 - F.exp(-math.log(2) / half_life * gap)))


def score_to_cosine(score: Column) -> Column:
    return 2 - 1 / score


def category_boost(score: Column, category: Column, intent: Column, by: float = 1.15) -> Column:
    """More for hits of the categories that a query intends."""
    return F.when(F.array_contains(intent["categories"], category), F.least(F.lit(1.0), score * by)).otherwise(score)


def rerank_blend(score: Column, reranked: Column, lexical: Column) -> Column:
    """A reranker's score (null: not returned) blended with the fused one, not below the floor of strong lexical hits."""
    blend = F.when(reranked.isNotNull(), 0.6 * reranked + 0.4 * score).otherwise(0.8 * score)
    return F.greatest(rerank_floor(score, lexical, reranked.isNull()), F.least(F.lit(1.0), blend))


def cosine_rerank(score: Column, cosine: Column) -> Column:
    return unit(0.7 * score + 0.3 * cosine)


def likeness_band(score: Column, version: float = 0.95, same: float = 0.98) -> Column:
    """What a best match means: the same memory, a newer version of it, or another."""
    return F.when(score > same, "duplicate").when(score > version, "supersede").otherwise("new")
