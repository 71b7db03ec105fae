"""Scores of matches: confidence, weights, boosts, penalties, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
META_WEIGHTS = (0.3, 0.7)
SIGNAL_WEIGHTS = (0.2, 0.5, 0.3)
RERANK_WEIGHTS = {"semantic": 0.45, "keyword": 0.30, "popularity": 0.15, "clarity": 0.10}
REPEAT_SHARE, DECADE_SHARE = 0.8, 0.2
STRENGTHS = ((0.5, "Strong match"), (0.3, "Good match"), (0.15, "Loose match"))
#: Alternates are offered below this confidence.
ALTERNATES_BELOW = 0.7
GAP_FOR_ALTERNATES = math.log(7 / 3) / 5


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(n: Column, first: Column, second: Column) -> Column:
    """0 without matches, 0.95 for one, else a logistic of five times the gap, within 0.1 and 0.99."""
    return F.when(n == 0, 0.0).when(n == 1, 0.95).otherwise(clamp(1 / (1 + F.exp(-5 * (first - second))), 0.1, 0.99))


def similarity_or_zero(d: Column) -> Column:
    """1 - distance; a candidate that a signal lacks scores 0 there."""
    return F.coalesce(1 - d, F.lit(0.0))


def weighted(distances: list[Column], weights) -> Column:
    total = F.lit(0.0)
    for d, w in zip(distances, weights):
        total = total + similarity_or_zero(d) * w
    return total


def tag_boost(score: Column, tags: Column, preferred: Column) -> Column:
    """A tenth for each preferred tag (song tags in lower case), half at most, the score 1 at most."""
    overlap = F.size(F.filter(tags, lambda t: F.array_contains(preferred, F.lower(t))))
    return F.when(overlap > 0, F.least(F.lit(1.0), score * (1 + F.least(overlap * 0.1, F.lit(0.5))))).otherwise(score)


def repetition_penalty(penalty: float, recent: Column, avoided_decade: Column) -> Column:
    return F.when(recent, penalty * REPEAT_SHARE).otherwise(0.0) + F.when(avoided_decade, penalty * DECADE_SHARE).otherwise(0.0)


def contributions(semantic: Column, keyword: Column, popularity: Column, clarity: Column) -> dict[str, Column]:
    """Clamped signals times their weights; missing signals 0, missing or zero clarity 0.5, popularity out of 100."""
    signals = {
        "semantic": clamp(F.coalesce(semantic, F.lit(0.0))),
        "keyword": clamp(F.coalesce(keyword, F.lit(0.0))),
        "popularity": clamp(F.coalesce(popularity, F.lit(0)) / 100),
        "clarity": clamp(F.coalesce(F.nullif(clarity, F.lit(0.0)), F.lit(0.5))),
    }
    return {name: s * RERANK_WEIGHTS[name] for name, s in signals.items()}


def strength(score: Column) -> Column:
    label = F.when(score >= STRENGTHS[0][0], STRENGTHS[0][1])
    for least, name in STRENGTHS[1:]:
        label = label.when(score >= least, name)
    return label


def alternate_score(index: Column) -> Column:
    return 0.8 - 0.1 * index


def reciprocal_rank(position: Column) -> Column:
    """Of a 1-based position; 0 if there is none."""
    return F.coalesce(1.0 / position, F.lit(0.0))


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))
