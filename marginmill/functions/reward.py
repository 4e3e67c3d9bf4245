"""Reward columns: length band, composite and verifiable rewards, and their guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as texts

# Fixed values.
PAIR_WEIGHTS = (0.7, 0.2, 0.1)
VERIFIED_WEIGHTS = (0.6, 0.3, 0.1)
BETA, CLEAN_PENALTY = 1.5, 0.35


def length_score(text: Column) -> Column:
    """Rises to 1 at 150 characters, stays to 1000, falls to 0 at 2500."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 150, n / 150).when(n <= 1000, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (n - 1000) / 1500))


def pair_score(verdict: Column) -> Column:
    return F.when(verdict == "A", 1.0).when(verdict == "B", 0.0).otherwise(0.5)


def grounding(review: Column, diff: Column, stop: list[str]) -> Column:
    """1 less the share of backticked names that the diff's hunks lack."""
    return F.greatest(F.lit(0.0), 1 - texts.unknown_name_ratio(review, diff, stop))


def composite(verdict: Column, grounding: Column, text: Column) -> Column:
    """Zero for empty or placeholder reviews."""
    empty = F.trim(F.coalesce(text, F.lit(""))).isin("", "...")
    a, b, c = PAIR_WEIGHTS
    return F.when(empty, 0.0).otherwise(a * pair_score(verdict) + b * grounding + c * length_score(text))


def f_beta(recall: Column, precision: Column, beta: float = BETA) -> Column:
    low = beta**2 * precision + recall
    return F.when(low <= 0, 0.0).otherwise((1 + beta**2) * precision * recall / low)


def components(n_defects: Column, caught: Column, claims: Column, grounding: Column, text: Column) -> dict[str, Column]:
    """recall, precision, quality, fp_rate and reward; null where a row of its kind has none."""
    labeled = n_defects > 0
    recall = F.when(labeled, caught / n_defects)
    precision = F.when(labeled, F.when(claims > 0, F.least(F.lit(1.0), caught / claims)).otherwise(0.0))
    quality = F.when(labeled, f_beta(recall, precision)).otherwise(F.greatest(F.lit(0.0), 1 - CLEAN_PENALTY * claims))
    a, b, c = VERIFIED_WEIGHTS
    return {"recall": recall, "precision": precision, "quality": quality, "fp_rate": F.when(~labeled, (claims > 0).cast("double")), "reward": a * quality + b * grounding + c * length_score(text)}


def unfinished(raw: Column) -> Column:
    return F.contains(raw, F.lit("<think>")) & ~F.contains(raw, F.lit("</think>"))


def extracted(raw: Column) -> Column:
    """The review that a rollout is scored by, without tags; '' for an unclosed thought or a placeholder."""
    bare = texts.strip(F.regexp_replace(texts.review_block(raw), "</?review>", ""))
    return F.when(unfinished(raw) | (bare == "..."), "").otherwise(bare)


def guarded(raw: Column, reward: Column) -> Column:
    """No reward for an unclosed thought, or for an empty or placeholder review."""
    return F.when(extracted(F.coalesce(raw, F.lit(""))) == "", 0.0).otherwise(reward)
