"""Tiers, strictness levels and the split by confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import LEVELS, STRONG_TIER


def classify_tier(score: Column, possible: Column, strong: float = STRONG_TIER) -> Column:
    return F.when(score >= strong, "STRONG").when(score >= possible, "POSSIBLE").otherwise("WEAK")


def token_containment(query_tokens: Column, entity_tokens: Column) -> Column:
    return F.coalesce(F.arrays_overlap(query_tokens, entity_tokens), F.lit(False))


def passes_strictness(lexical: Column, containment: Column, level: str) -> Column:
    return (lexical >= LEVELS[level]["min_lexical"]) | containment


def is_kept(score: Column, lexical: Column, containment: Column, level: str) -> Column:
    return (score >= LEVELS[level]["floor"]) & passes_strictness(lexical, containment, level)


def is_primary(score: Column, lexical: Column, containment: Column, level: str) -> Column:
    return is_kept(score, lexical, containment, level) & (score >= LEVELS[level]["display_floor"])


def verdicts(score: Column, lexical: Column, containment: Column) -> tuple[Column, Column]:
    """Names of the levels that keep the match, and of those that show it as primary."""
    kept = F.array_compact(F.array(*[F.when(is_kept(score, lexical, containment, name), name) for name in LEVELS]))
    primary = F.array_compact(F.array(*[F.when(is_primary(score, lexical, containment, name), name) for name in LEVELS]))
    return kept, primary


def levels(spark: SparkSession) -> DataFrame:
    """The levels as a table, for joins by level."""
    rows = F.array(*[F.struct(F.lit(n).alias("level"), *[F.lit(float(v)).alias(k) for k, v in c.items()]) for n, c in LEVELS.items()])
    return spark.range(1).select(F.inline(rows))


def partition_by_confidence(matches: DataFrame, level: str) -> DataFrame:
    """Kept matches with primary, whether they are shown first."""
    args = (F.col("score"), F.col("lexical_similarity"), F.col("token_containment"))
    return matches.where(is_kept(*args, level)).withColumn("primary", is_primary(*args, level))
