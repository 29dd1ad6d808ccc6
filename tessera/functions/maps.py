"""Scores in JSON maps: reading, repairing, sentinels and completeness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a score below zero means.
FLOOR_PLAN, MISSING_FILE, INVALID_IMAGE, NO_ANSWER, BAD_ANSWER = -1000.0, -996.0, -997.0, -998.0, -999.0
KEYS = ("luxury", "condition", "brightness", "spaciousness")


def parse_scores(text: Column) -> Column:
    """Map of a JSON or single-quoted object of numbers; NULL if it isn't one."""
    return F.from_json(text, "map<string,double>", {"allowSingleQuotes": "true"})


def repaired(text: Column) -> Column:
    """The object of a model's answer: code fences dropped, else the first braces in the text."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", ""))
    braces = F.nullif(F.regexp_extract(bare, r"(\{[^{}]+\})", 1), F.lit(""))
    whole = F.when(bare.rlike(r"^\{[\s\S]*\}$"), parse_scores(bare))
    return F.coalesce(whole, parse_scores(braces))


def get_or(scores: Column, key: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(scores, F.lit(key)), F.lit(default))


def with_defaults(scores: Column, keys: tuple[str, ...] = KEYS, default: float = BAD_ANSWER) -> Column:
    """Map of exactly the keys."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(get_or(scores, k, default) for k in keys)))


def constant(value: float, keys: tuple[str, ...] = KEYS) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.lit(value) for _ in keys)))


def is_complete(scores: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """All keys are there and at least one score is no sentinel."""
    there = F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(scores))) == 0
    return F.coalesce(there & F.exists(F.map_values(scores), lambda v: v >= 0), F.lit(False))
