"""Scores and their rounding, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Viability:
    """Factors of the viability score."""

    type_mismatch: float = 0.8
    type_unknown: float = 0.9
    level_skip: float = 0.7
    integral: float = 1.1


def round_n(x: Column, digits: int) -> Column:
    """Rounds the scaled number half away from zero, then scales back. (Spark's own round works on the decimal text and
    differs for numbers such as 1.005.)"""
    return F.round(x * float(10**digits)) / float(10**digits)


def level_index(level: Column) -> Column:
    """Strategic 0, Tactical 1, Operational 2; anything else counts as Tactical."""
    return F.when(level == "Strategic", 0).when(level == "Operational", 2).otherwise(1)


def type_factor(source: Column, target: Column, factors: Viability = Viability()) -> Column:
    """1 for equal types or where one is Both; equality comes first, so two unknown types agree."""
    unknown = source.isin("Unknown", "None") | target.isin("Unknown", "None")
    agree = (source == target) | (source == "Both") | (target == "Both")
    return F.when(agree, 1.0).when(unknown, factors.type_unknown).otherwise(factors.type_mismatch)


def level_factor(source: Column, target: Column, factors: Viability = Viability()) -> Column:
    """1 for levels at most one step apart."""
    return F.when(F.abs(level_index(source) - level_index(target)) <= 1, 1.0).otherwise(factors.level_skip)


def viability(score: Column, types: tuple[Column, Column], levels: tuple[Column, Column], factors: Viability = Viability()) -> Column:
    return round_n(score * type_factor(*types, factors) * level_factor(*levels, factors), 2)


def viability_weight(score: Column, types, levels, contribution: Column, factors: Viability = Viability()) -> Column:
    """Viability, raised for integral contributions; rounded again."""
    raised = F.when(contribution == "INTEGRAL_TO", factors.integral).otherwise(1.0)
    return round_n(viability(score, types, levels, factors) * raised, 2)


def backoff_seconds(attempt: int, base: float = 1.0, jitter: float = 0.0) -> float:
    """base * 2^attempt, times 1 + jitter; jitter lies in [-0.25, 0.25]."""
    if not -0.25 <= jitter <= 0.25:
        raise ValueError("jitter must lie in [-0.25, 0.25]")
    return base * 2**attempt * (1 + jitter)
