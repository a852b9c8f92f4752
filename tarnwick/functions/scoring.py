"""Column functions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import vocab as V


def sigmoid(x: Column, slope: float = 0.6) -> Column:
    return 1 / (1 + F.exp(-slope * x))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.80, "High").when(score >= 0.65, "Medium").when(score >= 0.45, "Low").otherwise("Not found")


def shown_percent(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in V.SHOWN_PERCENT.items() for x in kv))
    return F.coalesce(F.element_at(known, label), F.lit(0))


def hybrid(vector: Column, bm25: Column, stage: Column, vector_weight: float = 0.65, bm25_weight: float = 0.35) -> Column:
    """Weighted sum; an exact hit (stage 0) has 0.95 at least."""
    mixed = vector_weight * vector + bm25_weight * bm25
    return F.when(stage == 0, F.greatest(mixed, F.lit(0.95))).otherwise(mixed)


def scaled(score: Column) -> Column:
    """A logit on 0 to 100: -5 is 0 and 5 is 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (score + 5) / 10 * 100))


def row_confidence(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), ((score + 5) / 10 * 100).cast("int")))


def floor_of(source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in V.FLOORS.items() for x in kv))
    return F.coalesce(F.element_at(known, source), F.lit(V.FLOOR_DEFAULT))


def has_answer(answer: Column, label: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) != "") & (label != "Not found")


def is_exact(match_type: Column) -> Column:
    return match_type.isin("exact", "exact_contains")


def route(collection: Column) -> Column:
    return F.when(F.lower(collection).contains("hedex"), "hedex").otherwise("3gpp")


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970 of a date or a time."""
    return F.unix_seconds(at.cast("timestamp"))
