"""Thresholds and masks over a document's unit array, as expressions in the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terseforge.functions import text as T

#: Joints between units by level: sentences by a blank, phrases and tokens carry their own.
JOINTS = {"sent": " ", "phrase": "", "token": ""}
#: What stands for a masked sentence in experiments.
SENT_MASK = "<...some content omitted.>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, however often the body uses it.

    Inside a lambda an expression would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def known_scores(units: Column) -> Column:
    """Sorted scores without nulls and NaNs."""
    return F.array_sort(F.filter(F.transform(units, lambda u: u["self_info"]), lambda x: x.isNotNull() & ~F.isnan(x)))


def percentile_of(sorted_scores: Column, ratio: float) -> Column:
    """Percentile with linear interpolation; null without scores."""
    def body(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(float(ratio))
        low = F.floor(place)
        a = F.get(s, low.cast("int"))
        b = F.get(s, F.least(low + 1, F.size(s) - 1).cast("int"))
        return F.when(F.size(s) > 0, a + (b - a) * (place - low))

    return bound(sorted_scores, body)


def threshold(units: Column, ratio: float) -> Column:
    """The score under which a unit is masked: the percentile of all units of the level in the document."""
    return percentile_of(known_scores(units), ratio)


def is_masked(score: Column, limit: Column) -> Column:
    """Strictly below; an unknown or NaN score and an unknown limit keep the unit."""
    return F.coalesce((score < limit) & ~F.isnan(score), F.lit(False))


def replacement(level: str, text: Column, lead: int = 0, mark: str = "") -> Column:
    """What stands for a masked unit: leading words and the mark for sentences, nothing else."""
    return F.concat(T.leading_words(text, lead), F.lit(mark)) if level == "sent" and lead else F.lit(mark if level == "sent" else "")


def masked_text(units: Column, ratio: float, level: str, lead: int = 0, mark: str = "") -> Column:
    """The document with its least informative units masked."""
    def body(limit: Column) -> Column:
        return F.transform(units, lambda u: F.when(is_masked(u["self_info"], limit), replacement(level, u["text"], lead, mark)).otherwise(u["text"]))

    return F.array_join(bound(threshold(units, ratio), body), JOINTS[level])


def masked_units(units: Column, ratio: float) -> Column:
    """The masked units in order."""
    low = bound(threshold(units, ratio), lambda limit: F.filter(units, lambda u: is_masked(u["self_info"], limit)))
    return F.transform(low, lambda u: u["text"])


def randomly_masked(key: Column, units: Column, ratio: float, level: str = "phrase", joint: str = " ") -> Column:
    """Each unit masked with probability ``ratio`` by the hash of key and place; joined by blanks at every level."""
    return F.array_join(F.transform(units, lambda u, i: F.when(T.hash_uniform(key.cast("string"), i.cast("string")) < ratio, replacement(level, u["text"])).otherwise(u["text"])), joint)


def reduced_ratio(reference: Column, context: Column) -> Column:
    """Share of the reference's characters that the context saves, never below 0; null for an empty reference."""
    return F.greatest(F.length(reference) - F.length(context), F.lit(0)) / F.nullif(F.length(reference), F.lit(0))
