"""Severity, score and rank of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two rank orders of severities.
SCAN_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3, "review": 2}
FILE_RANK = {"low": 0, "medium": 1, "review": 2, "high": 3, "critical": 4}


def rank(severity: Column, order: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in order.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def classify_source(silent: Column, density: Column, shingle: Column, line: Column, run: Column) -> tuple[Column, Column]:
    """(severity, score) of a source finding by its best match; a null density means there is none."""
    score = 100 * density + 60 * shingle + 0.25 * run
    some = (density >= 0.25) & (shingle >= 0.20)
    weak = silent & (line < 0.06)
    strong_marked = (density >= 0.85) | (shingle >= 0.85)
    fair_marked = (density >= 0.60) | (shingle >= 0.70)
    critical = ((density >= 0.60) & (shingle >= 0.45)) | (shingle >= 0.70)
    high = ((density >= 0.35) & (shingle >= 0.30)) | (shingle >= 0.45)
    medium = some | (shingle >= 0.30)
    none = density.isNull()
    severity = (
        F.when(none, "low").when(weak, F.when(some, "medium").otherwise("low"))
        .when(~silent, F.when(strong_marked | fair_marked, "review").otherwise("low"))
        .when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("low")
    )
    value = (
        F.when(none, F.lit(0.0)).when(weak, score * F.when(some, 0.6).otherwise(0.3))
        .when(~silent, score * F.when(strong_marked, 1.0).when(fair_marked, 0.8).otherwise(0.5))
        .when(critical, score + 50).when(high, score + 20).otherwise(score)
    )
    return severity, F.round(value, 2)


def classify_pair(density: Column, shingle: Column, own_first: Column) -> Column:
    """Severity of a downstream finding: raised one step, high at most, if the own file came first."""
    base = F.when((density >= 0.80) & (shingle >= 0.70), 2).when((density >= 0.60) & (shingle >= 0.45), 1).otherwise(0)
    level = F.least(base + F.when(own_first, 1).otherwise(0), F.lit(2))
    return F.when(level == 2, "high").when(level == 1, "medium").otherwise("low")


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 100, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def directionality(own: Column, other: Column) -> Column:
    """Which of two ISO dates comes first; blank or null ones leave it unknown."""
    blank = own.isNull() | other.isNull() | (F.trim(own) == "") | (F.trim(other) == "")
    return F.when(blank, "unknown").when(own < other, "gcc_first").when(own > other, "upstream_first").otherwise("contemporaneous")
