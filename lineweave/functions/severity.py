"""Severity folding, ranking and finding retention predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import SEVERITY_ALIASES, SEVERITY_RANKS
from .text import trimmed


def normalize_severity(severity: Column) -> Column:
    """Fold aliases; anything unknown counts as ``info``."""
    folded = F.when(severity.isin(*SEVERITY_RANKS), severity)
    for alias, target in SEVERITY_ALIASES.items():
        folded = folded.when(severity == alias, F.lit(target))
    return folded.otherwise(F.lit("info"))


def external_severity(severity: Column) -> Column:
    """Severity of a finding from outside: a known name in any case, else ``info``."""
    name = F.lower(trimmed(severity))
    return F.when(name.isin(*SEVERITY_RANKS), name).otherwise(F.lit("info"))


def rank_of(severity: Column) -> Column:
    """5 (critical) to 1; unknown names rank lowest."""
    ranked = None
    for name, rank in SEVERITY_RANKS.items():
        if rank > 1:
            ranked = (F if ranked is None else ranked).when(severity == name, F.lit(rank))
    return ranked.otherwise(F.lit(1))


def severity_rank(severity: Column) -> Column:
    return rank_of(normalize_severity(severity))
