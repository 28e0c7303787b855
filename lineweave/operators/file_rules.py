"""Rules on a whole text: one projection, no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.findings_schema import hit, no_hits, rule_id
from ..functions.fixed_values import FILE_RULES, LARGE_FILE_BYTES
from ..functions.text import contains_any

FAST_RULES = ("todo-comment", "unsafe-usage")
NOT_FOR_KERNEL = ("todo-comment", "possible-secret")


def file_rule_predicates(content: Column) -> dict[str, Column]:
    lowered = F.lower(content)
    return {
        "todo-comment": F.contains(content, F.lit("TODO")),
        "unsafe-usage": F.contains(content, F.lit("unsafe")),
        "possible-secret": contains_any(lowered, ("password", "secret")),
        "large-file": F.octet_length(content) > LARGE_FILE_BYTES,
        "hardcoded-value": contains_any(lowered, ("api_key", "token", "password")),
    }


def file_rule_hits(content: Column, enabled=None, kernel: bool = False, fast: bool = False) -> Column:
    """Hits of the file rules.

    ``enabled`` lists the rules to run (None: all).  Fast mode plans only the two cheapest.
    """
    predicates = file_rule_predicates(content)
    hits = []
    for text in FILE_RULES:
        wanted = enabled is None or text.name in enabled
        if wanted and not (kernel and text.name in NOT_FOR_KERNEL) and (not fast or text.name in FAST_RULES):
            hits.append(F.when(predicates[text.name], hit(rule_id("file", text.name))))
    return F.array_compact(F.array(*hits)) if hits else no_hits()
