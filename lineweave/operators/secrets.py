"""Secret assignments: key, quoted value and line, without obvious placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_from_hits, hit, rule_id
from ..functions.fixed_values import SECRET_KEY_WORDS, SECRET_PLACEHOLDERS
from ..functions.text import contains_any
from .lines import explode_lines, unnest

# key = "value", key: 'value' and "key": "value"
ASSIGNMENT = (
    r"(?i)([A-Za-z0-9_.-]*(?:" + "|".join(SECRET_KEY_WORDS) + r")[A-Za-z0-9_.-]*)[\"']?"
    r"[ \t]*[:=][ \t]*(?:\"([^\"]+)\"|'([^']+)')"
)


def is_placeholder(value: Column) -> Column:
    return contains_any(F.lower(value), SECRET_PLACEHOLDERS) | F.rlike(value, F.lit(r"\A\$\{[^}]*\}\z"))


def secret_assignments(files: DataFrame, *carry: str, content: str = "content") -> DataFrame:
    """``carry, line, key, value`` for each assignment of a quoted value to a secret-like key.

    Lines are thinned by plain word tests before the pattern runs; nothing is shuffled.
    """
    lines = explode_lines(files, *carry, content=content)
    likely = lines.filter(contains_any(F.lower("text"), SECRET_KEY_WORDS) & F.rlike("text", F.lit("[:=]")))
    matched = likely.select(*carry, "line", F.regexp_extract_all("text", F.lit(ASSIGNMENT), F.lit(0)).alias("_all"))
    pairs = unnest(matched, "_all", "_pair", *carry, "line").select(
        *carry, "line",
        F.regexp_extract("_pair", ASSIGNMENT, 1).alias("key"),
        F.concat(F.regexp_extract("_pair", ASSIGNMENT, 2), F.regexp_extract("_pair", ASSIGNMENT, 3)).alias("value"),
    )
    return pairs.filter(~is_placeholder(F.col("value")))


def secret_findings(assignments: DataFrame, *carry: str) -> DataFrame:
    """The assignments as ``possible-secret`` findings with their line."""
    hits = F.array(hit(rule_id("file", "possible-secret"), F.col("line")))
    return findings_from_hits(assignments.select(*carry, hits.alias("_hits")), "_hits", *carry)
