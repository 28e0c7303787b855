"""Stateless line rules: every rule in one projection over the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_from_hits, hit, no_hits, rule_id
from ..functions.fixed_values import LINE_RULES, LINE_TRIGGERS
from ..functions.triggers import (
    ROW_VIEWS, fired_sql, gate_trigger, mask_sql, set_bits, triggers_sql, views_in, with_mask,
)
from .lines import with_views

STATELESS = tuple(text.name for text in LINE_RULES if any(t.rule == text.name for t in LINE_TRIGGERS))


def _triggers(name: str) -> list:
    return [t for t in LINE_TRIGGERS if t.rule == name]


def line_rule_predicates(language: str, views, rules=STATELESS) -> list[str]:
    """One SQL predicate per rule, on one line."""
    return [triggers_sql(_triggers(name), language, views) for name in rules]


def rule_ids(rules=STATELESS) -> list[int]:
    return [rule_id("registry", name) for name in rules]


def with_line_hits(lines: DataFrame, *carry: str, rules=STATELESS) -> DataFrame:
    """``carry, line, _hits`` of a line table ``(carry, language, line, text)``; NULL for no hits.

    The predicates run in generated code; only the few lines that hit are widened.
    """
    masked = with_mask(with_views(lines), line_rule_predicates("language", ROW_VIEWS, rules), *carry)
    fired = masked.select(*carry, "line", set_bits(F.col("_mask"), rule_ids(rules)).alias("_ids"))
    return fired.select(*carry, "line", F.transform("_ids", lambda n: hit(n, F.col("line"))).alias("_hits"))


def line_rule_findings(lines: DataFrame, *carry: str, rules=STATELESS) -> DataFrame:
    """Findings of a line table ``(carry, language, line, text)``; no shuffle."""
    return findings_from_hits(with_line_hits(lines, *carry, rules=rules), "_hits", *carry)


def gate_mask(content: str, language: str, rules=STATELESS) -> Column:
    """Bit mask of the rules whose words occur anywhere in a text.

    One native search per word and file; the lines of a file are then asked only for the
    rules that are left.
    """
    views = {"raw": content, "lower": f"lower({content})"}
    return F.expr(mask_sql([
        triggers_sql([gate_trigger(t) for t in _triggers(name)], language, views) for name in rules]))


def line_rule_hits(views: str, language: str, gate: str, rules=STATELESS) -> Column:
    """Hits of one file, from its array of viewed lines and its gate mask."""
    predicates = line_rule_predicates(language, views_in("v"), rules)
    gated = fired_sql([(n, f"({gate} & {1 << bit}) != 0 AND {p}")
                       for bit, (n, p) in enumerate(zip(rule_ids(rules), predicates))])
    fired = F.expr(f"filter(transform({views}, v -> named_struct('line', v.line, 'ids', {gated})), "
                   "x -> size(x.ids) > 0)")
    found = F.flatten(F.transform(fired, lambda x: F.transform(x["ids"], lambda n: hit(n, x["line"]))))
    return F.when(F.col(gate) != 0, found).otherwise(no_hits())
