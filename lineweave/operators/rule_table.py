"""Line rules kept as rows of a table, versioned, and used like a rule pack.

A rule fires on a line that holds one of its ``has`` words, one of its ``also`` words if there are any, and none of its
``without`` words; ``view`` says whether the line is read as it is (``raw``) or in lower case (``lower``), and
``languages`` restricts it. Each row carries the version it came in with; a later row of the same rule replaces it, or takes it back
(``withdrawn``). A line is searched once for the words of all rules of a view, and only lines that hold a word
meet the rules, which are one constant array, so hundreds of rules cost about as much as ten.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import FINDING_TYPE, PLANES, no_findings
from ..functions.text import let
from ..functions.words import WordSet
from .lines import unnest_findings
from .rulepack import AFTER_BUILT_IN

RULE_SCHEMA = ("rule string, version int, withdrawn boolean, severity string, category string, message string, "
               "languages array<string>, view string, has array<string>, also array<string>, without array<string>")
MAX_RULES = 20_000  # a table of rules is part of the plan
VIEWS = ("raw", "lower")


@dataclass(frozen=True)
class RowRule:
    rule: str
    severity: str
    category: str
    message: str
    view: str
    has: tuple[str, ...]
    also: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()


def rules_at(table: DataFrame, version: int) -> DataFrame:
    """The rules in force at a version: the newest row of each rule, unless it was withdrawn."""
    last = table.filter(F.col("version") <= version).groupBy("rule").agg(
        F.max_by(F.struct(*[F.col(c) for c in table.columns if c != "rule"]), "version").alias("_r"))
    return last.select("rule", "_r.*").filter(~F.coalesce("withdrawn", F.lit(False)))


class TableRules:
    """The rules of a table at one version, as a pack for ``ReviewOptions.rule_packs`` or for a line table."""

    def __init__(self, name: str, rules: list[RowRule]):
        if bad := [r.rule for r in rules if r.view not in VIEWS or not r.has]:
            raise ValueError(f"rules without words or with an unknown view: {bad[:5]}")
        self.name, self.rules = name, sorted(rules, key=lambda r: r.rule)
        self._words = {v: WordSet(w for r in rules if r.view == v for w in (*r.has, *r.also, *r.without)) for v in VIEWS}

    @classmethod
    def read(cls, table: DataFrame, name: str, version: int) -> TableRules:
        rows = rules_at(table, version).limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        return cls(name, [RowRule(r["rule"], r["severity"], r["category"], r["message"], r["view"] or "raw", tuple(r["has"] or ()),
                                  tuple(r["also"] or ()), tuple(r["without"] or ()), tuple(r["languages"] or ())) for r in rows])

    def _array(self, view: str) -> Column:
        """The rules of a view, each word list widened by the words that begin with one of its own (see ``WordSet``)."""
        words = self._words[view].words

        def telling(own):
            return [w for w in words if any(w.startswith(o) for o in own)]

        rows = [{"rule": r.rule, "severity": r.severity, "category": r.category, "message": r.message, "nth": n,
                 "languages": list(r.languages), "has": telling(r.has), "also": telling(r.also), "without": telling(r.without)}
                for n, r in enumerate(self.rules) if r.view == view]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:string,severity:string,category:string,message:string,nth:int,"
                           "languages:array<string>,has:array<string>,also:array<string>,without:array<string>>>")

    def findings_of_line(self, text: Column, language: Column, line: Column) -> Column:
        """Findings of one line."""
        def fires(rule: Column, found: Column) -> Column:
            def any_of(name: str) -> Column:
                return F.arrays_overlap(found, rule[name])
            return (any_of("has") & ((F.size(rule["also"]) == 0) | any_of("also")) & ~any_of("without")
                    & ((F.size(rule["languages"]) == 0) | F.coalesce(F.array_contains(rule["languages"], language), F.lit(False))))

        def finding(rule: Column) -> Column:
            values = {"line": line, "column": F.lit(None), "source": F.lit(f"rule-table:{self.name}"), "origin": F.lit("registry"),
                      "emitted": F.struct(F.lit(PLANES["registry"]).alias("plane"), F.lit(AFTER_BUILT_IN).alias("step"), line.alias("at"),
                                          rule["nth"].alias("nth"))}
            return F.struct(*[values.get(f.name, rule[f.name] if f.name not in values else None).cast(f.dataType).alias(f.name)
                              for f in FINDING_TYPE])

        def of_view(view: str) -> Column:
            return let(self._words[view].found(F.lower(text) if view == "lower" else text), lambda found: F.when(
                F.size(found) > 0, F.transform(F.filter(self._array(view), lambda r: fires(r, found)), finding)).otherwise(no_findings()))

        parts = [of_view(view) for view in VIEWS if self._words[view].words]
        return F.concat(*parts) if parts else no_findings()

    def findings_in_row(self, views: str, language: Column) -> Column:
        """Findings of a file that stays one row, from its array of viewed lines."""
        return F.flatten(F.transform(views, lambda v: self.findings_of_line(v["text"], language, v["line"])))

    def findings(self, lines: DataFrame, *carry: str) -> DataFrame:
        """Findings of a line table ``language, line, text``; no shuffle."""
        found = self.findings_of_line(F.col("text"), F.col("language"), F.col("line"))
        return unnest_findings(lines.select(*carry, found.alias("_found")), "_found", *carry)
