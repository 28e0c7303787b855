"""User rules: Column predicates on a line, and per-language analyzers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.findings_schema import FINDING_TYPE, PLANES
from ..functions.triggers import ROW_VIEWS
from .lines import unnest_findings, with_views

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

AFTER_BUILT_IN = 100  # emission step of user rules


@dataclass(frozen=True)
class UserRule:
    """``predicate`` gets the line's views (``raw``, ``lower``, ``trim``) and returns a Column."""
    rule: str
    severity: str
    category: str
    message: str
    predicate: Callable[[dict[str, Column]], Column]
    languages: tuple[str, ...] = ()


class RulePack:
    """A list of user rules, evaluated in one projection like the built-in ones."""

    def __init__(self, name: str, rules: list[UserRule]):
        self.name, self.rules = name, list(rules)

    def findings_of_line(self, views: dict[str, Column], language: Column, line: Column) -> Column:
        hits = []
        for nth, rule in enumerate(self.rules):
            fires = rule.predicate(views)
            if rule.languages:
                fires = language.isin(*rule.languages) & fires
            values = (rule.rule, rule.severity, rule.category, rule.message, line, None,
                      f"rule-pack:{self.name}", "registry",
                      F.struct(F.lit(PLANES["registry"]), F.lit(AFTER_BUILT_IN), line, F.lit(nth)))
            struct = F.struct(*[
                (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name)
                for v, f in zip(values, FINDING_TYPE)])
            hits.append(F.when(fires, struct))
        return F.array_compact(F.array(*hits))

    def findings_in_row(self, views: str, language: Column) -> Column:
        """Findings of a file that stays one row, from its array of viewed lines."""
        return F.flatten(F.transform(views, lambda v: self.findings_of_line(
            {"raw": v["text"], "lower": v["lower"], "trim": v["trim"]}, language, v["line"])))

    def findings(self, lines: DataFrame, *carry: str) -> DataFrame:
        """Findings of a line table; no shuffle."""
        views = {name: F.col(column) for name, column in ROW_VIEWS.items() if name != "calls"}
        found = self.findings_of_line(views, F.col("language"), F.col("line"))
        return unnest_findings(with_views(lines).select(*carry, found.alias("_found")), "_found", *carry)


ANALYZER_FIELDS = "rule string, severity string, category string, message string, line int"
Analyzer = Callable[[str, str], list[tuple]]


def analyze_with(files: DataFrame, language: str, analyzer: Analyzer, *keys: str) -> DataFrame:
    """Run a Python analyzer on every file of one language, batch by batch in the tasks.

    ``analyzer(path, content)`` yields ``(rule, severity, category, message, line)``.  Its
    findings come from outside the engine: clean them with ``findings.sanitize_external``.
    """
    schema = T.StructType([files.schema[k] for k in keys] + list(T._parse_datatype_string(ANALYZER_FIELDS)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*key, *hit) for *key, path, content in batch.itertuples(index=False, name=None)
                    for hit in analyzer(path, content)]
            yield pd.DataFrame(rows, columns=schema.names)

    own = files.filter(F.col("language") == language)
    return own.select(*keys, F.col("path").alias("_path"), "content").mapInPandas(run, schema)
