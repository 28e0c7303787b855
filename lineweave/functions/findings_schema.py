"""The finding record shared by every rule plane.

Rules emit small *hits* (rule number, line, column, detail).  A hit becomes a finding by
looking its number up in one constant array, so the expressions that look at text stay
small and a rule's severity, category and message are attached in one place.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import C_FLOW_RULES, C_STYLE_RULES, FILE_RULES, JAVA_RULES, LINE_RULES, TS_RULES, RuleText
from .text import let

ORDER_FIELDS = ("plane", "step", "at", "nth")  # emission order inside a file

FINDING_TYPE = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("emitted", T.StructType([T.StructField(n, T.IntegerType()) for n in ORDER_FIELDS])),
])
FINDINGS_TYPE = f"array<{FINDING_TYPE.simpleString()}>"
HIT_TYPE = "struct<rule:int,line:int,column:int,detail:string,at:int>"
HITS_TYPE = f"array<{HIT_TYPE}>"

PLANES = {"file": 0, "registry": 1, "language": 2, "external": 3}


@dataclass(frozen=True)
class Listed:
    """A rule with its place in the emission order."""
    text: RuleText
    origin: str
    source: str
    step: int
    nth: int


def _listed() -> list[Listed]:
    rows = [Listed(t, "file", "local-rules", 0, n) for n, t in enumerate(FILE_RULES)]
    rows += [Listed(t, "registry", "rule-registry", n, n) for n, t in enumerate(LINE_RULES)]
    for rules in (TS_RULES, JAVA_RULES):
        rows += [Listed(t, "language", "worker", 0, n) for n, t in enumerate(rules)]
    rows += [Listed(t, "language", "worker:c", 0, n) for n, t in enumerate(C_STYLE_RULES)]
    rows += [Listed(t, "language", "worker:c", 2 if t.name == "missing-__init-__exit" else 1, n)
             for n, t in enumerate(C_FLOW_RULES)]
    return rows


RULES = _listed()
RULE_IDS = {(r.origin, r.text.name): i for i, r in enumerate(RULES)}


def rule_id(origin: str, name: str) -> int:
    return RULE_IDS[(origin, name)]


def sql_text(value: str) -> str:
    """A Spark SQL string literal.

    The dollar sign is written as an escape, because the parser would otherwise replace
    ``${name}`` inside the literal by a variable.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


RULE_TYPE = ("array<struct<name:string,severity:string,category:string,head:string,tail:string,"
             "source:string,origin:string,plane:int,step:int,nth:int>>")


def _rule_rows() -> str:
    rows = []
    for r in RULES:
        head, _, tail = r.text.message.partition("{n}")
        rows.append({"name": r.text.name, "severity": r.text.severity, "category": r.text.category, "head": head,
                     "tail": tail, "source": r.source, "origin": r.origin, "plane": PLANES[r.origin],
                     "step": r.step, "nth": r.nth})
    return json.dumps(rows)


def rule_array() -> Column:
    """All rules as one constant array, indexed by rule number.

    Written as one JSON literal: the planner folds it to a constant, and until then the
    plan holds one node instead of a thousand.
    """
    return F.from_json(F.lit(_rule_rows()), RULE_TYPE)


def hit(rule: Column | int, line: Column | None = None, column: Column | None = None,
        detail: Column | None = None, at: Column | None = None) -> Column:
    """One hit; ``at`` is where the rule noticed it, if that is another line."""
    none = F.lit(None)
    fields = {"rule": F.lit(rule) if isinstance(rule, int) else rule, "line": line, "column": column,
              "detail": detail, "at": at}
    return F.struct(*[(none if v is None else v).alias(k) for k, v in fields.items()]).cast(HIT_TYPE)


def no_hits() -> Column:
    return F.array().cast(HITS_TYPE)


def _worded(hit: Column, rule: Column) -> Column:
    order = F.struct(
        rule["plane"].alias("plane"), rule["step"].alias("step"),
        F.coalesce(hit["at"], hit["line"], F.lit(0)).alias("at"), rule["nth"].alias("nth"))
    message = F.concat(rule["head"], F.coalesce(hit["detail"], F.lit("")), rule["tail"])
    return F.struct(
        rule["name"].alias("rule"), rule["severity"].alias("severity"), rule["category"].alias("category"),
        message.alias("message"), hit["line"].alias("line"), hit["column"].alias("column"),
        rule["source"].alias("source"), rule["origin"].alias("origin"), order.alias("emitted"),
    ).cast(FINDING_TYPE)


def finding_of(hit: Column) -> Column:
    """The finding a hit stands for."""
    return let(F.get(rule_array(), hit["rule"]), lambda rule: _worded(hit, rule))


def findings_of(hits: Column) -> Column:
    return F.transform(hits, finding_of)


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def findings_from_hits(df: DataFrame, hits: str, *keys: str) -> DataFrame:
    """Flat findings of a table with a hit array per row.

    The outer generator is used on purpose: for an inner one the optimizer adds a
    ``size(array) > 0`` filter and pushes it below the projection that computes the array,
    which then runs twice for every row.
    """
    rows = df.select(*keys, F.explode_outer(hits).alias("_hit")).filter(F.col("_hit").isNotNull())
    named = rows.select(*keys, "_hit", F.get(rule_array(), F.col("_hit.rule")).alias("_rule"))
    return named.select(*keys, _worded(F.col("_hit"), F.col("_rule")).alias("_finding")).select(*keys, "_finding.*")
