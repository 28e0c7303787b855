"""Rules that come from a table, and analyzers that take part in the review."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lineweave.operators.analyzers import Analyzer
from lineweave.operators.rule_table import RULE_SCHEMA, RowRule, TableRules, rules_at
from lineweave.plans import incremental, report
from lineweave.plans.policies import policy_named
from lineweave.plans.review import ReviewOptions, review

SCAN = ReviewOptions(rule_set="scan")


def row(rule, version, has=("x",), withdrawn=False, view="raw", also=None, without=None, languages=None):
    return (rule, version, withdrawn, "high", "style", f"about {rule}", languages, view, list(has), also, without)


def test_versions(spark):
    table = spark.createDataFrame([row("a", 1), row("b", 1), row("b", 3, withdrawn=True), row("c", 2), row("a", 2, ("y",)), row("b", 5, ("z",))],
                                  RULE_SCHEMA)
    at = {v: {r["rule"]: r["has"] for r in rules_at(table, v).collect()} for v in range(6)}
    assert at == {0: {}, 1: {"a": ["x"], "b": ["x"]}, 2: {"a": ["y"], "b": ["x"], "c": ["x"]}, 3: {"a": ["y"], "c": ["x"]},
                  4: {"a": ["y"], "c": ["x"]}, 5: {"a": ["y"], "b": ["z"], "c": ["x"]}}
    assert TableRules.read(table, "t", 0).rules == []
    with pytest.raises(ValueError):
        TableRules("t", [RowRule("r", "low", "c", "m", "raw", ())])


def test_rules_against_plain_python(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abAB(") for _ in range(rng.randint(1, 3)))
    rules = []
    for n in range(60):
        low = rng.random() < 0.5
        some = lambda k: tuple(w.lower() if low else w for w in (make() for _ in range(k)))
        rules.append(RowRule(f"r{n:02d}", "low", "c", "m", "lower" if low else "raw", some(rng.randint(1, 3)), some(rng.choice([0, 0, 1])),
                             some(rng.choice([0, 1])), rng.choice([(), ("c",), ("c", "go")])))
    lines = [(rng.choice(["c", "go", "java", None]), n, "".join(rng.choice("abAB( ") for _ in range(rng.randint(0, 12)))) for n in range(300)]
    got = sorted((r["line"], r["rule"]) for r in TableRules("t", rules).findings(
        spark.createDataFrame(lines, "language string, line int, text string")).collect())
    want = []
    for language, n, raw in lines:
        for r in rules:
            text = raw.lower() if r.view == "lower" else raw
            if (any(w in text for w in r.has) and (not r.also or any(w in text for w in r.also))
                    and not any(w in text for w in r.without) and (not r.languages or language in r.languages)):
                want.append((n, r.rule))
    assert got == sorted(want) and want


def test_table_rules_take_part_in_the_review(spark, files):
    rules = TableRules("house", [RowRule("no-shell", "high", "security", "Shell", "lower", ("exec",), languages=("python",))])
    options = replace(SCAN, rule_packs=(rules,))
    result = review(files(("a.py", "ok\nEXEC x\n"), ("b.rs", "exec")), policy_named("quick"), options)
    assert [(r["path"], r["rule"], r["line"], r["source"]) for r in result.findings.collect()] == [("a.py", "no-shell", 2, "rule-table:house")]
    other = replace(SCAN, rule_packs=(TableRules("house", [replace(rules.rules[0], has=("exec(",))]),))
    assert incremental.ruleset_version("quick", "scan", options=options) != incremental.ruleset_version("quick", "scan", options=other)


def test_analyzers_take_part_in_the_review(spark, files):
    def long_lines(path, content):
        for n, line in enumerate(content.split("\n"), 1):
            if line == "boom":
                raise KeyError("no such line")
            if len(line) > 10:
                yield ("too-long", "WARNING", "style", f"{path} has {len(line)}", n)

    def noisy(path, content):
        return [("n" * 300, "high", None, None, None)] * 501

    corpus = files(("a.py", "secret\nthis is a long line\n"), ("b.py", "secret\nboom"), ("c.py", "this is a long line"),
                   ("d.rs", "secret and a long line"), ("e.go", "password"))
    options = replace(SCAN, analyzers=(Analyzer("lengths", "python", long_lines), Analyzer("noise", "go", noisy)))
    result = review(corpus, policy_named("quick"), options)
    found = {(r["path"], r["rule"][:8], r["severity"], r["line"], r["source"]) for r in result.findings.collect() if r["origin"] == "external"}
    assert found == {("a.py", "too-long", "info", 2, "analyzer:lengths"), ("e.go", "nnnnnnnn", "high", None, "analyzer:noise")}
    entries = {r["path"]: r["findings"] for r in result.file_entries().collect()}
    assert len(entries) == 5 and len(entries["e.go"]) >= 501 and {len(f["rule"]) for f in entries["e.go"] if f["origin"] == "external"} == {256}
    said = {r["path"]: r["message"] for r in report.diagnostics(result).collect()}
    assert said == {"b.py": "analyzer lengths b.py: KeyError: 'no such line'", "e.go": "analyzer noise e.go: 501 findings, more than 500"}
    assert report.report_row(result).first().severity_breakdown.high >= 501
    plan = result.entries._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert review(corpus, policy_named("quick"), replace(options, fast=True)).findings.filter("origin = 'external'").count() == 0
    assert incremental.ruleset_version("quick", options=options) != incremental.ruleset_version("quick", options=SCAN)
