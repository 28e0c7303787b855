"""Line tables in blocks against the folds over whole files, which have plain-Python simulations of their own."""

import random

import pytest
from pyspark.sql import functions as F

from lineweave.functions.findings_schema import findings_from_hits
from lineweave.operators import block_rules, block_scan, c_rules
from lineweave.operators.lines import viewed

from test_brute_force import C_POOL, SPAN_POOL

C_LINES = C_POOL + ["spin_unlock(&a);", "mutex_unlock(b->m);", "rcu_read_unlock();", "msleep(1);", "return 0;", "", None]


def files(spark, pool, languages, count, seed, giant=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        language = languages[i % len(languages)]
        size = giant if i < len(languages) else rng.randint(0, 130)
        own = pool[language] if isinstance(pool, dict) else pool
        rows += [(f"f{i}" if i else None, language, n, rng.choice(own)) for n in range(1, size + 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "path string, language string, line int, text string")


def whole(lines, hits):
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    grouped = lines.groupBy("path", "language").agg(ordered.alias("entries")).withColumn("_views", viewed(F.col("entries.text")))
    return shown(findings_from_hits(grouped.select("path", hits().alias("h")), "h", "path"))


def shown(findings):
    return sorted((r["path"] or "", r["line"], r["column"] or 0, r["rule"], r["message"]) for r in findings.collect())


@pytest.mark.parametrize("block_lines", [1, 7, 64, 10_000])
def test_locks_and_rcu(spark, block_lines):
    lines = files(spark, C_LINES, ["c"], 40, 5).filter("text is not null")
    locks = shown(block_scan.lock_findings(lines, "path", block_lines=block_lines))
    assert locks == whole(lines, lambda: c_rules.lock_hits(F.col("entries"))) and len({x[3] for x in locks}) == 2
    rcu = shown(block_scan.rcu_findings(lines, "path", block_lines=block_lines))
    assert rcu == whole(lines, lambda: c_rules.rcu_hits(F.col("entries"))) and rcu


@pytest.mark.parametrize("block_lines", [1, 9, 100, 10_000])
def test_long_functions(spark, block_lines):
    lines = files(spark, SPAN_POOL, list(SPAN_POOL), 40, 6)
    found = shown(block_scan.long_function_findings(lines, "path", block_lines=block_lines))
    assert found == whole(lines, lambda: block_rules.span_hits(block_rules.function_spans(F.col("language"), F.col("_views")))) and found


def test_summaries_compose():
    """A block's summary says the same as running its lines from any state."""
    rng = random.Random(8)

    def run(state, lines, python):
        for x in lines:
            if state["start"]:
                depth = state["depth"] + (0 if python else x["delta"])
                if (not x["blank"] and x["indent"] <= state["indent"]) if python else (depth <= 0 and x["closes"]):
                    state = block_scan.CLOSED
                else:
                    state = {**state, "depth": depth}
            elif x["marked"]:
                state = {"start": x["line"], "depth": 0 if python else x["delta"], "indent": x["indent"]}
        return state

    for trial in range(400):
        python = trial % 2 == 0
        lines = [{"line": n, "marked": rng.random() < 0.2, "delta": rng.randint(-2, 2), "closes": rng.random() < 0.5,
                  "indent": rng.randint(0, 4), "blank": rng.random() < 0.2} for n in range(1, rng.randint(1, 25))]
        summary = block_scan.span_summary(lines, python)
        for state in [block_scan.CLOSED] + [{"start": 99, "depth": 0 if python else d, "indent": d} for d in range(-1, 7)]:
            assert block_scan.after_block(state, summary, python) == run(state, lines, python)


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "path string, language string, line int, text string")
    assert not shown(block_scan.lock_findings(lines, "path")) and not shown(block_scan.rcu_findings(lines, "path"))
    assert not shown(block_scan.long_function_findings(lines, "path"))
