"""Order-dependent rules on random files against direct simulations in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lineweave.functions.findings_schema import findings_from_hits
from lineweave.operators import block_rules, c_rules, script_rules
from lineweave.operators.lines import viewed, with_lines
from lineweave.sources import selection

SEEDS = 120


def corpus(pool, languages, low=1, high=90, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(SEEDS):
        language = languages[i % len(languages)]
        lines = [rng.choice(pool[language] if isinstance(pool, dict) else pool) for _ in range(rng.randint(low, high))]
        rows.append((f"f{i}", language, "\n".join(lines) + "\n"))
    return rows


def found(spark, rows, hits, keep_cr=False):
    df = spark.createDataFrame(rows, "path string, language string, content string").repartition(7)
    files = with_lines(df, keep_cr=keep_cr).withColumn("_views", viewed(F.col("lines")))
    out = findings_from_hits(files.select("path", hits().alias("h")), "h", "path")
    return sorted((r["path"], r["line"], r["rule"], r["message"]) for r in out.collect())


def compare(got, rows, simulate, rule, message=None):
    want = []
    for path, language, content in rows:
        for hit in simulate(language, content[:-1].split("\n")):
            line, text = hit if isinstance(hit, tuple) else (hit, message)
            want.append((path, line, rule, text))
    mine = [g for g in got if g[2] == rule]
    if message is None:
        assert mine == sorted(want)
    else:
        assert [g[:3] for g in mine] == sorted(w[:3] for w in want)
    assert want, "the corpus never fires this rule"


def held_locks(lines, judge):
    held = {}
    for n, t in enumerate(lines, 1):
        take = re.search(r"spin_lock(?:_irqsave|_bh)?\(|mutex_lock\(", t)
        drop = re.search(r"spin_unlock(?:_irqrestore|_bh)?\(|mutex_unlock\(", t)
        if take:
            kind = "spin_lock" if "spin_lock" in t else "mutex_lock"
            name = re.match(r"[ &*]*([A-Za-z0-9_-]*)", t[t.index("(", t.index(kind)) + 1:]).group(1)
            if name:
                held[name] = kind == "spin_lock"
        if drop:
            kind = "spin_unlock" if "spin_unlock" in t else "mutex_unlock"
            name = re.match(r"[ &*]*([A-Za-z0-9_-]*)", t[t.index("(", t.index(kind)) + 1:]).group(1)
            held.pop(name, None)
        if judge(t, held):
            yield n


def returns(t):
    at = t.find("return")
    return at >= 0 and not re.match(r"[A-Za-z0-9_]", t[at - 1] if at else " ") and not re.match(
        r"[A-Za-z0-9_]", t[at + 6:at + 7] or " ")


C_POOL = ["spin_lock(&a);", "spin_unlock(&a);", "mutex_lock(b->m);", "mutex_unlock(b->m);", "spin_lock_bh( *c );",
          "spin_unlock_bh(c);", "return 0;", "noreturn; return x;", "msleep(1);", "schedule();", "x;", "y = 1;", "z;",
          "rcu_read_lock();", "rcu_read_unlock();", "v = p->q;", "w = rcu_dereference(p->q);", "if (!p)", "if (q == NULL)",
          "q->r = 1;", "(q)->r = 1;", "goto out;", "out:", "kfree(p);", "\tgoto out; // again", "out: put_it(x);",
          "spin_lock(&a); spin_unlock(&a);", "rcu_read_lock(); p->x; rcu_read_unlock();"]


def test_locks(spark):
    rows = corpus(C_POOL, ["c"])
    got = found(spark, rows, lambda: c_rules.lock_hits(c_rules.numbered(F.col("lines"))), keep_cr=True)
    compare(got, rows, lambda _, ls: held_locks(ls, lambda t, h: returns(t) and h), "return-without-unlock", "m")
    compare(got, rows, lambda _, ls: held_locks(ls, lambda t, h: any(
        s in t for s in ("msleep(", "schedule(")) and any(h.values())), "sleeping-in-atomic", "m")


def test_rcu(spark):
    def simulate(_, lines):
        depth = 0
        for n, t in enumerate(lines, 1):
            depth += "rcu_read_lock(" in t
            if depth > 0 and "->" in t and "rcu_dereference(" not in t:
                yield n
            if "rcu_read_unlock(" in t and depth > 0:
                depth -= 1

    rows = corpus(C_POOL, ["c"])
    got = found(spark, rows, lambda: c_rules.rcu_hits(c_rules.numbered(F.col("lines"))), keep_cr=True)
    compare(got, rows, simulate, "RCU-missing-annotation", "m")


def test_goto(spark):
    """A line becomes a digit (label 4, cleanup 2, return 1) and the rule one pattern over the digits behind a goto."""
    cleaned_up = re.compile("[0-3]{0,6}[4-7][04]{0,4}[2367]")

    def simulate(_, lines):
        digits = "".join(str(4 * ("out:" in t) + 2 * bool(re.search(r"kfree\(|put_|unlock\(", t)) + bool(returns(t))) for t in lines)
        return [n for n, t in enumerate(lines, 1) if "goto out;" in t and not cleaned_up.match(digits, n)]

    rows = corpus(C_POOL, ["c"])
    got = found(spark, rows, lambda: c_rules.goto_hits(c_rules.numbered(F.col("lines")), F.col("lines")), keep_cr=True)
    compare(got, rows, simulate, "goto-out-without-cleanup", "m")


def test_null_checks(spark):
    def simulate(_, lines):
        for i, t in enumerate(lines):
            name = re.search(r"[A-Za-z0-9_)]+$", t.split("->")[0]) if "->" in t else None
            if name and any(("if (" in u or "if(" in u) and name.group() in u and ("NULL" in u or "!" in u)
                            for u in lines[i + 1:]):
                yield i + 1

    rows = corpus(C_POOL, ["c"], high=30)
    got = found(spark, rows, lambda: c_rules.null_check_hits(c_rules.numbered(F.col("lines"))), keep_cr=True)
    compare(got, rows, simulate, "null-deref-before-check", "m")


HANDLER_POOL = {
    "typescript": ["} catch (e) {", "}", "catch (e)", "{", "// ignored", "", "  ", "go();", "p.catch((e) =>", "};", "pass",
                   "catch {};", "x: {", "catch (e) { }", "/* ignored */", "{ }", "{ };", "a:", "y {} z", "{ x {} }"],
    "python": ["except E:", "pass", "", "except:", "go()", "x = {", "}", "  pass", "except A: pass", "# x"],
    "rust": ["match x {", "}", "if let Err(e) = y", "{", "_ => {}", "go();", ""],
}
HANDLER_TESTS = {
    "typescript": lambda t: t.startswith("catch") or any(w in t for w in (".catch(() =>", ".catch((", "catch (")),
    "python": lambda t: t.startswith("except"),
    "rust": lambda t: "if let Err(" in t or "match " in t,
}


# What a line is as the beginning of a block, and what it is inside of one; the first pattern that fits counts.
OPENS = [("W", r".*\{\}"), ("W", r"[^{]*\{\s*\};?$"), ("B", r"[^{]*\{$"), ("X", r".*\{"), ("B", r".*:$"), ("-", "")]
INSIDE = [("E", r"(\}|pass|// ignored?|// noop|/\* ignored \*/)$"), ("H", "except|catch"), ("-", "")]
EMPTY_BLOCK = re.compile("(-.)*(W.|B.(.H)*.E)")


def test_empty_handlers(spark):
    def kind(table, text):
        return next(letter for letter, pattern in table if re.match(pattern, text))

    def simulate(language, lines):
        marks = [kind(OPENS, t.strip()) + kind(INSIDE, t.strip()) if t.strip() else "" for t in lines]
        return [n for n, line in enumerate(lines, 1) if HANDLER_TESTS[language](line.strip()) and (
            re.search(r"\{\}|\{ \}$", line.strip()) or EMPTY_BLOCK.match("".join(marks[n - 1:n + 4])))]

    rows = corpus(HANDLER_POOL, list(HANDLER_POOL))
    got = found(spark, rows, lambda: block_rules.handler_hits("_views", F.col("lines"), F.col("content")))
    compare(got, rows, simulate, "empty-error-handler", "m")


SPAN_POOL = {
    "rust": ["fn a() {", "}", "if x {"] + ["x;"] * 90 + ["fn b();", "{ }"],
    "python": ["def a():", "y = 1", "    def b():", "", "\t"] + ["    x = 1"] * 90,
    "javascript": ["function a() {", "}", "b = () => {", "}}"] + ["x;"] * 90,
    "java": [" void a() {", "public void a() {", "}", "x = int y {", "new int [] {}"] + ["x;"] * 90,
}
MARKERS = {"rust": ["fn "], "python": ["def "], "javascript": ["function ", "=> {"], "java": [" void ", " String ", " int "]}


def test_long_functions(spark):
    def simulate(language, lines):
        start = None
        for i, line in enumerate(lines):
            t, indent = line.strip(), len(line) - len(line.lstrip())
            delta = t.count("{") - t.count("}")
            if start is None:
                if any(m in t for m in MARKERS[language]):
                    start, depth, base = i, delta, indent
                continue
            depth += delta
            if language == "python":
                length = i - start if t and indent <= base else None
            else:
                length = i - start + 1 if depth <= 0 and "}" in t else None
            if length is not None:
                if length > 60:
                    yield start + 1, f"Function spans {length} lines; consider splitting for readability"
                start = None

    rows = corpus(SPAN_POOL, list(SPAN_POOL), low=50, high=500)
    got = found(spark, rows, lambda: block_rules.long_function_hits(F.col("_views")))
    compare(got, rows, simulate, "hard-to-read-function")


FLOW_POOL = ["const a = req.body;", "let b = req.query;", "exec(a);", "fetch(b + a)", "x = a;", "axios.get(b)", "const a = 1",
             "ab(exec(ab));", "var $c = process.argv;", "exec($c)", "el.innerHTML = b", "FETCH(a)"]


def test_flows_in_row_and_by_join(spark):
    def simulate(_, lines):
        tainted = {}
        for n, t in enumerate(lines, 1):
            m = re.search(r"(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=.*(?:req\.(?:body|query|params)|process\.argv)", t)
            if m:
                tainted.setdefault(m.group(1), n)
            if re.search(r"exec\(|spawn\(|fetch\(|axios\.|innerHTML\s*=", t, re.I):
                for name in tainted:
                    if name in re.findall(r"[A-Za-z0-9_]+", t):
                        yield n, f"Request-derived variable {name} flows into a sensitive sink"

    rows = corpus(FLOW_POOL, ["typescript"], high=40)
    plane = script_rules.TYPESCRIPT
    got = found(spark, rows, lambda: script_rules.flow_hits(plane, F.col("_views"), F.col("content")))
    compare(got, rows, simulate, "ts-tainted-flow")
    lines = spark.createDataFrame([(p, g, i, t) for p, g, c in rows for i, t in enumerate(c[:-1].split("\n"), 1)],
                                  "path string, language string, line int, text string")
    joined = script_rules.flow_findings(plane, lines, "path").collect()
    assert sorted((r["path"], r["line"], r["rule"], r["message"]) for r in joined) == got


@pytest.mark.parametrize("max_files, max_bytes", [(50, 10**9), (10**6, 3000), (10**6, 0), (0, 10), (10**6, 10**9)])
def test_budget_prefix(spark, max_files, max_bytes):
    rng = random.Random(3)
    rows = [(f"p{rng.random():.12f}", rng.choice([0, 0, 1, 10, 100])) for _ in range(400)]
    kept, total = set(), 0
    for path, size in sorted(rows):
        if len(kept) >= max_files or total >= max_bytes or total + size > max_bytes:
            break
        kept.add(path)
        total += size
    df = spark.createDataFrame(rows, "path string, size bigint")
    for partitions in (1, 5, 31):
        out = selection.budget_prefix(df, max_files, max_bytes, partitions=partitions).collect()
        assert {r["path"] for r in out if r["within_budget"]} == kept
        assert len(out) == len(rows)
