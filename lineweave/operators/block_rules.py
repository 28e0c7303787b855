"""Registry rules that need more than one line of the same file.

The lines of a file sit in one array, so look-ahead and span tracking are array
expressions inside the row and need no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.findings_schema import hit, rule_id
from ..functions.fixed_values import (
    EMPTY_BODY_LINES, EMPTY_BRACE_TAILS, FUNCTION_MARKERS, HANDLER_LOOKAHEAD, HANDLER_TRIGGERS,
    LONG_FUNCTION_LINES, SKIPPED_BODY_STARTS,
)
from ..functions.text import contains_any, indent_of, trimmed
from ..functions.triggers import triggers_sql, views_in

def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in words)


# The look-ahead window, trimmed, without blank lines and joined by line breaks, is
# matched as a whole: lines before the body, then either braces closed on the opening
# line, or an opened body whose first telling line leaves it empty.
EMPTY_BLOCK = (
    r"(?U)\A(?:[^{\n]*[^{:\n]\n)*"
    r"(?:"
    r"[^{\n]*\{\}|[^{\n]*\{[^\n]*\{\}"
    rf"|[^{{\n]*\{{[^\S\n]*(?:{_alternatives(EMPTY_BRACE_TAILS)})(?:\n|\z)"
    r"|(?:[^{\n]*\{|[^{\n]*:)\n"
    rf"(?:(?:{_alternatives(SKIPPED_BODY_STARTS)})[^\n]*\n)*"
    rf"(?:{_alternatives(EMPTY_BODY_LINES)})(?:\n|\z)"
    r")"
)


def empty_handler_lines(views: str, lines: Column, language: str = "language") -> Column:
    """Line numbers (``array<int>``) of error handlers with nothing in them.

    ``views`` names the array of viewed lines, ``lines`` is the array of texts.
    """
    handlers = F.expr(f"filter({views}, v -> {triggers_sql(HANDLER_TRIGGERS, language, views_in('v'))})")

    def is_empty(entry: Column) -> Column:
        ahead = F.transform(F.slice(lines, entry["line"], F.lit(HANDLER_LOOKAHEAD)), trimmed)
        block = F.array_join(F.filter(ahead, lambda t: t != ""), "\n")
        text = entry["trim"]
        return F.contains(text, F.lit("{}")) | F.endswith(text, F.lit("{ }")) | F.rlike(block, F.lit(EMPTY_BLOCK))

    return F.transform(F.filter(handlers, is_empty), lambda e: e["line"])


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def opens_function(language: Column, text: Column) -> Column:
    """Does a trimmed line have a word that begins a function in its language?"""
    marked = None
    for lang, words in FUNCTION_MARKERS.items():
        marked = (F if marked is None else marked).when(language == lang, contains_any(text, words))
    return marked


def brace_balance(text: Column) -> Column:
    return _count(text, "{") - _count(text, "}")


OPEN_TYPE = "struct<start:int,depth:int,indent:int>"


def spans_from(language: Column, views: Column, opened: Column | None = None) -> Column:
    """``array<struct<line,span>>`` of functions longer than the readable limit that end in these lines.

    Spans are greedy and do not overlap: while a function is open no other one opens, so
    this is a fold over the lines.  Only long spans are kept in its state. For a part of a file, ``opened``
    is the function that is open before it (``OPEN_TYPE``, start 0 for none).
    """
    python = language == "python"
    state = "struct<start:int,depth:int,indent:int,long:array<struct<line:int,span:int>>>"

    def step(acc: Column, entry: Column) -> Column:
        text = entry["trim"]
        opened = acc["start"] > 0
        opens = ~opened & opens_function(language, text)
        depth = F.when(opens, F.lit(0)).otherwise(acc["depth"]) + brace_balance(text)
        indent = indent_of(entry["text"])
        closes = opened & F.when(python, (text != "") & (indent <= acc["indent"])).otherwise(
            (depth <= 0) & F.contains(text, F.lit("}")))
        span = entry["line"] - acc["start"] + F.when(python, F.lit(0)).otherwise(F.lit(1))
        too_long = closes & (span > LONG_FUNCTION_LINES)
        found = F.struct(acc["start"].alias("line"), span.cast("int").alias("span"))
        return F.struct(
            F.when(opens, entry["line"]).when(closes, F.lit(0)).otherwise(acc["start"]).cast("int").alias("start"),
            F.when(opens | opened, depth).otherwise(F.lit(0)).cast("int").alias("depth"),
            F.when(opens, indent).otherwise(acc["indent"]).cast("int").alias("indent"),
            F.when(too_long, F.concat(acc["long"], F.array(found))).otherwise(acc["long"]).alias("long"),
        ).cast(state)

    before = {n: F.lit(0) if opened is None else opened[n] for n in ("start", "depth", "indent")}
    zero = F.struct(*[c.alias(n) for n, c in before.items()], F.array().alias("long")).cast(state)
    return F.aggregate(views, zero, step, lambda acc: acc["long"])


def function_spans(language: Column, views: Column) -> Column:
    """Long functions of a whole file."""
    none = F.array().cast("array<struct<line:int,span:int>>")
    fits = language.isin(*FUNCTION_MARKERS) & (F.size(views) > LONG_FUNCTION_LINES)
    return F.when(fits, spans_from(language, views)).otherwise(none)


def may_have_handler(content: Column) -> Column:
    """Cheap test on the whole text before any line is looked at."""
    words = {w for t in HANDLER_TRIGGERS for w in t.starts + t.has + t.equals}
    shortest = [w for w in words if not any(o != w and o in w for o in words)]
    return contains_any(content, sorted(shortest))


def handler_hits(views: str, lines: Column, content: Column) -> Column:
    none = F.array().cast("array<int>")
    found = F.when(may_have_handler(content), empty_handler_lines(views, lines)).otherwise(none)
    return F.transform(found, lambda line: hit(rule_id("registry", "empty-error-handler"), line))


def long_function_hits(views: Column) -> Column:
    return span_hits(function_spans(F.col("language"), views))


def span_hits(spans: Column) -> Column:
    return F.transform(spans, lambda s: hit(
        rule_id("registry", "hard-to-read-function"), s["line"], detail=s["span"].cast("string")))
