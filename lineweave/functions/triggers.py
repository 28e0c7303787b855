"""Compile trigger rows and script patterns to one SQL predicate each.

The word lists hold some hundred words.  Written as SQL text they reach the planner in one
call; the predicates are the same built-in functions either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings_schema import sql_text
from .fixed_values import ScriptPattern, Trigger
from .text import WHITESPACE, let

# Names of the line's views inside a predicate.
Views = dict[str, str]
ROW_VIEWS: Views = {"raw": "text", "lower": "_lower", "trim": "_trim", "calls": "_calls"}


def views_in(struct: str) -> Views:
    return {"raw": f"{struct}.text", "lower": f"{struct}.lower", "trim": f"{struct}.trim", "calls": f"{struct}.calls"}


def trim_sql(text: str) -> str:
    return f"btrim({text}, {sql_text(WHITESPACE)})"


def _any(function: str, text: str, words) -> str:
    return "(" + " OR ".join(f"{function}({text}, {sql_text(w)})" for w in words) + ")"


def contains_any_sql(text: str, words) -> str:
    return _any("contains", text, words)


def _all_call(words) -> bool:
    """Words that all hold an opening bracket need not be looked for on lines without one.

    Most words of the rules name a call, and each search is a pass over the line.
    """
    return bool(words) and all("(" in w for w in words)


def trigger_sql(trigger: Trigger, views: Views) -> str:
    """All filled groups of one row; language is not tested here."""
    text = views[trigger.view]
    calls = "calls" in views and (_all_call(trigger.has) or _all_call(trigger.starts))
    groups = [views["calls"]] if calls else []
    if trigger.starts:
        groups.append(_any("startswith", text, trigger.starts))
    if trigger.equals:
        groups.append(f"{text} IN (" + ", ".join(map(sql_text, trigger.equals)) + ")")
    if trigger.has:
        groups.append(_any("contains", text, trigger.has))
    if trigger.also:
        groups.append(_any("contains", views[trigger.also_view or trigger.view], trigger.also))
    if trigger.ends:
        groups.append(_any("endswith", text, trigger.ends))
    if trigger.without:
        groups.append("NOT " + _any("contains", text, trigger.without))
    return "(" + " AND ".join(groups) + ")"


def triggers_sql(triggers, language: str, views: Views) -> str:
    """Does any row fire for this line's language?

    Rows are grouped by language into one CASE, so that a line pays only for its own.
    """
    shared = [trigger_sql(t, views) for t in triggers if not t.langs]
    by_langs: dict[tuple[str, ...], list[str]] = {}
    for t in triggers:
        if t.langs:
            by_langs.setdefault(t.langs, []).append(trigger_sql(t, views))
    parts = list(shared)
    if by_langs:
        cases = " ".join(
            f"WHEN {language} IN (" + ", ".join(map(sql_text, langs)) + ") THEN " + " OR ".join(predicates)
            for langs, predicates in by_langs.items())
        parts.append(f"CASE {cases} ELSE false END")
    return "(" + " OR ".join(parts) + ")"


def pattern_sql(pattern: ScriptPattern, views: Views) -> str:
    text = views[pattern.view]
    parts = [views["calls"]] if _all_call(pattern.seen) else []
    parts.append(contains_any_sql(text, pattern.seen))
    if pattern.words:
        parts.append(contains_any_sql(text, pattern.words))
    if pattern.match:
        parts.append(f"rlike({text}, {sql_text(pattern.match)})")
    if pattern.also:
        parts.append(f"rlike({text}, {sql_text(pattern.also)})")
    if pattern.unless:
        parts.append(f"NOT rlike({text}, {sql_text(pattern.unless)})")
    return "(" + " AND ".join(parts) + ")"


def fired_sql(predicates: list[tuple[int, str]]) -> str:
    """``array<int>`` of the numbers whose predicate holds; for lines inside a row."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {p} THEN {n} END" for n, p in predicates) + "))"


def mask_sql(predicates: list[str]) -> str:
    """Bit mask of the predicates that hold; for line rows.

    Unlike an array that is filtered afterwards, a mask is evaluated in generated code.
    """
    return " | ".join(f"(CASE WHEN {p} THEN {1 << bit} ELSE 0 END)" for bit, p in enumerate(predicates))


def with_mask(lines: DataFrame, predicates: list[str], *keep: str) -> DataFrame:
    """``keep, line, _mask`` of a line table.

    ``line`` passes through an array lambda, which keeps this projection out of whole-stage
    code: as one stage its method would be too long for the JIT, while a projection of its
    own is cut into small methods.
    """
    line = let(F.col("line"), lambda n: n + 0)
    return lines.select(*keep, line.alias("line"), F.expr(mask_sql(predicates)).alias("_mask"))


def set_bits(mask: Column, numbers: list[int]) -> Column:
    """The numbers of the set bits; NULL for none, which costs nothing on most lines."""
    pairs = F.array(*[F.struct(F.lit(1 << bit).alias("bit"), F.lit(n).alias("n")) for bit, n in enumerate(numbers)])
    found = F.transform(F.filter(pairs, lambda p: p["bit"].bitwiseAND(mask) != 0), lambda p: p["n"])
    return F.when(mask != 0, found)


def gate_trigger(trigger: Trigger) -> Trigger:
    """What a whole text must contain for a row to fire on any of its lines."""
    return Trigger(trigger.rule, trigger.langs, "lower" if trigger.view == "lower" else "raw",
                   has=trigger.starts or trigger.equals or trigger.has)
