"""C source rules: style per line, and lock, RCU, goto and pointer order per file.

Files are single rows with an array of lines, so the order-dependent rules fold over the
few lines that matter to them and nothing is shuffled.  All columns are byte offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_from_hits, hit, no_hits, rule_id
from ..functions.fixed_values import (
    C_BRACE_KEYWORDS, C_CLEANUP_WORDS, C_LOCK_CALLS, C_RCU_SAFE, C_SLEEP_CALLS, C_SPACING_KEYWORDS, C_STYLE_RULES,
    C_UNLOCK_CALLS, GOTO_CLEANUP_WITHIN, GOTO_LABEL_WITHIN, STYLE_LINE_BYTES,
)
from ..functions.text import all_of, any_of, before_first, byte_column, contains_any, first_hit_is_word, let, numbered

STYLE_NAMES = tuple(text.name for text in C_STYLE_RULES)


def _flow(name: str, line: Column, column: Column | None = None, at: Column | None = None) -> Column:
    return hit(rule_id("language", name), line, F.lit(1) if column is None else column, at=at)


def style_hits(line: Column, text: Column, rules=STYLE_NAMES) -> Column:
    """Hits of the style rules on one line."""
    def mark(name: str, column: Column, detail: Column | None = None) -> Column:
        return hit(rule_id("language", name), line, column, None if detail is None else detail.cast("string"))

    size = F.octet_length(text)
    marks = []
    if "line-length" in rules:
        long = (size > STYLE_LINE_BYTES) & ~F.startswith(text, F.lit("#")) & ~contains_any(text, ("/*", "//"))
        marks.append((long, mark("line-length", F.lit(1), size)))
    if "space-before-tab" in rules:
        marks.append((F.contains(text, F.lit(" \t")),
                            mark("space-before-tab", F.octet_length(before_first(text, " \t")) + 2)))
    if "trailing-whitespace" in rules:
        marks.append((F.endswith(text, F.lit(" ")) | F.endswith(text, F.lit("\t")),
                            mark("trailing-whitespace", size)))
    if "keyword-spacing" in rules:
        for word in C_SPACING_KEYWORDS:
            head = before_first(text, word)
            tight = (
                F.contains(text, F.lit(word + "("))
                & F.startswith(F.substr(text, F.length(head) + F.lit(len(word) + 1)), F.lit("("))
                & ~F.rlike(head, F.lit("[A-Za-z0-9_]\\z"))
            )
            marks.append((tight, mark("keyword-spacing", F.octet_length(head) + 1)))
    if "brace-style" in rules:
        keyword = any_of([first_hit_is_word(text, w) for w in C_BRACE_KEYWORDS])
        marks.append((F.contains(text, F.lit("{")) & keyword, mark("brace-style", byte_column(text, "{"))))
    # the array is built only on lines where something fires; the tests run in generated code
    found = F.array_compact(F.array(*[F.when(fires, place) for fires, place in marks]))
    return F.when(any_of([fires for fires, _ in marks]), found).otherwise(no_hits())


def style_findings(lines: DataFrame, *carry: str, rules=STYLE_NAMES) -> DataFrame:
    """Style findings of a line table; no shuffle."""
    hits = lines.select(*carry, style_hits(F.col("line"), F.col("text"), rules).alias("_hits"))
    return findings_from_hits(hits, "_hits", *carry)


# --- rules that follow the order of lines inside a file --------------------------------

def _called_name(text: Column, call: str) -> Column:
    """Identifier handed to the first ``call``: pointer marks dropped, stops at ``>``."""
    return F.regexp_extract(text, rf"{call}[^(]*\([ &*]*([A-Za-z0-9_-]*)", 1)


LOCK_WORDS = C_LOCK_CALLS + C_UNLOCK_CALLS + C_SLEEP_CALLS + ("return",)
RCU_WORDS = ("rcu_read_lock(", "rcu_read_unlock(", "->")
HELD_TYPE = "array<struct<name:string,spin:boolean>>"


def lock_events(entries: Column) -> Column:
    """Lines that take or drop a lock, return, or sleep, with the lock names involved."""
    def event(entry: Column) -> Column:
        text = entry["text"]
        takes, drops = contains_any(text, C_LOCK_CALLS), contains_any(text, C_UNLOCK_CALLS)
        spin, spin_off = F.contains(text, F.lit("spin_lock")), F.contains(text, F.lit("spin_unlock"))
        taken = F.when(takes & spin, _called_name(text, "spin_lock")).when(takes, _called_name(text, "mutex_lock"))
        dropped = F.when(drops & spin_off, _called_name(text, "spin_unlock")).when(
            drops, _called_name(text, "mutex_unlock"))
        return F.struct(
            entry["line"].alias("line"), taken.alias("taken"), spin.alias("spin"), dropped.alias("dropped"),
            first_hit_is_word(text, "return").alias("returns"),
            contains_any(text, C_SLEEP_CALLS).alias("sleeps"),
            byte_column(text, "return").alias("column"),
        )

    return F.transform(F.filter(entries, lambda e: contains_any(e["text"], LOCK_WORDS)), event)


def lock_hits(entries: Column, held: Column | None = None, others: Column | int = 0, other_spins: Column | int = 0) -> Column:
    """Returns and sleeps while a lock is held.

    The fold carries the set of locks held now; a line first takes, then drops, then is
    judged. For a part of a file, ``held`` are the locks held before it that it takes or drops, and ``others``
    and ``other_spins`` count those that it does not touch.
    """
    others, other_spins = (F.lit(n) if isinstance(n, int) else n for n in (others, other_spins))
    out_type = "array<struct<line:int,column:int,kind:int>>"

    none = F.array().cast(out_type)

    def after_take(acc: Column, e: Column) -> Column:
        rest = F.filter(acc["held"], lambda h: h["name"] != e["taken"])
        own = F.array(F.struct(e["taken"].alias("name"), e["spin"].alias("spin"))).cast(HELD_TYPE)
        return F.when(e["taken"] != "", F.concat(rest, own)).otherwise(acc["held"])

    def after_drop(held: Column, e: Column) -> Column:
        return F.filter(held, lambda h: e["dropped"].isNull() | (h["name"] != e["dropped"]))

    def judged(held: Column, acc: Column, e: Column) -> Column:
        leak = F.when(e["returns"] & (F.size(held) + others > 0), F.array(F.struct(
            e["line"].cast("int").alias("line"), e["column"].cast("int").alias("column"), F.lit(0).alias("kind"))))
        sleep = F.when(e["sleeps"] & (F.exists(held, lambda h: h["spin"]) | (other_spins > 0)), F.array(F.struct(
            e["line"].cast("int").alias("line"), F.lit(1).alias("column"), F.lit(1).alias("kind"))))
        out = F.concat(acc["out"], F.coalesce(leak, none), F.coalesce(sleep, none))
        return F.struct(held.alias("held"), out.cast(out_type).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kept = after_drop(after_take(acc, e), e).cast(HELD_TYPE)
        return let(kept, lambda now: judged(now, acc, e))

    start = F.array().cast(HELD_TYPE) if held is None else held
    zero = F.struct(start.alias("held"), F.array().cast(out_type).alias("out"))
    hits = F.aggregate(lock_events(entries), zero, step, lambda acc: acc["out"])
    return F.transform(hits, lambda h: F.when(
        h["kind"] == 0, _flow("return-without-unlock", h["line"], h["column"])
    ).otherwise(_flow("sleeping-in-atomic", h["line"])))


def rcu_hits(entries: Column, depth: Column | None = None) -> Column:
    """Plain pointer use while an RCU read lock is open; depth never falls below zero.

    For a part of a file, ``depth`` is the one before it.
    """
    state = "struct<depth:int,out:array<int>>"

    def step(acc: Column, e: Column) -> Column:
        text = e["text"]
        depth = acc["depth"] + F.contains(text, F.lit("rcu_read_lock(")).cast("int")
        plain = (depth > 0) & F.contains(text, F.lit("->")) & ~contains_any(text, C_RCU_SAFE)
        left = F.greatest(F.lit(0), depth - F.contains(text, F.lit("rcu_read_unlock(")).cast("int"))
        return F.struct(left.cast("int").alias("depth"),
                        F.when(plain, F.concat(acc["out"], F.array(e["line"].cast("int")))).otherwise(acc["out"])
                        .alias("out")).cast(state)

    start = F.lit(0) if depth is None else depth
    zero = F.struct(start.alias("depth"), F.array().alias("out")).cast(state)
    marked = F.filter(entries, lambda e: contains_any(e["text"], RCU_WORDS))
    return F.transform(F.aggregate(marked, zero, step, lambda acc: acc["out"]),
                       lambda line: _flow("RCU-missing-annotation", line))


def goto_hits(entries: Column, lines: Column) -> Column:
    """``goto out;`` whose label shows no cleanup before a return."""
    def first_index(texts: Column, test) -> Column:
        at = F.array_position(F.transform(texts, test), F.lit(True))
        return F.coalesce(at, F.lit(0)).cast("int")

    def cleaned(entry: Column) -> Column:
        ahead = F.slice(lines, entry["line"] + 1, F.lit(GOTO_LABEL_WITHIN))
        label = first_index(ahead, lambda t: F.contains(t, F.lit("out:")))
        body = F.slice(lines, entry["line"] + label + 1, F.lit(GOTO_CLEANUP_WITHIN))
        cleanup = first_index(body, lambda t: contains_any(t, C_CLEANUP_WORDS))
        leaves = first_index(body, lambda t: first_hit_is_word(t, "return"))
        return (label > 0) & (cleanup > 0) & ((leaves == 0) | (cleanup <= leaves))

    gotos = F.filter(entries, lambda e: F.contains(e["text"], F.lit("goto out;")))
    return F.transform(F.filter(gotos, lambda e: ~cleaned(e)), lambda e: _flow(
        "goto-out-without-cleanup", e["line"], byte_column(e["text"], "goto")))


def null_check_hits(entries: Column) -> Column:
    """Pointer used on one line and tested against NULL on a later one.

    Only the last test that mentions each distinct pointer matters, so uses are not paired
    with tests.
    """
    using = F.transform(F.filter(entries, lambda e: F.contains(e["text"], F.lit("->"))), lambda e: F.struct(
        e["line"].alias("line"),
        F.regexp_extract(before_first(e["text"], "->"), r"([A-Za-z0-9_)]+)\z", 1).alias("pointer")))
    derefs = F.filter(using, lambda d: d["pointer"] != "")
    tests = F.filter(entries, lambda e: contains_any(e["text"], ("if (", "if(")) & contains_any(
        e["text"], ("NULL", "!")))

    def tested_after(both: Column) -> Column:
        derefs, tests = both["derefs"], both["tests"]

        def last_test(name: Column) -> Column:
            naming = F.filter(tests, lambda t: F.contains(t["text"], name))
            return F.struct(name.alias("pointer"), F.array_max(F.transform(naming, lambda t: t["line"])).alias("line"))

        def emit(d: Column) -> Column:
            after = F.filter(tests, lambda t: (t["line"] > d["line"]) & F.contains(t["text"], d["pointer"]))
            return _flow("null-deref-before-check", d["line"], at=F.array_min(F.transform(after, lambda t: t["line"])))

        names = F.array_distinct(F.transform(derefs, lambda d: d["pointer"]))
        late = F.map_from_entries(F.filter(F.transform(names, last_test), lambda n: n["line"].isNotNull()))
        return let(late, lambda last: F.transform(F.filter(derefs, lambda d: F.coalesce(
            F.element_at(last, d["pointer"]) > d["line"], F.lit(False))), emit))

    both = F.struct(derefs.alias("derefs"), tests.alias("tests"))
    return let(both, lambda b: F.when(F.size(b["tests"]) > 0, tested_after(b)).otherwise(no_hits()))


def marker_hits(lines: Column) -> Column:
    """Inconsistent ``__init``/``__exit`` markers: at most one finding per file."""
    def has(*words: str) -> Column:
        return F.exists(lines, lambda t: all_of([F.contains(t, F.lit(w)) for w in words]))

    mixed = (has("__init") & has("__exit")) | has("__init", "_exit(") | has("__exit", "_init(")
    return F.when(mixed, F.array(_flow("missing-__init-__exit", F.lit(1)))).otherwise(no_hits())


def call_hits(entries: Column) -> Column:
    """printk without a level, and BUG_ON."""
    printk = F.filter(entries, lambda e: F.contains(e["text"], F.lit("printk(")) & ~F.contains(
        e["text"], F.lit("KERN_")))
    bug = F.filter(entries, lambda e: F.contains(e["text"], F.lit("BUG_ON(")))
    return F.concat(F.transform(printk, lambda e: _flow("printk-without-level", e["line"])),
                    F.transform(bug, lambda e: _flow("BUG_ON-usage", e["line"])))


def flow_hits(lines: Column, content: Column) -> Column:
    """All order-dependent hits of one C file.  Each rule first asks the whole text for
    its word, so most files never reach the line arrays."""
    def when_seen(words, found: Column) -> Column:
        return F.when(contains_any(content, words), found).otherwise(no_hits())

    def judged(file: Column) -> Column:
        kept, entries = file["lines"], file["entries"]
        return F.concat(
            when_seen(("goto out;",), goto_hits(entries, kept)),
            when_seen(("_lock",), lock_hits(entries)),
            when_seen(("->",), null_check_hits(entries)),
            when_seen(("rcu_read_lock(",), rcu_hits(entries)),
            when_seen(("printk(", "BUG_ON("), call_hits(entries)),
            when_seen(("__init", "__exit"), marker_hits(kept)),
        )

    file = let(lines, lambda rows: F.struct(rows.alias("lines"), numbered(rows).alias("entries")))
    return let(file, judged)
