"""TypeScript/JavaScript and Java line patterns, and request-to-sink flow inside a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_from_hits, hit, no_hits, rule_id
from ..functions.fixed_values import (
    JAVA_PATTERNS, JAVA_RULES, JAVA_TAINT_SINK, JAVA_TAINT_SOURCE, JAVA_TAINT_SOURCE_WORDS, JAVA_WORD,
    TS_PATTERNS, TS_RULES, TS_TAINT_SINK, TS_TAINT_SOURCE, TS_TAINT_SOURCE_WORDS, TS_WORD,
)
from ..functions.text import contains_any, let
from ..functions.triggers import ROW_VIEWS, fired_sql, pattern_sql, set_bits, views_in, with_mask
from .lines import with_views


class ScriptPlane:
    """Rule texts, patterns and flow expressions of one language family."""

    def __init__(self, name, languages, rules, patterns, source, source_words, sink, word):
        self.name, self.languages, self.rules, self.patterns = name, languages, rules, patterns
        self.source, self.source_words, self.sink, self.word = source, source_words, sink, word
        self.flow_id = rule_id("language", rules[-1].name)

        self.ids = [rule_id("language", rule.name) for rule in rules[:-1]]

    def predicates(self, views) -> list[str]:
        """One SQL predicate per pattern rule, on one line."""
        return ["(" + " OR ".join(pattern_sql(p, views) for p in self.patterns if p.rule == rule.name) + ")"
                for rule in self.rules[:-1]]


TYPESCRIPT = ScriptPlane("typescript", ("javascript", "typescript"), TS_RULES, TS_PATTERNS,
                         TS_TAINT_SOURCE, TS_TAINT_SOURCE_WORDS, TS_TAINT_SINK, TS_WORD)
JAVA = ScriptPlane("java", ("java",), JAVA_RULES, JAVA_PATTERNS,
                   JAVA_TAINT_SOURCE, JAVA_TAINT_SOURCE_WORDS, JAVA_TAINT_SINK, JAVA_WORD)
SCRIPT_PLANES = (TYPESCRIPT, JAVA)


def script_line_findings(plane: ScriptPlane, lines: DataFrame, *carry: str) -> DataFrame:
    """Pattern findings of a line table; no shuffle."""
    own = lines.filter(F.col("language").isin(*plane.languages))
    masked = with_mask(with_views(own), plane.predicates(ROW_VIEWS), *carry)
    fired = masked.select(*carry, "line", set_bits(F.col("_mask"), plane.ids).alias("_ids"))
    hits = fired.select(*carry, F.transform("_ids", lambda n: hit(n, F.col("line"))).alias("_hits"))
    return findings_from_hits(hits, "_hits", *carry)


def script_hits(plane: ScriptPlane, views: str) -> Column:
    """Pattern hits of one file, from its array of viewed lines."""
    ids = fired_sql(list(zip(plane.ids, plane.predicates(views_in("v")))))
    fired = F.expr(f"filter(transform({views}, v -> named_struct('line', v.line, 'ids', {ids})), "
                   "x -> size(x.ids) > 0)")
    return F.flatten(F.transform(fired, lambda x: F.transform(x["ids"], lambda n: hit(n, x["line"]))))


def flow_findings(plane: ScriptPlane, lines: DataFrame, *keys: str) -> DataFrame:
    """Flow findings of a line table, by joining definitions to sink words.

    Definitions are reduced to the first line of each ``(file, variable)`` before they are
    joined, so that side has one row per key and a busy variable's sink rows can be split
    over tasks.  Both sides hold only the few lines that match.
    """
    own = lines.filter(F.col("language").isin(*plane.languages))
    defined = (
        own.filter(contains_any(F.col("text"), plane.source_words))
        .select(*keys, "line", F.regexp_extract("text", plane.source, 1).alias("variable"))
        .filter(F.col("variable") != "")
        .groupBy(*keys, "variable").agg(F.min("line").alias("_first"))
    )
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(plane.word), F.lit(0)))
    sinks = own.filter(F.rlike("text", F.lit(plane.sink))).select(*keys, "line", F.explode(words).alias("variable"))
    joined = sinks.join(defined, [*keys, "variable"]).filter(F.col("line") >= F.col("_first"))
    hits = joined.select(*keys, F.array(hit(plane.flow_id, F.col("line"), detail=F.col("variable"))).alias("_hits"))
    return findings_from_hits(hits, "_hits", *keys)


def flow_hits(plane: ScriptPlane, views: Column, content: Column) -> Column:
    """Flow hits of one file as an array, for the single-pass review; no shuffle.

    Files without a request-like source never reach the line arrays.
    """
    defining = F.filter(views, lambda e: contains_any(e["text"], plane.source_words) & F.rlike(
        e["text"], F.lit(plane.source)))
    defined = F.array_sort(F.transform(defining, lambda e: F.struct(
        F.regexp_extract(e["text"], plane.source, 1).alias("variable"), e["line"].alias("line"))))

    def first_of_each(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda d, i: (i == 0) | (F.get(sorted_, i - 1)["variable"] != d["variable"]))

    sinks = F.filter(views, lambda e: F.rlike(e["text"], F.lit(plane.sink)))
    worded = F.transform(sinks, lambda e: F.struct(
        e["line"].alias("line"), F.regexp_extract_all(e["text"], F.lit(plane.word), F.lit(0)).alias("words")))

    def flows(first: Column) -> Column:
        def of_sink(sink: Column) -> Column:
            reaching = F.filter(first, lambda d: (d["line"] <= sink["line"]) & F.array_contains(
                sink["words"], d["variable"]))
            return F.transform(reaching, lambda d: hit(plane.flow_id, sink["line"], detail=d["variable"]))
        return F.flatten(F.transform(worded, of_sink))

    found = let(let(defined, first_of_each), flows)
    return F.when(contains_any(content, plane.source_words), found).otherwise(no_hits())
