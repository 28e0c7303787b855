"""Safe line fixes: a corrected text per file, written as a new version of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    CATALOG, FIXABLE_RULES, LINE_RULES, LINE_TRIGGERS, REVIEW_MARKER, REVIEW_SUFFIX,
)
from ..functions.text import split_lines, trimmed
from ..functions.triggers import triggers_sql, views_in
from .lines import viewed

# Fixable rules that look at one line.  A todo-comment is a whole-file finding without a
# line, so it is listed as fixable but never has a line to fix.
LINE_FIXES = tuple(text.name for text in LINE_RULES if text.name in FIXABLE_RULES)
FIXABLE_IN_CATALOG_ORDER = tuple(entry.name for entry in CATALOG if entry.name in FIXABLE_RULES)


def line_plan(views: str, language: str = "language", annotate: bool = False) -> Column:
    """``array<struct<line,rule,text>>``: every line with its fix, text NULL when deleted.

    The fixable rules start with different characters, so a line has one fix at most.
    ``annotate`` keeps a wildcard import and appends the marker instead of replacing it.
    """
    head, tail = REVIEW_MARKER.split("{n}")

    def apply(entry: Column) -> Column:
        marker = F.concat(trimmed(entry["text"]), F.lit(REVIEW_SUFFIX)) if annotate else F.concat(
            F.lit(head), entry["line"].cast("string"), F.lit(tail))
        text = F.when(entry["rule"].isNull(), entry["text"]).when(entry["rule"] == "wildcard-import", marker)
        return F.struct(entry["line"].alias("line"), entry["rule"].alias("rule"), text.alias("text"))

    cases = " ".join(
        f"WHEN {triggers_sql([t for t in LINE_TRIGGERS if t.rule == name], language, views_in('v'))} THEN '{name}'"
        for name in LINE_FIXES)
    planned = F.expr(f"transform({views}, v -> named_struct('line', v.line, 'text', v.text, 'rule', "
                     f"CASE {cases} END))")
    return F.transform(planned, apply)


def with_fixes(files: DataFrame, annotate: bool = False) -> DataFrame:
    """Add ``fixes array<struct<line,rule,replacement>>`` and ``fixed`` to each file.

    The text is rebuilt inside its row; nothing is shuffled.
    """
    viewed_files = files.withColumn("_views", viewed(split_lines(F.col("content"))))
    planned = viewed_files.withColumn("_plan", line_plan("_views", annotate=annotate))
    fixes = F.transform(F.filter("_plan", lambda p: p["rule"].isNotNull()), lambda p: F.struct(
        p["line"].alias("line"), p["rule"].alias("rule"), F.coalesce(p["text"], F.lit("")).alias("replacement")))
    kept = F.transform(F.filter("_plan", lambda p: p["text"].isNotNull()), lambda p: p["text"])
    ending = F.when(F.endswith("content", F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
    # the generator keeps a filter on ``fixes`` from being pushed below and repeating the plan of fixes
    return planned.select(*files.columns, F.explode_outer(F.array(fixes)).alias("fixes"),
                          F.concat(F.array_join(kept, "\n"), ending).alias("fixed"))


def fix_files(files: DataFrame, annotate: bool = False) -> DataFrame:
    """Only the files that change."""
    return with_fixes(files, annotate).filter(F.size("fixes") > 0)


def fix_summary(fixed: DataFrame, dry_run: bool = True) -> DataFrame:
    """``path, fixes, dry_run, fixable_rules`` per changing file."""
    return fixed.select("path", F.size("fixes").cast("long").alias("fixes"), F.lit(dry_run).alias("dry_run"),
                        F.lit(", ".join(FIXABLE_IN_CATALOG_ORDER)).alias("fixable_rules"))


def write_corpus_version(files: DataFrame, target: str, annotate: bool = False) -> None:
    """Write all files, fixed where needed, as a new corpus; an existing target is an error.

    Unchanged files are copied byte for byte, so the new version stands alone.
    """
    content = F.when(F.size("fixes") > 0, F.col("fixed")).otherwise(F.col("content"))
    out = with_fixes(files, annotate).withColumn("content", content).drop("fixes", "fixed")
    out.write.mode("errorifexists").parquet(target)
