"""The review plan: files in, findings and reports out.

Everything that looks at text happens inside the row of its file, so one pass over the
corpus without a shuffle yields each file with its ordered findings; flat findings, counts,
the gate and the report are derived from that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import findings_of, no_findings, no_hits
from ..functions.fixed_values import KERNEL_RULES, LINE_RULES
from ..functions.text import let, split_lines
from ..operators import (
    block_rules, c_rules, file_rules, findings as algebra, line_rules, python_symbols, script_rules,
)
from ..operators.lines import unnest_findings, viewed
from ..operators.analyzers import Analyzer, analyzed
from ..operators.rule_table import TableRules
from ..operators.rulepack import RulePack
from ..session import checkpointed
from ..sources import selection
from .policies import Policy, evaluated_rules

FILE_RULE_NAMES = tuple(text.name for text in file_rules.FILE_RULES)
LINE_RULE_NAMES = tuple(text.name for text in LINE_RULES)


@dataclass(frozen=True)
class ReviewOptions:
    rule_set: str = "all"            # scan | registry | all
    fast: bool = False
    include_content: bool = False
    whole_texts: bool = True         # False: only the first bytes, as the policy's preview limit says
    budget: bool = False             # True: hold the corpus to the policy's file and byte limits
    size_limit: bool = False         # True: skip files larger than the policy's limit
    rule_packs: tuple[RulePack | TableRules, ...] = ()
    analyzers: tuple[Analyzer, ...] = ()  # of suspicious files, each of its language; not in fast mode


def classify(files: DataFrame, policy: Policy, ignore_rules=(), root: Column | None = None) -> DataFrame:
    """Files the policy discovers, marked with what happens to each: ``is_text``, ``too_large``."""
    path = F.col("path")
    wanted = selection.is_included(path, policy, root) & ~selection.is_ignored(path, ignore_rules)
    if not policy.include_hidden:
        wanted = wanted & ~selection.is_hidden(path)
    text = selection.is_text(path, F.col("content"), F.col("size"), policy.include_binary,
                             policy.limits.max_file_read_bytes)
    return files.filter(wanted).withColumn("is_text", text).withColumn(
        "too_large", F.col("is_text") & (F.col("size") > policy.limits.max_file_size_bytes))


@lru_cache(maxsize=32)
def registry_hits(names: tuple[str, ...]) -> Column:
    """Registry rules of one file, from its ``_views``, ``_lines`` and ``_gate``.

    An unresolved expression over column names, so it is built once and used by every plan.
    """
    stateless = tuple(n for n in names if n in line_rules.STATELESS)
    parts = [line_rules.line_rule_hits("_views", "language", "_gate", stateless)] if stateless else []
    if "empty-error-handler" in names:
        parts.append(block_rules.handler_hits("_views", F.col("_lines"), F.col("content")))
    if "hard-to-read-function" in names:
        parts.append(block_rules.long_function_hits(F.col("_views")))
    # a file without an extension has no language and is not read by the registry
    return F.when(F.col("language").isNotNull(), F.concat(*parts)).otherwise(no_hits()) if parts else no_hits()


@lru_cache(maxsize=1)
def language_hits() -> Column:
    """Language-plane rules of one file; a file evaluates only its own language's rules."""
    language, content, views = F.col("language"), F.col("content"), F.col("_views")
    case = None
    for plane in script_rules.SCRIPT_PLANES:
        found = F.concat(script_rules.script_hits(plane, "_views"), script_rules.flow_hits(plane, views, content))
        case = (F if case is None else case).when(language.isin(*plane.languages), found)

    def c_source(raw_lines: Column) -> Column:
        style = F.flatten(F.transform(raw_lines, lambda text, i: c_rules.style_hits(i + 1, text)))
        return F.concat(style, c_rules.flow_hits(raw_lines, content))

    return case.when(language == "c", let(split_lines(content, keep_cr=True), c_source)).otherwise(no_hits())


def review_files(files: DataFrame, policy: Policy, options: ReviewOptions = ReviewOptions()) -> DataFrame:
    """Each file with ``suspicious, findings, content_preview, unparsed`` added, and ``troubles`` of analyzers where there are any.

    ``files`` has ``path, size, content`` (text), and ``language`` or an extension in the
    path.  One projection after another on the same row: no shuffle, no second scan.  Python
    sources that the gate lets through are parsed in the tasks, in the same pass.

    ``findings`` comes out of a generator: a filter on it stays above, and the projections
    that compute it are not repeated inside the filter.
    """
    names = evaluated_rules(policy, options.rule_set)
    listed = [n for n in names if n in FILE_RULE_NAMES]
    registry = [] if options.fast else [n for n in names if n in LINE_RULE_NAMES]
    deep = policy.language_planes and not options.fast
    typed = files if "language" in files.columns else files.withColumn(
        "language", selection.detect_language(F.col("path")))
    suspicious = selection.is_suspicious(F.col("content"), policy.suspicious_patterns, options.fast)
    rows = typed.select("*", suspicious.alias("suspicious"),
                        file_rules.file_rule_hits(F.col("content"), listed, policy.is_kernel, options.fast).alias("_file"))
    if registry or deep or options.rule_packs:
        rows = rows.withColumn("_lines", split_lines(F.col("content")))
        rows = rows.withColumn("_views", viewed(F.col("_lines")))
    if registry:
        stateless = tuple(n for n in registry if n in line_rules.STATELESS)
        gate = line_rules.gate_mask("content", "language", stateless) if stateless else F.lit(0)
        rows = rows.withColumn("_gate", gate)
    local = findings_of(F.concat("_file", registry_hits(tuple(registry))) if registry else F.col("_file"))
    for pack in options.rule_packs:
        local = F.concat(local, pack.findings_in_row("_views", F.col("language")))
    found = F.filter(local, lambda f: algebra.retained(policy, f["rule"], f["severity"]))
    marks = []
    if options.analyzers and not options.fast:
        rows = analyzed(rows, options.analyzers, F.col("suspicious"))
        marks.append("troubles")
    unparsed = F.lit(False)
    if deep:
        rows = rows.withColumn("_symbols", python_symbols.symbols_in_row(
            F.when(F.col("suspicious") & (F.col("language") == "python"), F.col("content"))))
        unparsed = python_symbols.unparsed(F.col("_symbols"))
        hits = F.when(F.col("suspicious"), language_hits()).otherwise(no_hits())
        outside = F.transform(F.concat(findings_of(hits), python_symbols.python_findings(F.col("_symbols"))),
                              algebra.external_severity_struct)
        if policy.is_kernel:
            outside = F.filter(outside, lambda f: f["rule"].isin(*KERNEL_RULES))
        found = F.concat(found, outside)
    if marks:
        more = F.filter("_analyzed", lambda f: algebra.kernel_allowed(f["rule"])) if policy.is_kernel else F.col("_analyzed")
        found = F.concat(found, more)
    preview = selection.content_preview(F.col("content"), options.include_content or policy.include_content_preview)
    return rows.withColumn("_found", found).select(
        *typed.columns, "suspicious", F.explode_outer(F.array(algebra.ordered(F.col("_found")))).alias("findings"),
        preview.alias("content_preview"), unparsed.alias("unparsed"), *marks)


@dataclass
class Review:
    """Lazy results of one review."""
    policy: Policy
    options: ReviewOptions
    classified: DataFrame            # path, size, is_text, too_large
    entries: DataFrame
    unreadable: DataFrame
    budgeted: DataFrame | None
    reviewed: DataFrame | None = None  # every discovered file with its marks and findings, in one pass

    @property
    def findings(self) -> DataFrame:
        return unnest_findings(self.entries, "findings", "path", "language")

    @property
    def python_findings(self) -> DataFrame:
        """The syntax-tree findings of suspicious Python files."""
        return self.findings.filter("origin = 'language' AND language = 'python'").drop("language")

    @property
    def unparsed(self) -> DataFrame:
        """Python files of the language plane that do not parse."""
        return self.entries.filter("unparsed").select("path", "size")

    @property
    def troubles(self) -> DataFrame:
        """``path, analyzer, message``: files that an analyzer failed on, or has very many findings for."""
        if "troubles" not in self.entries.columns:
            return self.entries.select("path", F.lit("").alias("analyzer"), F.lit("").alias("message")).limit(0)
        return self.entries.select("path", F.explode("troubles").alias("t")).select("path", "t.*")

    def file_entries(self) -> DataFrame:
        """``path, size, findings, content_preview``."""
        return self.entries.select("path", "size", "findings", "content_preview")


def add_findings(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries (without their texts) with more findings merged into each file's list.

    Findings from outside should have passed ``sanitize_external``, which bounds their number
    per file.
    """
    more = algebra.nest(findings, "path").withColumnRenamed("findings", "_more")
    joined = entries.drop("content").join(more, "path", "left")
    both = F.concat("findings", F.coalesce("_more", no_findings()))
    return joined.withColumn("findings", algebra.ordered(both)).drop("_more")


def review(files: DataFrame, policy: Policy, options: ReviewOptions = ReviewOptions(), ignore_rules=(),
           root: Column | None = None) -> Review:
    """Plan a review of binary ``files(path, size, content[, modified])``.

    By default every file is reviewed, whole, in one pass.  With a budget the files are
    classified first, and the narrow result (no texts) is checkpointed: the budget and the
    counters read it, and the texts are then read once more for the files that are kept.
    """
    classified = classify(files, policy, ignore_rules, root)
    if not options.size_limit:
        classified = classified.withColumn("too_large", F.lit(False))
    limit = None if options.whole_texts else policy.limits.max_file_read_bytes
    marks = classified.select("path", "size", "is_text", "too_large")
    if not options.budget:
        eligible = F.col("is_text") & ~F.col("too_large")
        read = classified.withColumn("_text", F.when(eligible, selection.preview_text(F.col("content"), limit)))
        marked = read.withColumns({"failed": F.col("content").isNull(), "readable": F.col("_text").isNotNull(), "content": F.coalesce("_text", F.lit(""))}).drop("_text")
        reviewed = review_files(marked, policy, options)
        entries = reviewed.filter("is_text AND NOT too_large AND readable").drop("is_text", "too_large", "readable", "failed")
        unreadable = marked.filter("is_text AND NOT too_large AND NOT readable").select("path", "size", "failed")
        return Review(policy, options, marks, entries, unreadable, None, reviewed)
    marks = checkpointed(marks)
    limits = policy.limits
    budgeted = selection.budget_prefix(
        marks.filter(F.col("is_text") & ~F.col("too_large")), limits.max_files, limits.max_total_bytes)
    eligible = files.join(budgeted.filter("within_budget").select("path"), "path", "left_semi")
    read = eligible.withColumn("_text", selection.preview_text(F.col("content"), limit))
    text = read.filter(F.col("_text").isNotNull()).withColumn("content", F.col("_text")).drop("_text")
    unreadable = read.filter(F.col("_text").isNull()).select("path", "size", F.col("content").isNull().alias("failed"))
    return Review(policy, options, marks, review_files(text, policy, options), unreadable, budgeted)
