"""Counters, the one-row report, JSON and Markdown output, diagnostics."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import REPORT_SCHEMA_VERSION, SEVERITY_RANKS
from ..functions.severity import normalize_severity
from ..session import stored

REPORTED = ("severity", "rule", "message", "category", "line", "source")


def file_counters(classified: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """``files_discovered, files_scanned, skipped_large_files, total_bytes``: one global count.

    ``scanned`` is the budgeted file list; without one every eligible file is scanned.
    """
    eligible = F.col("is_text") & ~F.col("too_large")
    counters = classified.agg(
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(F.col("too_large")).alias("skipped_large_files"),
        F.count_if(eligible).alias("_eligible"),
        F.coalesce(F.sum(F.when(eligible, F.col("size"))), F.lit(0)).alias("_bytes"))
    if scanned is None:
        return counters.select(
            "files_discovered", F.col("_eligible").alias("files_scanned"), "skipped_large_files",
            F.col("_bytes").alias("total_bytes"), F.lit(False).alias("truncated"))
    inside = F.col("within_budget")
    kept = scanned.agg(
        F.count_if(inside).alias("files_scanned"),
        F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("total_bytes"),
        (F.count_if(~inside) > 0).alias("truncated"))
    return counters.crossJoin(F.broadcast(kept)).select(
        "files_discovered", "files_scanned", "skipped_large_files", "total_bytes", "truncated")


def one_pass_totals(reviewed: DataFrame) -> DataFrame:
    """All counters of a review without a budget in one aggregation over its files."""
    eligible = F.col("is_text") & ~F.col("too_large")
    selected = eligible & F.col("readable")

    def count(name: str) -> Column:
        return F.size(F.filter("findings", lambda f: normalize_severity(f["severity"]) == name))

    counted = reviewed.select("size", "too_large", eligible.alias("_eligible"), selected.alias("_selected"), *[
        F.when(selected, count(name)).otherwise(0).alias(name) for name in SEVERITY_RANKS])
    totals = counted.agg(
        F.count(F.lit(1)).alias("files_discovered"), F.count_if("_eligible").alias("files_scanned"),
        F.count_if("too_large").alias("skipped_large_files"),
        F.coalesce(F.sum(F.when(F.col("_eligible"), F.col("size"))), F.lit(0)).alias("total_bytes"),
        F.count_if("_selected").alias("files_selected"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in SEVERITY_RANKS])
    return totals.withColumns({"truncated": F.lit(False),
                               "findings_total": reduce(lambda a, b: a + b, [F.col(n) for n in SEVERITY_RANKS])})


def entry_totals(entries: DataFrame) -> DataFrame:
    """``files_selected``, five severity counters and their total, in one pass over the entries.

    Findings are counted inside their row first, so only numbers are aggregated.
    """
    def count(name: str) -> Column:
        return F.size(F.filter("findings", lambda f: normalize_severity(f["severity"]) == name))

    counted = entries.select(*[count(name).alias(name) for name in SEVERITY_RANKS])
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in SEVERITY_RANKS]
    totals = counted.agg(F.count(F.lit(1)).alias("files_selected"), *sums)
    return totals.withColumn("findings_total", reduce(lambda a, b: a + b, [F.col(n) for n in SEVERITY_RANKS]))


def report_row(review, root: str = "", summary_only: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """The report without its files: one row.

    A review of everything is counted in one pass; with a budget, or with ``entries`` in place
    of the review's own, the row is a cross join of single-row aggregates.
    """
    if entries is None and review.reviewed is not None:
        row = one_pass_totals(review.reviewed)
    else:
        counters = file_counters(review.classified, review.budgeted)
        row = counters.crossJoin(F.broadcast(entry_totals(review.entries if entries is None else entries)))
    skipped = F.greatest(F.lit(0), F.col("files_discovered") - F.col("files_selected"))
    breakdown = F.struct("info", "low", "medium", "high", "critical")
    return row.select(
        F.lit(REPORT_SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.lit(root).alias("root"), F.lit(review.policy.name).alias("profile"),
            F.lit("builtin").alias("profile_source"), F.lit("scan").alias("command"), "truncated",
            F.lit(summary_only).alias("summary_only")).alias("metadata"),
        F.struct("findings_total", "files_discovered", "files_scanned", "files_selected",
                 skipped.alias("files_skipped"), breakdown.alias("severity_breakdown")).alias("stats"),
        "files_discovered", "files_scanned",
        (F.lit(0) if summary_only else F.col("files_selected")).cast("long").alias("files_selected"),
        skipped.alias("files_skipped"), F.col("files_discovered").alias("total_files"), "total_bytes",
        "skipped_large_files", "truncated", breakdown.alias("severity_breakdown"),
        F.concat(F.lit("Scanned "), F.col("files_discovered").cast("string"), F.lit(" files ("),
                 F.col("files_scanned").cast("string"), F.lit(" scanned), "),
                 F.col("findings_total").cast("string"), F.lit(" findings")).alias("summary"))


def summary_only(entries: DataFrame) -> DataFrame:
    """The file list of a summary-only report: same columns, no rows."""
    return entries.limit(0)


def reported_finding(finding: Column) -> Column:
    return F.struct(*[finding[name].alias(name) for name in REPORTED])


def json_entries(entries: DataFrame) -> DataFrame:
    """``path, json``: one JSON document per file; absent fields are left out."""
    shown = F.transform("findings", reported_finding)
    document = F.struct("path", "size", shown.alias("findings"), "content_preview")
    return entries.select("path", F.to_json(document).alias("json"))


def settled(review):
    """The same review with its files worked out: one pass over the corpus writes them, and all reports read that table.

    The table has no texts: marks, findings and previews of every discovered file.
    """
    if review.reviewed is not None:
        done = stored(review.reviewed.drop("content"), "reviewed-files")
        eligible = F.col("is_text") & ~F.col("too_large")
        return replace(
            review, reviewed=done, classified=done.select("path", "size", "is_text", "too_large"),
            entries=done.filter(eligible & F.col("readable")).drop("is_text", "too_large", "readable", "failed"),
            unreadable=done.filter(eligible & ~F.col("readable")).select("path", "size", "failed"))
    return replace(review, entries=stored(review.entries.drop("content"), "reviewed-files"))


def write_json(review, target: str, root: str = "") -> None:
    """Files as JSON lines under ``files``, the report row under ``report``, diagnostics under ``diagnostics``; one review for all."""
    review = settled(review)
    json_entries(review.entries).select(F.col("json").alias("value")).write.mode("errorifexists").text(
        target + "/files")
    report_row(review, root).write.mode("errorifexists").json(target + "/report")
    diagnostics(review).write.mode("errorifexists").json(target + "/diagnostics")


def markdown_entries(entries: DataFrame) -> DataFrame:
    """``path, markdown`` for files that have findings."""
    def bullet(f: Column) -> Column:
        where = F.when(f["line"].isNotNull(), F.concat(F.lit(" line "), f["line"].cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit("- **"), f["severity"], F.lit("** ["), F.coalesce(f["source"], F.lit("local")),
                        F.lit(" / "), f["rule"], where, F.lit("] "), f["message"])

    block = F.concat(F.lit("### `"), F.col("path"), F.lit("`\n"),
                     F.array_join(F.transform("findings", bullet), "\n"), F.lit("\n"))
    return entries.filter(F.size("findings") > 0).select("path", block.alias("markdown"))


def write_markdown(entries: DataFrame, target: str) -> None:
    markdown_entries(entries).select(F.col("markdown").alias("value")).write.mode("errorifexists").text(target)


def diagnostic(source: str, code: str, message: Column, path: Column, level: str = "warning") -> list[Column]:
    return [F.lit(level).alias("level"), F.lit(source).alias("source"), F.lit(code).alias("code"),
            message.alias("message"), path.alias("path")]


def unreadable_diagnostics(unreadable: DataFrame) -> DataFrame:
    """A row per file that could not be read (``failed``) or whose bytes are not text; the review goes on without it."""
    failed = F.col("failed") if "failed" in unreadable.columns else F.lit(False)
    message = F.concat(F.lit("read "), F.col("path").cast("string"),
                       F.when(failed, F.lit(": cannot be read")).otherwise(F.lit(": not valid UTF-8")))
    return unreadable.select(*diagnostic("scan", "runtime", message, F.col("path").cast("string")))


def unparsed_diagnostics(unparsed: DataFrame) -> DataFrame:
    """A row per Python file that the language plane could not parse; its other findings stand."""
    message = F.concat(F.lit("python worker "), F.col("path").cast("string"), F.lit(": source does not parse"))
    return unparsed.select(*diagnostic("worker", "runtime", message, F.col("path").cast("string")))


def trouble_diagnostics(troubles: DataFrame) -> DataFrame:
    """A row per file and analyzer that failed on it or went over the limit of findings."""
    message = F.concat(F.lit("analyzer "), F.col("analyzer"), F.lit(" "), F.col("path").cast("string"), F.lit(": "), F.col("message"))
    return troubles.select(*diagnostic("worker", "runtime", message, F.col("path").cast("string")))


def diagnostics(review) -> DataFrame:
    """All that the review could not read, parse or analyze."""
    found = unreadable_diagnostics(review.unreadable).unionByName(unparsed_diagnostics(review.unparsed))
    return found.unionByName(trouble_diagnostics(review.troubles)) if review.options.analyzers else found
