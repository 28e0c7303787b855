"""Findings algebra: retention, sanitizing, merging, ordering, dedup, nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.findings_schema import FINDING_TYPE, ORDER_FIELDS, PLANES
from ..functions.fixed_values import (
    CATALOG, KERNEL_RULES, MAX_EXTERNAL_FINDINGS, MAX_MESSAGE_BYTES, MAX_NAME_BYTES,
)
from ..functions.severity import external_severity, rank_of, normalize_severity, severity_rank
from ..functions.text import clip_bytes
from ..sources.selection import running_totals

LOCAL_ORIGINS = ("file", "registry")
TASK_FINDINGS = 50_000  # clipped findings, of 5 KB at most, that are sorted in one task


def is_local(origin: Column) -> Column:
    return origin.isin(*LOCAL_ORIGINS)


def kernel_allowed(rule: Column) -> Column:
    return rule.isin(*KERNEL_RULES)


def retained(policy, rule: Column, severity: Column) -> Column:
    """Does a policy report a local finding?"""
    if policy.is_kernel:
        return kernel_allowed(rule)
    threshold = severity_rank(F.lit(policy.severity_threshold))
    return rule.isin(*policy.prioritize) | (severity_rank(severity) >= threshold)


def retain(findings: DataFrame, policy) -> DataFrame:
    """Policy retention of a finding table.

    Findings from language planes and reviews are not held against the threshold; under the
    kernel policy the allow-list covers them too.
    """
    kept = retained(policy, F.col("rule"), F.col("severity"))
    return findings.filter(kept if policy.is_kernel else ~is_local(F.col("origin")) | kept)


def retain_for_policies(findings: DataFrame, policy_rules: DataFrame) -> DataFrame:
    """Local findings of every policy at once.

    ``policy_rules`` has one row per policy and rule it evaluates (see
    ``plans.policies.policy_rule_table``) and is joined on the rule name.
    """
    joined = findings.join(policy_rules, "rule")
    keep = F.when(F.col("kernel"), kernel_allowed(F.col("rule"))).otherwise(
        F.col("prioritized") | (severity_rank(F.col("severity")) >= F.col("threshold_rank")))
    return joined.filter(keep)


def retained_by(policies, rules_of, rule: Column, severity: Column, origin: Column, gates: Column) -> Column:
    """Names of the policies that report a finding, decided in its row; ``rules_of(policy)`` are those it evaluates.

    ``gates`` are the policies whose gate lets the finding's file through; it holds for language planes only.
    """
    def reports(policy) -> Column:
        local = rule.isin(*rules_of(policy)) & retained(policy, rule, severity)
        if not policy.language_planes:
            return is_local(origin) & local
        outside = F.array_contains(gates, policy.name)
        return F.when(is_local(origin), local).otherwise(outside & kernel_allowed(rule) if policy.is_kernel else outside)

    return F.array_compact(F.array(*[F.when(reports(p), F.lit(p.name)) for p in policies]))


def language_for_policies(findings: DataFrame, gates: DataFrame, policy_planes: DataFrame) -> DataFrame:
    """Language-plane findings of every policy that has language planes, of the files that its gate lets through.

    ``gates`` has ``path, policy`` of suspicious files, ``policy_planes`` ``policy, kernel``.  The kernel policy keeps
    its allow-list; thresholds do not apply to these findings.
    """
    let_through = gates.join(policy_planes, "policy")
    return findings.filter(~is_local(F.col("origin"))).join(let_through, "path").filter(
        ~F.col("kernel") | kernel_allowed(F.col("rule")))


def sanitize_external(raw: DataFrame, *order: str, source: str = "worker", key: str = "path",
                      limit: int = MAX_EXTERNAL_FINDINGS, spread: bool = False) -> DataFrame:
    """Findings reported by something outside, cleaned: clipped fields, known severities, stamped source.

    Every row stays: ``nth`` is its place in its file by ``order`` and ``kept`` says whether it is
    within the ``limit`` per file.  Consumers of bounded lists filter on ``kept``; a filter on
    ``nth <= limit`` lets the planner keep at most so many rows a task.  Consumers of all rows ask
    for ``spread``: the findings of a file then never meet in one task (see ``placed_in_file``).
    """
    cleaned = (
        clip_bytes(F.col("rule"), MAX_NAME_BYTES).alias("rule"),
        external_severity(F.col("severity")).alias("severity"),
        clip_bytes(F.col("category"), MAX_NAME_BYTES).alias("category"),
        clip_bytes(F.col("message"), MAX_MESSAGE_BYTES).alias("message"),
        F.col("line").cast("int").alias("line"),
    )
    if spread:
        ranked = placed_in_file(raw, key, order, cleaned)
    else:
        ranked = raw.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).select(key, *cleaned, "_n")
    return ranked.select(
        key, "rule", "severity", "category", "message", "line",
        F.lit(source).alias("source"),
        F.col("_n").alias("nth"),
        (F.col("_n") <= limit).alias("kept"),
    )


def placed_in_file(raw: DataFrame, key: str, order: tuple[str, ...], cleaned: tuple[Column, ...]) -> DataFrame:
    """``key``, ``cleaned`` and ``_n``, the place of each row in its file, without a window over the file.

    Only places, narrow rows with the number of findings at them, are put in order and counted, range by range
    (``running_totals``). Findings are dealt by their place; what is numbered together is those of one place.
    Their fields are clipped first, so that ``TASK_FINDINGS`` of them have a size that is known. The number of parts is given
    because the planner would put parts together by their compressed size, which says little about long repeats; for the same
    reason it must not broadcast the places.
    """
    parts = max(1, -(-raw.count() // TASK_FINDINGS))
    at = F.struct(F.col(key).alias("key"), F.struct(*order).alias("order")).alias("_at")
    places = raw.groupBy(at).agg(F.count(F.lit(1)).alias("_rows")).select("_at.key", "_at.order", "_rows")
    before = running_totals(places, "order", "_rows", by=("key",)).select(F.struct("key", "order").alias("_at"), "_rows_before")
    own = F.row_number().over(W.partitionBy("_at").orderBy("_at"))
    return raw.select(at, *cleaned).repartition(parts, "_at").withColumn("_own", own).join(before.hint("merge"), "_at").select(
        F.col("_at.key").alias(key), "*", (F.col("_rows_before") + F.col("_own")).alias("_n"))


def over_limit(cleaned: DataFrame, key: str = "path") -> DataFrame:
    """``key, dropped``: how many findings of each file are over the limit."""
    return cleaned.groupBy(key).agg(F.count_if(~F.col("kept")).alias("dropped")).filter("dropped > 0")


def external_severity_struct(finding: Column) -> Column:
    """The same cleaning for a finding struct that never left its row."""
    return finding.withField("severity", external_severity(finding["severity"]))


def as_external(cleaned: DataFrame, key: str = "path") -> DataFrame:
    """Sanitized findings in the shared finding layout."""
    emitted = F.struct(*[
        (F.lit(PLANES["external"]) if name == "plane" else F.col("nth") if name == "nth" else F.lit(0))
        .cast("int").alias(name) for name in ORDER_FIELDS])
    values = {"column": F.lit(None), "origin": F.lit("external"), "emitted": emitted}
    return cleaned.select(key, *[
        values.get(f.name, F.col(f.name) if f.name in cleaned.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FINDING_TYPE])


def merge(*planes: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), planes)


def dedup(findings: DataFrame, *keys: str, copies: str | None = None) -> DataFrame:
    """One finding per (file, rule, line, message); ``copies`` names a column with the number of findings it stands for.

    Written as an aggregation, so equal findings collapse inside each task first; which of
    the equals survives does not depend on the partitioning.
    """
    by = [*keys, "rule", "line", "message"]
    rest = [c for c in findings.columns if c not in by]
    first = F.min(F.struct("emitted", *[c for c in rest if c != "emitted"])).alias("_first")
    counted = [F.count(F.lit(1)).alias(copies)] if copies else []
    return findings.groupBy(*by).agg(first, *counted).select(*[
        F.col(c) if c in by else F.col(f"_first.{c}").alias(c) for c in findings.columns], *([copies] if copies else []))


def sort_key(finding: Column) -> Column:
    """Falling severity, then the order in which the rules emitted."""
    return F.struct(
        (-severity_rank(finding["severity"])).alias("rank"), finding["emitted"].alias("emitted"),
        finding["line"].alias("line"), finding["column"].alias("column"), finding["message"].alias("message"))


def ordered(findings: Column) -> Column:
    """A finding array, most severe first."""
    keyed = F.transform(findings, lambda f: F.struct(sort_key(f).alias("k"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda e: e["f"])


def nest(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings of a table grouped under their file.  The group is one output row."""
    row = F.struct(*[F.col(f.name) for f in FINDING_TYPE])
    return findings.groupBy(*keys).agg(F.collect_list(row).alias("findings")).select(
        *keys, ordered(F.col("findings")).alias("findings"))


def attach(files: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Files with their findings; files without any keep an empty array."""
    nested = nest(findings, *keys)
    empty = F.array().cast(nested.schema["findings"].dataType)
    return files.join(nested, list(keys), "left").withColumn("findings", F.coalesce("findings", empty))


def severity_breakdown(findings: DataFrame, *by: str) -> DataFrame:
    """Five fixed counters and their total, overall or per group."""
    severity = normalize_severity(F.col("severity"))
    counters = [F.count_if(severity == name).alias(name) for name in ("info", "low", "medium", "high", "critical")]
    grouped = findings.groupBy(*by).agg(*counters)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in ("info", "low", "medium", "high", "critical")])
    return grouped.withColumn("findings_total", total)


def fail_gate(findings: DataFrame, threshold: str, *by: str) -> DataFrame:
    """``tripped, worst_severity, triggering`` for a threshold; ``none`` never trips."""
    rank = rank_of(F.col("severity"))
    names = {5: "critical", 4: "high", 3: "medium", 2: "low", 1: "info"}
    wanted = 99 if threshold == "none" else {v: k for k, v in names.items()}[threshold]
    worst = F.coalesce(F.max(rank), F.lit(0))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("_worst"))
    return findings.groupBy(*by).agg(worst.alias("_worst"), F.count_if(rank >= wanted).alias("triggering")).select(
        *by, (F.col("_worst") >= wanted).alias("tripped"), F.coalesce(named, F.lit("none")).alias("worst_severity"),
        "triggering")


def rule_counts(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings per catalog rule, zero counts included.

    The findings are reduced to one row per rule before they meet the catalog.
    """
    counted = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))
    return catalog.join(counted, catalog["name"] == counted["rule"], "left").select(
        *catalog.columns, F.coalesce("findings", F.lit(0)).alias("findings"))


def rule_catalog(spark) -> DataFrame:
    rows = [(e.name, e.severity, e.category, e.summary, e.supports_fix) for e in CATALOG]
    return spark.createDataFrame(
        rows, "name string, severity string, category string, summary string, supports_fix boolean")
