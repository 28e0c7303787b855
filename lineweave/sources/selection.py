"""Which files are looked at, and how much of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    EXTENSION_LANGUAGES, KERNEL_ROOTS, KERNEL_SUBTREE_INCLUDE, PREVIEW_CHARS, TEXT_EXTENSIONS,
)
from ..functions.globs import combine
from ..functions.text import any_of, byte_prefix, let
from ..functions.words import WordSet
from ..session import checkpointed


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name; empty for none and for dot files."""
    return F.regexp_extract(file_name(path), r"(?s)\A.+\.([^.]*)\z", 1)


def is_hidden(path: Column) -> Column:
    """Does any part of the path start with a dot?"""
    return F.rlike(path, F.lit(r"(^|/)\.[^/]"))


def matches_globs(path: Column, globs) -> Column:
    pattern = combine(globs)
    return F.rlike(path, F.lit(pattern)) if pattern else F.lit(False)


def is_included(path: Column, policy, root: Column | None = None) -> Column:
    """Include and exclude globs of a policy.

    Under the kernel policy a root that is itself a kernel subtree switches to its C files.
    """
    include = matches_globs(path, policy.include_globs or ("**/*",))
    if policy.is_kernel and root is not None:
        include = F.when(root.isin(*KERNEL_ROOTS), matches_globs(path, KERNEL_SUBTREE_INCLUDE)).otherwise(include)
    return include & ~matches_globs(path, policy.exclude_globs)


def ignore_rules_of(text: str) -> list[str]:
    """Globs of an ignore file: one per line, ``#`` starts a comment line."""
    lines = [line.strip() for line in text.splitlines()]
    return [line for line in lines if line and not line.startswith("#")]


def is_ignored(path: Column, rules) -> Column:
    """Ignore globs, tried on the path and on the path with a leading slash.

    All rules become one expression at plan time; a rule that is no valid glob is tried
    below any directory.
    """
    pattern = combine(rules, fallback_anywhere=True)
    if pattern is None:
        return F.lit(False)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.rlike(path, F.lit(pattern)) | F.rlike(rooted, F.lit(pattern))


def is_text(path: Column, content: Column, size: Column, include_binary: bool = False,
            probe_bytes: int = 32 * 1024) -> Column:
    """Text by extension, by being empty, or because its first bytes are valid UTF-8.

    The bytes are only looked at when the name does not decide.
    """
    if include_binary:
        return F.lit(True)
    by_name = extension(path).isin(*TEXT_EXTENSIONS)
    return F.when(by_name | (size == 0), F.lit(True)).otherwise(byte_prefix(content, probe_bytes).isNotNull())


def detect_language(path: Column) -> Column:
    """Language by extension; an unknown extension stands for itself, none gives NULL."""
    ext = extension(path)
    by_language: dict[str, list[str]] = {}
    for name, language in EXTENSION_LANGUAGES.items():
        by_language.setdefault(language, []).append(name)
    case = None
    for language, names in by_language.items():
        case = (F if case is None else case).when(ext.isin(*names), F.lit(language))
    return case.when(ext != "", ext)


def preview_text(content: Column, read_bytes: int | None) -> Column:
    """First ``read_bytes`` bytes as text, cut on a character boundary; None reads all.

    NULL for content that is not UTF-8, which becomes a diagnostic.
    """
    if read_bytes is None:
        return F.try_validate_utf8(content.cast("string"))
    return byte_prefix(content, read_bytes)


def content_preview(content: Column, wanted: bool) -> Column:
    return F.substring(content, 1, PREVIEW_CHARS) if wanted else F.lit(None).cast("string")


def is_suspicious(content: Column, patterns, fast: bool = False) -> Column:
    """Any pattern as a case-insensitive substring; never in fast mode."""
    if fast or not patterns:
        return F.lit(False)
    lowered = F.lower(content)
    return any_of([F.contains(lowered, F.lit(p.lower())) for p in patterns])


def gates(content: Column, policies, fast: bool = False) -> Column:
    """Names of the policies whose patterns a text holds, from one pass over the text for all of them."""
    if fast or not policies:
        return F.array().cast("array<string>")
    words = WordSet(p.lower() for policy in policies for p in policy.suspicious_patterns)

    def decided(found: Column) -> Column:
        return F.array_compact(F.array(*[F.when(
            words.holds_any(found, [p.lower() for p in policy.suspicious_patterns]), F.lit(policy.name)) for policy in policies]))

    return let(words.found(F.lower(content)), decided)


def running_totals(rows: DataFrame, order: str, *values: str, by: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """``rows`` with ``nth`` and, for each value, ``<value>_before``: running totals in order, starting anew for each ``by``.

    A window over a whole group would run in one task, so the sums are taken per range:

    1. rows (narrow ones, please) are range-partitioned by group and order, and written to a checkpoint, so
       that the ranges stay the same when a task is run again; a large group spreads over many ranges;
    2. each range is counted and summed by group;
    3. running sums inside each range are lifted by what the group had in the ranges before it. Only the
       group that a range begins with can have begun earlier, so there is a carry a range at most.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(n, *by, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        F.col("_range").alias("_carried"), *[F.col(c).alias(f"_by_{c}") for c in by], F.sum("_n").over(before).alias("_n0"),
        *[F.sum(f"_sum_{v}").over(before).alias(f"_carry_{v}") for v in values]).filter("_n0 > 0")
    inside = W.partitionBy("_range", *by).orderBy(order)
    running = ranged.select("*", F.row_number().over(inside).alias("_nth"), *[
        F.coalesce(F.sum(v).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{v}") for v in values])
    same = F.col("_range") == F.col("_carried")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = running.join(F.broadcast(carries), same, "left")  # a row a range at most
    return placed.select(*rows.columns, (F.col("_nth") + F.coalesce("_n0", F.lit(0))).alias("nth"), *[
        (F.col(f"_before_{v}") + F.coalesce(f"_carry_{v}", F.lit(0))).alias(f"{v}_before") for v in values])


def budget_prefix(files: DataFrame, max_files: int, max_total_bytes: int, path: str = "path", size: str = "size",
                  partitions: int | None = None, root: str | None = None) -> DataFrame:
    """``path, size, nth, bytes_before, within_budget`` for each file, in path order; with ``root``, for each root alone.

    The kept files are the longest prefix that stays inside both limits.  Counts and sums only
    grow along the order, so no file after the first misfit fits again.
    """
    by = (root,) if root else ()
    placed = running_totals(files.select(*by, path, size), path, size, by=by, partitions=partitions)
    nth, bytes_before = F.col("nth"), F.col(f"{size}_before")
    fits = (nth <= max_files) & (bytes_before < max_total_bytes) & (bytes_before + F.col(size) <= max_total_bytes)
    return placed.select(*by, path, size, nth, bytes_before.alias("bytes_before"), fits.alias("within_budget"))
