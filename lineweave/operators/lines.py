"""Files to lines and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines, trimmed
from ..functions.triggers import trim_sql


def unnest(df: DataFrame, array: str, alias: str, *keep: str) -> DataFrame:
    """One row per array element (outer generator: see ``findings_from_hits``)."""
    out = df.select(*keep, F.explode_outer(array).alias(alias))
    return out.filter(F.col(alias).isNotNull())


def unnest_findings(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """Finding arrays to flat finding rows."""
    return unnest(df, array, "_finding", *keep).select(*keep, "_finding.*")


def with_lines(files: DataFrame, content: str = "content", keep_cr: bool = False) -> DataFrame:
    """Add ``lines array<string>`` next to each file.  Narrow: the file stays one row."""
    return files.withColumn("lines", split_lines(F.col(content), keep_cr))


def explode_lines(files: DataFrame, *carry: str, content: str = "content") -> DataFrame:
    """One row per line: ``carry columns, line int, text string``.

    Generator output needs no shuffle, and the content itself is not carried along.
    """
    split = files.select(*carry, split_lines(F.col(content)).alias("_lines"))
    rows = split.select(*carry, F.posexplode_outer("_lines").alias("_pos", "text")).filter(F.col("_pos").isNotNull())
    return rows.select(*carry, (F.col("_pos") + 1).cast("int").alias("line"), "text")


def with_views(lines: DataFrame) -> DataFrame:
    """Lowered and trimmed text, computed once per line for all rules."""
    return lines.select("*", F.lower("text").alias("_lower"), F.expr(trim_sql("text")).alias("_trim"),
                        F.contains("text", F.lit("(")).alias("_calls"))


def viewed(lines: Column) -> Column:
    """``array<struct<line,text,lower,trim,calls>>``: the same views for lines inside a row."""
    return F.transform(lines, lambda text, i: F.struct(
        (i + 1).alias("line"), text.alias("text"), F.lower(text).alias("lower"), trimmed(text).alias("trim"),
        F.contains(text, F.lit("(")).alias("calls")))


def assemble_files(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines back to one row per file: ``keys, lines, content``.

    One shuffle by file.  For corpora whose files have a bounded number of lines: the group is
    one file, which becomes one row.  Line rules need no assembled files.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    grouped = lines.groupBy(*keys).agg(ordered.alias("_ordered"))
    with_text = grouped.select(*keys, F.col("_ordered.text").alias("lines"))
    return with_text.withColumn("content", F.array_join("lines", "\n"))
