"""Analyzers: Python table functions that are called for each file and take part in the review.

An analyzer is a function of a path and a text that yields ``(rule, severity, category, message, line)``. It is called
laterally, as a table function that gives one row a file, so the file stays one row and nothing is shuffled. What it
yields comes from outside the engine and is cleaned as such: clipped fields, known severities, a stamped source. A
failure is a diagnostic, and the review goes on; so is a file with more than ``MAX_EXTERNAL_FINDINGS`` findings, all of which stay.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.findings_schema import FINDING_TYPE, PLANES
from ..functions.fixed_values import MAX_EXTERNAL_FINDINGS, MAX_MESSAGE_BYTES, MAX_NAME_BYTES
from ..functions.severity import external_severity
from ..functions.text import clip_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

RAW = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("rule", "severity", "category", "message")),
                                T.StructField("line", T.IntegerType())]))
Analyze = Callable[[str, str], Iterable[tuple]]


@dataclass(frozen=True)
class Analyzer:
    """``version`` stands for the function wherever stored results are compared."""
    name: str
    language: str
    analyze: Analyze
    version: str = "1"


def table_function(analyzer: Analyzer, found: str = "found", failed: str = "failed"):
    """The analyzer as a table function of ``(path, content)``: one row of two columns; a null text is not analyzed."""
    run, names = analyzer.analyze, (found, failed)

    class Run:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            for given in (path, content):
                if given.dataType.simpleString() != "string":
                    raise TypeError("analyzers read texts")
            return AnalyzeResult(T.StructType([T.StructField(names[0], RAW), T.StructField(names[1], T.StringType())]))

        def eval(self, path, content):
            found, failed = [], None
            if content is not None:
                try:
                    found = [(None if r is None else str(r), s, c, None if m is None else str(m), None if n is None else int(n))
                             for r, s, c, m, n in run(path, content)]
                except Exception as error:  # whatever an analyzer raises is its own failure
                    found, failed = [], f"{type(error).__name__}: {error}"[:500]
            yield found, failed

    return F.udtf(Run)


def cleaned(found: Column, analyzer: Analyzer, nth: int) -> Column:
    """An analyzer's findings in the shared layout, cleaned."""
    def finding(f: Column, i: Column) -> Column:
        values = {
            "rule": clip_bytes(f["rule"], MAX_NAME_BYTES), "severity": external_severity(f["severity"]),
            "category": clip_bytes(f["category"], MAX_NAME_BYTES), "message": clip_bytes(f["message"], MAX_MESSAGE_BYTES),
            "line": f["line"], "column": F.lit(None), "source": F.lit(f"analyzer:{analyzer.name}"), "origin": F.lit("external"),
            "emitted": F.struct(F.lit(PLANES["external"]).alias("plane"), F.lit(nth).alias("step"),
                                F.coalesce(f["line"], F.lit(0)).alias("at"), i.alias("nth"))}
        return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in FINDING_TYPE])

    return F.transform(found, finding)


def analyzed(files: DataFrame, analyzers: tuple[Analyzer, ...], wanted: Column) -> DataFrame:
    """``files`` with ``_analyzed`` (findings) and ``troubles`` (``array<struct<analyzer,message>>``).

    An analyzer sees the files of its language for which ``wanted`` holds.
    """
    found, troubles = [], []
    for nth, analyzer in enumerate(analyzers):
        text = F.when(wanted & (F.col("language") == analyzer.language), F.col("content"))
        called = files.withColumn("_seen", text)
        rows = table_function(analyzer, f"_found{nth}", f"_failed{nth}")(F.col("path").outer(), F.col("_seen").outer())
        files = called.lateralJoin(rows).drop("_seen")
        found.append(cleaned(F.col(f"_found{nth}"), analyzer, nth))
        many = F.size(f"_found{nth}") > MAX_EXTERNAL_FINDINGS
        message = F.coalesce(F.col(f"_failed{nth}"), F.when(many, F.concat(
            F.size(f"_found{nth}").cast("string"), F.lit(f" findings, more than {MAX_EXTERNAL_FINDINGS}"))))
        troubles.append(F.when(message.isNotNull(), F.struct(F.lit(analyzer.name).alias("analyzer"), message.alias("message"))))
    return files.withColumns({"_analyzed": F.concat(*found), "troubles": F.array_compact(F.array(*troubles))}).drop(
        *[f"_{c}{n}" for n in range(len(analyzers)) for c in ("found", "failed")])
