"""The derived code corpus: lines and files of source code built from ``events``.

The driver tables hold almost no code.  Each event becomes one line of a 64-line file, in
plain expressions that Spark and the oracle's SQL share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.findings_schema import sql_text
from lineweave.operators.lines import assemble_files

from .tables import table
from .templates import (
    CLOSERS, DENSE, DEFAULT_CLOSER, DEFAULT_FILLER, EXTENSIONS, FILLERS, LANGUAGES, LINES_PER_FILE, OPENERS, TEMPLATES,
)


def _by_language(column: str, value_of) -> str:
    cases = " ".join(f"WHEN {sql_text(lang)} THEN {value_of(lang)}" for lang in LANGUAGES)
    return f"CASE {column} {cases} END"


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, language, file_id, line, text``; a narrow projection of ``events``."""
    events = table(spark, sf_dir, "events", "event_id", "props")
    n = len(LANGUAGES)
    langs = "array(" + ", ".join(map(sql_text, LANGUAGES)) + ")"
    exts = "array(" + ", ".join(map(sql_text, EXTENSIONS)) + ")"
    numbered = events.selectExpr(
        f"event_id DIV {LINES_PER_FILE} AS file_id",
        f"CAST(event_id % {LINES_PER_FILE} + 1 AS int) AS line",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k")
    named = numbered.selectExpr("*", f"get({langs}, CAST(file_id % {n} AS int)) AS language",
                                f"get({exts}, CAST(file_id % {n} AS int)) AS ext")
    opener = _by_language("language", lambda x: sql_text(OPENERS.get(x, FILLERS.get(x, DEFAULT_FILLER))))
    closer = _by_language("language", lambda x: sql_text(CLOSERS.get(x, DEFAULT_CLOSER)))
    filler = _by_language("language", lambda x: sql_text(FILLERS.get(x, DEFAULT_FILLER)))
    template = _by_language(
        "language", lambda x: "get(array(" + ", ".join(map(sql_text, TEMPLATES[x])) + "), k)")
    indent = "CASE WHEN language = 'python' THEN '    ' ELSE '' END"
    text = (
        f"CASE WHEN line = 1 AND file_id % 3 = 0 THEN {opener} "
        f"WHEN line = {LINES_PER_FILE} THEN {closer} "
        f"ELSE {indent} || coalesce({template}, {filler}) END")
    # the generator keeps filters on ``text`` from being pushed below and repeating its CASE
    return named.selectExpr(
        "'src/d' || (file_id % 7) || '/f' || file_id || '.' || ext AS path", "language", "file_id", "line",
        f"explode(array({text})) AS text")


def dense_lines(spark: SparkSession, sf_dir: str, name: str, giant: bool = False) -> DataFrame:
    """One of the dense corpora, in the same layout. With ``giant``, file 0 has every other line of the corpus."""
    size, languages = DENSE[name]
    events = table(spark, sf_dir, "events", "event_id", "props")
    names = "array(" + ", ".join(map(sql_text, languages)) + ")"
    file_id, line = f"event_id DIV {size}", f"event_id % {size} + 1"
    if giant:
        file_id = f"CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id DIV {2 * size} + 1 END"
        line = f"CASE WHEN event_id % 2 = 0 THEN event_id DIV 2 ELSE event_id DIV 2 % {size} END + 1"
    numbered = events.selectExpr(f"{file_id} AS file_id", f"CAST({line} AS int) AS line",
                                 "CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k")
    named = numbered.selectExpr("*", f"get({names}, CAST(file_id % {len(languages)} AS int)) AS language")
    cases = " ".join(
        f"WHEN {sql_text(x)} THEN get(array({', '.join(map(sql_text, texts))}), k % {len(texts)})"
        for x, texts in languages.items())
    return named.selectExpr(f"'{name}/f' || file_id || '.x' AS path", "language", "file_id", "line",
                            f"explode(array(CASE language {cases} END)) AS text")


def dense_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return assemble_files(dense_lines(spark, sf_dir, name), "path", "language", "file_id")


def code_files(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    """``path, language, file_id, lines, content``: one row per 64-line file."""
    lines = code_lines(spark, sf_dir)
    if languages:
        lines = lines.filter(F.col("language").isin(*languages))
    return assemble_files(lines, "path", "language", "file_id")


def binary_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as a source would list them: ``path, size, modified, content binary``."""
    return code_files(spark, sf_dir).select(
        "path", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"),
        F.encode("content", "UTF-8").alias("content"))
