"""Python syntax trees as a symbol table, and rules as a join on it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.findings_schema import FINDING_TYPE, PLANES, no_findings
from ..functions.fixed_values import PYTHON_SYMBOL_RULES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

SYMBOL_FIELDS = [T.StructField("line", T.IntegerType()), T.StructField("kind", T.StringType()),
                 T.StructField("name", T.StringType())]


def _symbols_of(source: str) -> list[tuple[int, str, str]]:
    """Bare-name calls and plain imports of one source; one ``error`` symbol when it does not parse."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return [(getattr(error, "lineno", None) or 1, "error", type(error).__name__)]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            found.append((node.lineno, "call", node.func.id))
        elif isinstance(node, ast.Import):
            found.extend((node.lineno, "import", name.name) for name in node.names)
    return found


def python_symbols(files: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """``keys, line, kind, name`` of every Python source; one pass, no shuffle."""
    schema = T.StructType([files.schema[k] for k in keys] + SYMBOL_FIELDS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*key, *symbol)
                for *key, source in batch.itertuples(index=False, name=None)
                for symbol in _symbols_of(source)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return files.select(*keys, content).filter(F.col(content).isNotNull()).mapInPandas(parse, schema)


def symbol_rules(spark, rules=PYTHON_SYMBOL_RULES) -> DataFrame:
    """The rule side of the join; a literal list, so the planner knows its size."""
    return spark.createDataFrame(list(rules), "rule string, severity string, message string, kind string, name string")


def symbol_findings(symbols: DataFrame, *keys: str, rules=PYTHON_SYMBOL_RULES) -> DataFrame:
    """Findings for symbols that a rule names: a join with the short rule list."""
    hits = symbols.join(symbol_rules(symbols.sparkSession, rules), ["kind", "name"])
    values = {"rule": F.col("rule"), "severity": F.col("severity"), "message": F.col("message"),
              "line": F.col("line"), "source": F.lit("worker"), "origin": F.lit("language"),
              "emitted": F.struct(F.lit(PLANES["language"]), F.lit(0), F.col("line"), F.lit(0))}
    return hits.select(*keys, *[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING_TYPE])


SYMBOLS_TYPE = T.ArrayType(T.StructType(SYMBOL_FIELDS))


@F.arrow_udf(SYMBOLS_TYPE)
def symbols_in_row(sources: pa.Array) -> pa.Array:
    """Symbols of each source inside its row; NULL sources, those of other languages, give none."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("name", pa.string())]))
    return pa.array([None if source is None else [{"line": line, "kind": k, "name": name} for line, k, name in _symbols_of(source)]
                     for source in sources.to_pylist()], kind)


def _findings_of_rule(symbols: Column, nth: int, rule: str, severity: str, message: str, kind: str, name: str) -> Column:
    def worded(symbol: Column) -> Column:
        values = {"rule": F.lit(rule), "severity": F.lit(severity), "message": F.lit(message), "line": symbol["line"],
                  "source": F.lit("worker"), "origin": F.lit("language"),
                  "emitted": F.struct(F.lit(PLANES["language"]), F.lit(0), symbol["line"], F.lit(nth))}
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING_TYPE])

    return F.transform(F.filter(symbols, lambda s: (s["kind"] == kind) & (s["name"] == name)), worded)


def python_findings(symbols: Column, rules=PYTHON_SYMBOL_RULES) -> Column:
    """The findings of one file from its symbols."""
    found = [_findings_of_rule(symbols, nth, *rule) for nth, rule in enumerate(rules)]
    return F.coalesce(F.concat(*found), no_findings())


def unparsed(symbols: Column) -> Column:
    return F.coalesce(F.exists(symbols, lambda s: s["kind"] == "error"), F.lit(False))
