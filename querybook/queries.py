"""Registered queries and their oracle SQL."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import fixed_values as V
from lineweave.functions.findings_schema import findings_from_hits, findings_of, no_hits
from lineweave.functions.severity import external_severity
from lineweave.operators import (
    block_rules, block_scan, c_rules, file_rules, findings as algebra, fixes, line_rules, python_symbols, script_rules, secrets,
)
from lineweave.operators.lines import explode_lines, unnest, unnest_findings, viewed
from lineweave.operators.analyzers import Analyzer
from lineweave.operators.rule_table import RULE_SCHEMA, TableRules
from lineweave.operators.rulepack import RulePack, UserRule
from lineweave.plans import incremental, report, review_queue as queue
from lineweave.plans.policies import (
    BY_NAME, POLICIES, Policy, ReviewBudget, evaluated_rules, policy_named, policy_rule_table, policy_table,
)
from lineweave.plans.review import ReviewOptions, add_findings, language_hits, review, review_files
from lineweave.session import scratch_dir, stored
from lineweave.sources import ignore_table, selection
from lineweave.sources.versions import CorpusVersions
from lineweave.streaming.ingest import FILES_SCHEMA, current_entries, rescan, start_reviews
from lineweave.streaming.store import ReviewStore

from . import duck_sql as D
from .code_corpus import binary_code_files, code_files, code_lines, dense_files, dense_lines
from .duck_sql import compose, in_list, q
from .tables import DOC_PATH, DOC_TIME, document_files, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # an analyzer of this module runs in the tasks
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


TEXTS = ("rule", "severity", "category", "message")
AT_LINE = ("path", "line") + TEXTS
SQL_AT_LINE = "SELECT path, line, rule, severity, category, message FROM "
C_AT = ("path", "line", "column AS col") + TEXTS
SQL_C_AT = "SELECT path, line, col, rule, severity, category, message FROM "


def values(rows, columns: str) -> str:
    def one(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        return q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + f") AS {columns}"


# --- texts of the driver tables ---------------------------------------------------------
@register("doc_file_rules", "SELECT path AS doc_id, rule, severity, category, message FROM ("
          + D.worded(D.file_rule_rows("documents", "doc_id", "text"), V.FILE_RULES) + ")")
def doc_file_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    hits = docs.select("doc_id", file_rules.file_rule_hits(F.col("text")).alias("hits"))
    return findings_from_hits(hits, "hits", "doc_id").select("doc_id", *TEXTS)


@register("doc_secret_assignments", f"""
    SELECT doc_id, line, regexp_extract(m, {q(secrets.ASSIGNMENT)}, 1) AS key,
           regexp_extract(m, {q(secrets.ASSIGNMENT)}, 2) || regexp_extract(m, {q(secrets.ASSIGNMENT)}, 3) AS value
    FROM (SELECT doc_id, line, unnest(regexp_extract_all(text, {q(secrets.ASSIGNMENT)}, 0)) AS m
          FROM ({D.lines_of("documents", "doc_id", "text")}))
    WHERE NOT {D.has("lower(value)", V.SECRET_PLACEHOLDERS)} AND NOT regexp_matches(value, '^[$][{{][^}}]*[}}]$')""")
def doc_secret_assignments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.secret_assignments(docs, "doc_id", content="text")


DOC_STYLE = ("line-length", "space-before-tab", "trailing-whitespace")


@register("doc_line_style", "SELECT path AS doc_id, line, col, rule, severity, message FROM ("
          + D.worded(D.style_rows("doc_lines", "doc_id", rules=DOC_STYLE), V.C_STYLE_RULES, "detail").replace(
              "FROM doc_lines", f"FROM ({D.lines_of('documents', 'doc_id', 'text')})") + ")")
def doc_line_style(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = c_rules.style_findings(explode_lines(docs, "doc_id", content="text"), "doc_id", rules=DOC_STYLE)
    return found.select("doc_id", "line", F.col("column").alias("col"), "rule", "severity", "message")


PAGE_RULES = ("commented-out-code", "deprecated-api", "weak-hash-usage", "sql-string-concatenation")
PAGE_STYLE = ("line-length", "brace-style")


@register("page_line_rules", "SELECT page_id, line, rule, severity, message FROM ("
          "SELECT path AS page_id, * FROM (" + D.worded(D.line_rule_rows("page_lines", "page_id", PAGE_RULES),
                                                        V.LINE_RULES)
          + ") UNION ALL SELECT path AS page_id, * FROM ("
          + D.worded(D.style_rows("page_lines", "page_id", rules=PAGE_STYLE), V.C_STYLE_RULES, "detail") + "))")
def page_line_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html").withColumn("language", F.lit("html"))
    lines = explode_lines(pages, "page_id", "language", content="html")
    # both rule families become one array of hits per line, so the pages are read once
    registry = line_rules.with_line_hits(lines, "page_id", "text", rules=PAGE_RULES)
    style = c_rules.style_hits(F.col("line"), F.col("text"), PAGE_STYLE)
    hits = registry.select("page_id", F.concat(F.coalesce("_hits", no_hits()), style).alias("hits"))
    return findings_from_hits(hits, "hits", "page_id").select("page_id", "line", "rule", "severity", "message")


ORACLES["page_line_rules"] = (
    f"WITH page_lines AS (SELECT *, 'html' AS language FROM ({D.lines_of('pages', 'page_id', 'html')})) "
    + ORACLES["page_line_rules"])


# --- selection ---------------------------------------------------------------------------
# Every code file also appears under a directory and a root that selection has to judge.
PLACES = ("node_modules/", ".git/", "drivers/", "a/.cache/", "net/deep/", "", "target/x/", "docs/")
IGNORE_FILE = "# generated\n\n*.rb\n/docs/**\nbroken[\nsrc/d3/**\n"


def placed_paths(spark, sf_dir) -> DataFrame:
    place = F.get(F.array(*[F.lit(p) for p in PLACES]), (F.col("file_id") % len(PLACES)).cast("int"))
    root = F.when(F.col("file_id") % 3 == 0, F.lit("net")).otherwise(F.lit("linux"))
    files = code_lines(spark, sf_dir).filter("line = 1").select("file_id", "path")
    return files.select("file_id", F.concat(place, F.col("path")).alias("path"), root.alias("root"))


_place = f"([{', '.join(map(q, PLACES))}])[file_id % {len(PLACES)} + 1]"
_kernel_dirs = " OR ".join(f"starts_with(path, {q(g[:-2])})" for g in BY_NAME["kernel-c"].include_globs)
_kernel_not = " OR ".join(f"starts_with(path, {q(g[:-2])})" for g in BY_NAME["kernel-c"].exclude_globs)


@register("select_paths", compose(f"""
    SELECT path, root, regexp_matches(path, '(^|/)[.][^/]') AS hidden,
      NOT (starts_with(path, '.git/') OR starts_with(path, 'target/') OR starts_with(path, 'node_modules/')) AS included,
      (CASE WHEN root = 'net' THEN ends_with(path, '.c') OR ends_with(path, '.h') ELSE {_kernel_dirs} END)
        AND NOT ({_kernel_not}) AS kernel_included,
      ends_with(path, '.rb') OR starts_with(path, 'docs/') OR starts_with(path, 'src/d3/') AS ignored
    FROM (SELECT {_place} || path AS path, CASE WHEN file_id % 3 = 0 THEN 'net' ELSE 'linux' END AS root
          FROM code_lines WHERE line = 1)""", "code_lines"))
def select_paths(spark, sf_dir):
    paths, path = placed_paths(spark, sf_dir), F.col("path")
    return paths.select(
        "path", "root", selection.is_hidden(path).alias("hidden"),
        selection.is_included(path, policy_named("quick")).alias("included"),
        selection.is_included(path, policy_named("kernel-c"), F.col("root")).alias("kernel_included"),
        selection.is_ignored(path, selection.ignore_rules_of(IGNORE_FILE)).alias("ignored"))


PROBE_EXTENSIONS = ("txt", "bin", "", "dat")


def probe_files(spark, sf_dir) -> DataFrame:
    """Documents as bytes; every third starts with a byte that is not UTF-8, every seventh is empty."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ext = F.get(F.array(*[F.lit("." + e if e else "") for e in PROBE_EXTENSIONS]), (F.col("doc_id") % 4).cast("int"))
    data = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 7 == 0, F.lit(b"")).when(
        F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xff"), data)).otherwise(data)
    return docs.select(F.concat(F.lit("p/"), F.col("doc_id").cast("string"), ext).alias("path"),
                       content.alias("content")).withColumn("size", F.octet_length("content").cast("long"))


_probe = (f"SELECT doc_id, 'p/' || doc_id || ([{', '.join(q('.' + e if e else '') for e in PROBE_EXTENSIONS)}])"
          f"[doc_id % 4 + 1] AS path, text FROM documents")


IGNORE_ROWS = [("r0", "src/d1/**"), ("r0", "*.py"), ("r1", "**/d2/*.js"), ("r1", "src/d3/f1*.go"), ("r2", "*.{java,rb}"), ("r2", "/src/d0/**"),
               ("r2", "# nothing"), ("r9", "**")]


@register("ignore_by_root", compose("""
    SELECT DISTINCT 'r' || (file_id % 3) AS root, path, CASE file_id % 3
        WHEN 0 THEN path LIKE 'src/d1/%' OR path LIKE '%.py'
        WHEN 1 THEN regexp_matches(path, '(^|/)d2/.*[.]js$') OR path LIKE 'src/d3/f1%.go'
        ELSE path LIKE '%.java' OR path LIKE '%.rb' OR path LIKE 'src/d0/%' END AS ignored FROM code_lines""", "code_lines"))
def ignore_by_root(spark, sf_dir):
    """Files of three roots against a table of ignore rules, each root with its own."""
    files = code_lines(spark, sf_dir).select(F.format_string("r%d", F.col("file_id") % 3).alias("root"), "path").distinct()
    rules = ignore_table.compiled(spark.createDataFrame(IGNORE_ROWS, "root string, glob string"))
    gone = ignore_table.ignored_paths(files, rules).withColumn("ignored", F.lit(True))
    return files.join(gone, ["root", "path"], "left").select("root", "path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


@register("text_classify", f"""
    SELECT path, doc_id % 4 = 0 OR doc_id % 7 = 0 OR doc_id % 3 <> 0 AS is_text FROM ({_probe})""")
def text_classify(spark, sf_dir):
    files = probe_files(spark, sf_dir)
    return files.select("path", selection.is_text(F.col("path"), F.col("content"), F.col("size")).alias("is_text"))


@register("scan_diagnostics", f"""
    SELECT 'warning' AS level, 'scan' AS source, 'runtime' AS code, 'read ' || path || ': not valid UTF-8' AS message,
           path FROM ({_probe}) WHERE doc_id % 7 <> 0 AND doc_id % 3 = 0""")
def scan_diagnostics(spark, sf_dir):
    files = probe_files(spark, sf_dir)
    unreadable = files.filter(selection.preview_text(F.col("content"), None).isNull())
    return report.unreadable_diagnostics(unreadable)


_ext = "regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.+[.]([^.]*)$', 1)"


@register("lang_detect", compose(
    f"SELECT path, coalesce(m.language, nullif({_ext}, ''), 'none') AS language FROM "
    "(SELECT url AS path FROM pages UNION ALL SELECT path FROM code_lines WHERE line = 1) p LEFT JOIN "
    + values(V.EXTENSION_LANGUAGES.items(), "m(ext, language)") + f" ON m.ext = {_ext}", "code_lines"))
def lang_detect(spark, sf_dir):
    urls = table(spark, sf_dir, "pages", "url").withColumnRenamed("url", "path")
    paths = urls.unionByName(code_lines(spark, sf_dir).filter("line = 1").select("path"))
    return paths.select("path", F.coalesce(selection.detect_language(F.col("path")), F.lit("none")).alias("language"))


_quick = policy_named("quick").limits


@register("budget_prefix", f"""
    SELECT path, size, nth, bytes_before, nth <= {_quick.max_files} AND bytes_before < {_quick.max_total_bytes}
        AND bytes_before + size <= {_quick.max_total_bytes} AS within_budget
    FROM (SELECT path, size, row_number() OVER (ORDER BY path) AS nth,
                 CAST(sum(size) OVER (ORDER BY path) - size AS BIGINT) AS bytes_before
          FROM (SELECT {DOC_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents))""")
def budget_prefix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.format_string("doc/%012d", "doc_id").alias("path"),
                        F.octet_length("text").cast("long").alias("size"))
    return selection.budget_prefix(sized, _quick.max_files, _quick.max_total_bytes)


_rooted = """(SELECT CASE WHEN doc_id % 2 = 0 THEN 'mono' ELSE source END AS root, doc_id, strlen(text) AS size FROM documents)"""
ROOT_FILES, ROOT_BYTES = 40, 60_000


@register("budget_by_root", f"""
    SELECT root, path, size, nth, bytes_before, nth <= {ROOT_FILES} AND bytes_before < {ROOT_BYTES}
        AND bytes_before + size <= {ROOT_BYTES} AS within_budget
    FROM (SELECT root, path, size, row_number() OVER w AS nth, CAST(sum(size) OVER w - size AS BIGINT) AS bytes_before
          FROM (SELECT root, {DOC_PATH} AS path, CAST(size AS BIGINT) AS size FROM {_rooted}) WINDOW w AS (PARTITION BY root ORDER BY path))""")
def budget_by_root(spark, sf_dir):
    """A budget for each root; one root has half of all files."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = docs.select(F.when(F.col("doc_id") % 2 == 0, "mono").otherwise(F.col("source")).alias("root"),
                        F.format_string("doc/%012d", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return selection.budget_prefix(sized, ROOT_FILES, ROOT_BYTES, root="root")


@register("bounded_preview", f"""
    SELECT doc_id, sha256(preview) AS preview_hash, CAST(strlen(preview) AS BIGINT) AS preview_bytes,
           sha256(substr(text, 1, {V.PREVIEW_CHARS})) AS shown_hash
    FROM (SELECT doc_id, text, CASE WHEN strlen(text) <= {_quick.max_file_read_bytes} THEN text
            ELSE substr(text, 1, CAST(list_max(list_filter(range({_quick.max_file_read_bytes // 4}, {_quick.max_file_read_bytes + 1}),
                 lambda k: strlen(substr(text, 1, CAST(k AS BIGINT))) <= {_quick.max_file_read_bytes})) AS BIGINT)) END
            AS preview FROM documents)""")
def bounded_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    preview = selection.preview_text(F.encode("text", "UTF-8"), _quick.max_file_read_bytes)
    return docs.select("doc_id", "text", preview.alias("preview")).select(
        "doc_id", F.sha2("preview", 256).alias("preview_hash"),
        F.octet_length("preview").cast("long").alias("preview_bytes"),
        F.sha2(selection.content_preview(F.col("text"), True), 256).alias("shown_hash"))


_patterns = [(p.name, w.lower()) for p in POLICIES for w in dict.fromkeys(p.suspicious_patterns)]


@register("suspicious_gate", f"""
    SELECT policy, count(DISTINCT CASE WHEN contains(lower(text), pattern) THEN doc_id END) AS suspicious_docs
    FROM documents CROSS JOIN {values(_patterns, "t(policy, pattern)")} GROUP BY policy""")
def suspicious_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "text").select(selection.gates(F.col("text"), POLICIES).alias("gates"))
    counts = docs.agg(*[F.count_if(F.array_contains("gates", p.name)).alias(p.name) for p in POLICIES])
    return counts.unpivot([], [p.name for p in POLICIES], "policy", "suspicious_docs")


# --- line rules on code ------------------------------------------------------------------
@register("line_rules_all", compose(SQL_AT_LINE + "line_findings", "line_findings"))
def line_rules_all(spark, sf_dir):
    return line_rules.line_rule_findings(code_lines(spark, sf_dir), "path").select(*AT_LINE)


@register("empty_handlers", compose(SQL_AT_LINE + "handler_findings", "handler_findings",
                                    lines=D.dense_lines("handlers")))
def empty_handlers(spark, sf_dir):
    files = dense_files(spark, sf_dir, "handlers").withColumn("_views", viewed(F.col("lines")))
    hits = block_rules.handler_hits("_views", F.col("lines"), F.col("content"))
    return findings_from_hits(files.select("path", hits.alias("hits")), "hits", "path").select(*AT_LINE)


@register("long_functions", compose(SQL_AT_LINE + "long_findings", "long_findings", lines=D.dense_lines("spans")))
def long_functions(spark, sf_dir):
    files = dense_files(spark, sf_dir, "spans").withColumn("_views", viewed(F.col("lines")))
    hits = files.select("path", block_rules.long_function_hits(F.col("_views")).alias("hits"))
    return findings_from_hits(hits, "hits", "path").select(*AT_LINE)


def local_findings(spark, sf_dir) -> DataFrame:
    """File and registry findings of every code file, from one pass over the files."""
    files = code_files(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long"))
    every = Policy(name="every", rules=tuple(r.name for r in V.FILE_RULES))
    entries = review_files(files.drop("lines", "file_id"), every, ReviewOptions(rule_set="all"))
    return unnest_findings(entries, "findings", "path", "language")


_catalog = [(e.name, e.severity, e.category, e.summary, e.supports_fix) for e in V.CATALOG]


@register("rule_catalog_counts", compose(
    "SELECT c.name, c.severity, c.category, c.summary, c.supports_fix, count(f.rule) AS findings FROM "
    + values(_catalog, "c(name, severity, category, summary, supports_fix)")
    + " LEFT JOIN local_findings f ON f.rule = c.name GROUP BY ALL", "local_findings"))
def rule_catalog_counts(spark, sf_dir):
    return algebra.rule_counts(local_findings(spark, sf_dir), algebra.rule_catalog(spark))


@register("ts_rules", compose(SQL_AT_LINE + "ts_findings", "ts_findings"))
def ts_rules(spark, sf_dir):
    return script_rules.script_line_findings(script_rules.TYPESCRIPT, code_lines(spark, sf_dir), "path").select(*AT_LINE)


@register("java_rules", compose(SQL_AT_LINE + "java_findings", "java_findings"))
def java_rules(spark, sf_dir):
    return script_rules.script_line_findings(script_rules.JAVA, code_lines(spark, sf_dir), "path").select(*AT_LINE)


@register("ts_taint", compose(SQL_AT_LINE + "ts_flow", "ts_flow", lines=D.dense_lines("flows")))
def ts_taint(spark, sf_dir):
    return script_rules.flow_findings(script_rules.TYPESCRIPT, dense_lines(spark, sf_dir, "flows"), "path").select(*AT_LINE)


@register("ts_taint_in_row", compose(SQL_AT_LINE + "ts_flow", "ts_flow", lines=D.dense_lines("flows")))
def ts_taint_in_row(spark, sf_dir):
    """The same flows as arrays inside the file's row, as the single-pass review finds them."""
    files = dense_files(spark, sf_dir, "flows").filter("language = 'typescript'")
    views = files.withColumn("_views", viewed(F.col("lines")))
    hits = script_rules.flow_hits(script_rules.TYPESCRIPT, F.col("_views"), F.col("content"))
    return findings_from_hits(views.select("path", hits.alias("hits")), "hits", "path").select(*AT_LINE)


@register("java_taint", compose(SQL_AT_LINE + "java_flow", "java_flow", lines=D.dense_lines("flows")))
def java_taint(spark, sf_dir):
    return script_rules.flow_findings(script_rules.JAVA, dense_lines(spark, sf_dir, "flows"), "path").select(*AT_LINE)


@register("python_ast", compose("""
    SELECT path, line, CASE WHEN t = 'import pdb' THEN 'debugger-import' WHEN starts_with(t, 'eval(')
        THEN 'python-eval-usage' ELSE 'debug-print' END AS rule,
      CASE WHEN t = 'import pdb' THEN 'medium' WHEN starts_with(t, 'eval(') THEN 'high' ELSE 'low' END AS severity
    FROM (SELECT path, line, trim(text) AS t FROM code_lines WHERE language = 'python')
    WHERE t = 'import pdb' OR starts_with(t, 'eval(') OR starts_with(t, 'print(')""", "code_lines"))
def python_ast(spark, sf_dir):
    # code lines of many kinds do not parse as one module, so each line is its own source
    python = code_lines(spark, sf_dir).filter("language = 'python'")
    sources = python.select("path", F.col("line").alias("at"), F.trim("text").alias("content"))
    symbols = python_symbols.python_symbols(sources, "path", "at")
    found = python_symbols.symbol_findings(symbols, "path", "at")
    return found.select("path", F.col("at").alias("line"), "rule", "severity")


_PY = {"print(x)": ("debug-print",), "eval(y)": ("python-eval-usage",), "import pdb": ("debugger-import",),
       "import os, pdb": ("debugger-import",), "print(eval(y))": ("debug-print", "python-eval-usage")}
_py_rows = [(text, rule) for text, rules in _PY.items() for rule in rules]
_py_rules = [(name, severity, message) for name, severity, message, _, _ in V.PYTHON_SYMBOL_RULES]


@register("python_review", compose(
    "SELECT path, line, rule, severity, message FROM code_lines JOIN " + values(_py_rows, "t(text, rule)")
    + " USING (text) JOIN " + values(_py_rules, "m(rule, severity, message)") + " USING (rule)"
    " WHERE path IN (SELECT path FROM code_lines WHERE contains(lower(text), 'password'))", "code_lines",
    lines=D.dense_lines("scripts")))
def python_review(spark, sf_dir):
    """Whole Python files, parsed in the tasks, as the review merges them."""
    files = dense_files(spark, sf_dir, "scripts").select(
        "path", "language", "content", F.octet_length("content").cast("long").alias("size"))
    entries = review_files(files, policy_named("security"), ReviewOptions(rule_set="scan"))
    found = unnest_findings(entries, "findings", "path")
    return found.filter("origin = 'language'").select("path", "line", "rule", "severity", "message")


# --- C sources ---------------------------------------------------------------------------
def c_query(hits: Callable[[], Column]) -> Query:
    def run(spark, sf_dir):
        files = dense_files(spark, sf_dir, "dense_c").withColumn("_entries", c_rules.numbered(F.col("lines")))
        return findings_from_hits(files.select("path", hits().alias("hits")), "hits", "path").selectExpr(*C_AT)
    return run


@register("c_style", compose(SQL_C_AT + "c_style_findings", "c_style_findings", lines=D.dense_lines("dense_c")))
def c_style(spark, sf_dir):
    return c_rules.style_findings(dense_lines(spark, sf_dir, "dense_c"), "path").selectExpr(*C_AT)


for _name, _cte, _hits in (
    ("c_locks", "c_lock_findings", lambda: c_rules.lock_hits(F.col("_entries"))),
    ("c_rcu", "c_rcu_findings", lambda: c_rules.rcu_hits(F.col("_entries"))),
    ("c_goto", "c_goto_findings", lambda: c_rules.goto_hits(F.col("_entries"), F.col("lines"))),
    ("c_null_deref", "c_null_findings", lambda: c_rules.null_check_hits(F.col("_entries"))),
    ("c_init_exit", "c_marker_findings", lambda: c_rules.marker_hits(F.col("lines"))),
    ("c_calls", "c_call_findings", lambda: c_rules.call_hits(F.col("_entries"))),
):
    register(_name, compose(SQL_C_AT + _cte, _cte, lines=D.dense_lines("dense_c")))(c_query(_hits))


# --- line tables in blocks, half of all lines in one file --------------------------------
for _name, _cte, _corpus, _scan in (
    ("line_locks", "c_lock_findings", "dense_c", block_scan.lock_findings),
    ("line_rcu", "c_rcu_findings", "dense_c", block_scan.rcu_findings),
):
    register(_name, compose(SQL_C_AT + _cte, _cte, lines=D.dense_lines(_corpus, giant=True)))(
        lambda spark, sf_dir, corpus=_corpus, scan=_scan: scan(dense_lines(spark, sf_dir, corpus, giant=True), "path").selectExpr(*C_AT))


@register("line_functions", compose(SQL_AT_LINE + "long_findings", "long_findings", lines=D.dense_lines("spans", giant=True)))
def line_functions(spark, sf_dir):
    return block_scan.long_function_findings(dense_lines(spark, sf_dir, "spans", giant=True), "path").select(*AT_LINE)


# --- findings algebra and policies --------------------------------------------------------
_policy_rules = [
    (p.name, r, r in p.prioritize, V.SEVERITY_RANKS[p.severity_threshold], p.is_kernel)
    for p in POLICIES for r in evaluated_rules(p, "scan")
    if not (p.is_kernel and r in file_rules.NOT_FOR_KERNEL)]
_rank = ("CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'warning' THEN 3 "
         "WHEN 'warn' THEN 3 WHEN 'low' THEN 2 ELSE 1 END")
_retained = (f"SELECT policy, path, line, rule, severity FROM local_findings JOIN "
             + values(_policy_rules, "p(policy, rule, prioritized, threshold, kernel)") + f""" USING (rule)
             WHERE CASE WHEN kernel THEN rule IN {in_list(V.KERNEL_RULES)}
                        ELSE prioritized OR {_rank} >= threshold END""")


_gates = " UNION ALL ".join(
    f"SELECT path, '{p.name}' AS policy, {str(p.is_kernel).lower()} AS kernel FROM code_files "
    f"WHERE {D.has('lower(content)', [w.lower() for w in p.suspicious_patterns])}" for p in POLICIES if p.language_planes)
_all_retained = f"""{_retained} UNION ALL SELECT policy, path, line, rule, severity FROM language_findings JOIN ({_gates}) USING (path)
    WHERE NOT kernel OR rule IN {in_list(V.KERNEL_RULES)}"""


def policy_findings(spark, sf_dir) -> DataFrame:
    """Findings of all policies, decided in one pass over the files: local ones by rule and threshold, others by gate."""
    files = code_files(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long"))
    viewed_files = files.withColumn("_views", viewed(F.col("lines"))).withColumn("outside", findings_of(language_hits()))
    gated = viewed_files.select("path", "language", "size", "content", "outside", selection.gates(
        F.col("content"), [p for p in POLICIES if p.language_planes]).alias("gates"))
    every = Policy(name="every", rules=tuple(r.name for r in V.FILE_RULES))
    reviewed = review_files(gated, every, ReviewOptions(rule_set="all"))
    outside = F.transform("outside", algebra.external_severity_struct)
    found = unnest(reviewed.select("path", "gates", F.concat("findings", outside).alias("found")), "found", "f", "path", "gates")
    file_rule_names = {r.name for r in V.FILE_RULES}
    policies = algebra.retained_by(
        POLICIES, lambda p: [r for r in evaluated_rules(p, "scan") if not (p.is_kernel and r in file_rule_names & set(file_rules.NOT_FOR_KERNEL))],
        F.col("f.rule"), F.col("f.severity"), F.col("f.origin"), F.col("gates"))
    return unnest(found.withColumn("policies", policies), "policies", "policy", "path", "f").select(
        "policy", "path", "f.line", "f.rule", "f.severity")


@register("retain_policies", compose(
    f"SELECT policy, path, coalesce(line, 0) AS line, rule, severity FROM ({_all_retained})", "local_findings", "language_findings"))
def retain_policies(spark, sf_dir):
    return policy_findings(spark, sf_dir).withColumn("line", F.coalesce("line", F.lit(0)))


_FIVE = ("info", "low", "medium", "high", "critical")
_norm = ("CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity "
         "WHEN severity IN ('warn', 'warning') THEN 'medium' ELSE 'info' END")
_counters = ", ".join(f"count(*) FILTER ({_norm} = '{s}') AS {s}" for s in _FIVE)


@register("policy_severity_breakdown", compose(
    f"""SELECT p.policy, {", ".join(f"coalesce({name}, 0) AS {name}" for name in _FIVE)}, coalesce(findings_total, 0) AS findings_total
    FROM {values([(p.name,) for p in POLICIES], "p(policy)")} LEFT JOIN
      (SELECT policy, {_counters}, count(*) AS findings_total FROM ({_all_retained}) GROUP BY policy) USING (policy)""",
    "local_findings", "language_findings"))
def policy_severity_breakdown(spark, sf_dir):
    """A row for every policy, those without findings too."""
    counted = algebra.severity_breakdown(policy_findings(spark, sf_dir), "policy")
    names = policy_table(spark).select("policy")
    return names.join(counted, "policy", "left").fillna(0, [*_FIVE, "findings_total"])


@register("severity_breakdown", compose(
    f"SELECT language, {_counters}, count(*) AS findings_total FROM local_findings "
    "JOIN (SELECT path, language FROM code_files) USING (path) GROUP BY language", "local_findings"))
def severity_breakdown(spark, sf_dir):
    return algebra.severity_breakdown(local_findings(spark, sf_dir), "language")


_plain_rank = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


@register("fail_gate", compose(" UNION ALL ".join(f"""
    SELECT language, max({_plain_rank}) >= 4 AS tripped, count(*) FILTER ({_plain_rank} >= 4) AS triggering,
      ['info', 'low', 'medium', 'high', 'critical'][max({_plain_rank})] AS worst_severity
    FROM {plane} JOIN (SELECT path, language FROM code_files) USING (path) GROUP BY language"""
    for plane in ("c_style_findings", "file_findings")), "c_style_findings", "file_findings"))
def fail_gate(spark, sf_dir):
    style = c_rules.style_findings(code_lines(spark, sf_dir).filter("language = 'c'"), "language")
    files = code_files(spark, sf_dir)
    hits = files.select("language", file_rules.file_rule_hits(F.col("content")).alias("hits"))
    whole = findings_from_hits(hits, "hits", "language")
    return algebra.fail_gate(style, "high", "language").unionByName(algebra.fail_gate(whole, "high", "language"))


SEVERITIES_SEEN = (" High ", "warning", "CRITICAL", "low", "note")


@register("sanitize", f"""
    SELECT path, nth, CASE WHEN strlen(rule) > 256 THEN substr(rule, 1, 256) ELSE rule END AS rule,
      CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity))
           ELSE 'info' END AS severity,
      sha256(CASE WHEN strlen(message) > 4096 THEN substr(message, 1, 2048) ELSE message END) AS message_hash, source, nth <= 500 AS kept
    FROM (SELECT 'f' || (event_id % 7) AS path, 'rule-' || repeat('x', event_id % 300) AS rule,
            ([{', '.join(map(q, SEVERITIES_SEEN))}])[event_id % 5 + 1] AS severity,
            'a' || repeat('é', event_id % 2500) AS message, 'worker' AS source,
            row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS nth FROM events)""")
def sanitize(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id")
    severity = F.get(F.array(*[F.lit(s) for s in SEVERITIES_SEEN]), (F.col("event_id") % 5).cast("int"))
    raw = events.select(
        "event_id", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("path"),
        F.concat(F.lit("rule-"), F.repeat(F.lit("x"), (F.col("event_id") % 300).cast("int"))).alias("rule"),
        severity.alias("severity"), F.lit(None).cast("string").alias("category"), F.lit(1).alias("line"),
        F.concat(F.lit("a"), F.repeat(F.lit("é"), (F.col("event_id") % 2500).cast("int"))).alias("message"))
    clean = algebra.sanitize_external(raw, "event_id", spread=True)
    return clean.select("path", F.col("nth").cast("long").alias("nth"), "rule", "severity",
                        F.sha2("message", 256).alias("message_hash"), "source", "kept")


@register("dedup_findings", compose(
    "SELECT path, line, rule, message, min(col) AS col, count(*) * CASE WHEN line % 2 = 0 THEN 2 ELSE 1 END AS planes FROM c_style_findings "
    "GROUP BY path, line, rule, message", "c_style_findings"))
def dedup_findings(spark, sf_dir):
    """Findings of two planes, of which the second has looked at even lines only, merged and reduced to one of each."""
    lines = code_lines(spark, sf_dir).filter("language = 'c'")
    found, again = (c_rules.style_findings(seen, "path") for seen in (lines, lines.filter("line % 2 = 0")))
    once = algebra.dedup(algebra.merge(found, again), "path", copies="planes")
    return once.select("path", "line", "rule", "message", F.col("column").alias("col"), "planes")


PACK = RulePack("house", [
    UserRule("no-tabs", "low", "style", "Tab in source line", lambda v: F.contains(v["raw"], F.lit("\t"))),
    UserRule("no-shell", "high", "security", "Shell started from code",
             lambda v: F.contains(v["lower"], F.lit("exec")) | F.contains(v["lower"], F.lit("system(")),
             ("javascript", "typescript", "php", "ruby")),
])


@register("rule_pack", compose("""
    SELECT path, line, 'no-tabs' AS rule, 'low' AS severity, 'Tab in source line' AS message FROM code_lines
    WHERE contains(text, chr(9))
    UNION ALL
    SELECT path, line, 'no-shell', 'high', 'Shell started from code' FROM code_lines
    WHERE language IN ('javascript', 'typescript', 'php', 'ruby')
      AND (contains(lower(text), 'exec') OR contains(lower(text), 'system('))""", "code_lines"))
def rule_pack(spark, sf_dir):
    return PACK.findings(code_lines(spark, sf_dir), "path").select("path", "line", "rule", "severity", "message")


# Rules kept as rows: one of version 1 is withdrawn in version 2, which brings a new one and changes another.
RULE_ROWS = [
    ("no-tabs", 1, False, "low", "style", "Tab in source line", None, "raw", ["\t"], None, None),
    ("no-shell", 1, False, "high", "security", "Shell started from code", ["javascript", "typescript", "php", "ruby"], "lower",
     ["exec", "system("], None, None),
    ("no-tabs", 2, True, "low", "style", "Tab in source line", None, "raw", ["\t"], None, None),
    ("weak-hash", 2, False, "medium", "security", "Weak hash", None, "lower", ["md5", "sha1"], ["(", " "], ["md5sum"]),
    ("no-shell", 2, False, "high", "security", "Shell started from code", ["javascript", "php"], "lower", ["exec", "system("], None, ["uid"]),
]
_shell = "contains(lower(text), 'exec') OR contains(lower(text), 'system(')"


@register("rule_table", compose(f"""
    SELECT 1 AS version, path, line, 'no-tabs' AS rule, 'low' AS severity, 'Tab in source line' AS message FROM code_lines
    WHERE contains(text, chr(9))
    UNION ALL
    SELECT 1, path, line, 'no-shell', 'high', 'Shell started from code' FROM code_lines
    WHERE language IN ('javascript', 'typescript', 'php', 'ruby') AND ({_shell})
    UNION ALL
    SELECT 2, path, line, 'no-shell', 'high', 'Shell started from code' FROM code_lines
    WHERE language IN ('javascript', 'php') AND ({_shell}) AND NOT contains(lower(text), 'uid')
    UNION ALL
    SELECT 2, path, line, 'weak-hash', 'medium', 'Weak hash' FROM code_lines
    WHERE regexp_matches(lower(text), 'md5|sha1') AND regexp_matches(text, '[( ]') AND NOT contains(lower(text), 'md5sum')""", "code_lines"))
def rule_table(spark, sf_dir):
    """Findings of the rules in force at two versions of a rule table."""
    rules = spark.createDataFrame(RULE_ROWS, RULE_SCHEMA)
    found = [TableRules.read(rules, "house", version).findings(code_lines(spark, sf_dir), "path").select(
        F.lit(version).alias("version"), "path", "line", "rule", "severity", "message") for version in (1, 2)]
    return found[0].unionByName(found[1])


def _long_names(path: str, content: str):
    """An outside analyzer: names of more than fourteen letters; it fails on files that hold ``eval(expr)``."""
    import re

    if "eval(expr)" in content:
        raise ValueError("cannot analyze")
    for n, text in enumerate(content.split("\n"), 1):
        for name in re.findall("[A-Za-z]{15,}", text):
            yield "long-name", "Warning" if n % 2 else "low", "style", f"{name} has {len(name)} letters", n


_seen = f"""(SELECT path, content FROM code_files WHERE language IN ('javascript', 'java')
    AND {D.has("lower(content)", [w.lower() for w in BY_NAME["security"].suspicious_patterns])})"""


@register("analyzer_review", compose(f"""
    SELECT path, line, CASE WHEN line % 2 = 1 THEN 'info' ELSE 'low' END AS severity, 'long-name' AS rule,
           name || ' has ' || length(name) || ' letters' AS message, 'finding' AS kind
    FROM (SELECT path, line, unnest(regexp_extract_all(text, '[A-Za-z]{{15,}}')) AS name FROM code_lines
          WHERE path IN (SELECT path FROM {_seen} WHERE NOT contains(content, 'eval(expr)')))
    UNION ALL
    SELECT path, NULL, 'warning', 'runtime', 'analyzer names ' || path || ': ValueError: cannot analyze', 'diagnostic' FROM {_seen}
    WHERE contains(content, 'eval(expr)')""", "code_files"))
def analyzer_review(spark, sf_dir):
    """Findings of an analyzer inside a review of binary files, and its failures as diagnostics."""
    analyzers = tuple(Analyzer("names", language, _long_names) for language in ("javascript", "java"))
    result = review(binary_code_files(spark, sf_dir), policy_named("security"), ReviewOptions(rule_set="scan", analyzers=analyzers))
    found = result.findings.filter("origin = 'external'").select(
        "path", "line", "severity", "rule", "message", F.lit("finding").alias("kind"))
    said = report.trouble_diagnostics(result.troubles)
    return found.unionByName(said.select("path", F.lit(None).cast("int").alias("line"), F.col("level").alias("severity"),
                                         F.col("code").alias("rule"), "message", F.lit("diagnostic").alias("kind")))


# --- reviews, entries, report -------------------------------------------------------------
WHOLE = ReviewOptions(rule_set="all")


def review_entries(spark, sf_dir, policy: str, *languages: str, options: ReviewOptions = WHOLE) -> DataFrame:
    files = code_files(spark, sf_dir, *languages)
    sized = files.select("path", "language", "content", F.octet_length("content").cast("long").alias("size"))
    return review_files(sized, policy_named(policy), options)


_local_order = values(
    [(r.name, 0, n) for n, r in enumerate(V.FILE_RULES) if r.name in BY_NAME["quick"].rules]
    + [(r.name, 1, n) for n, r in enumerate(V.LINE_RULES)], "o(rule, plane, nth)")
_ordered = (f"SELECT path, line, severity, rule, message, o.plane AS plane, row_number() OVER (PARTITION BY path "
            f"ORDER BY {_rank} DESC, o.plane, o.nth, coalesce(line, 0)) AS place "
            f"FROM local_findings JOIN {_local_order} USING (rule)")


@register("file_entries", compose(f"""
    SELECT f.path, CAST(strlen(f.content) AS BIGINT) AS size, count(e.rule) AS findings,
      coalesce(string_agg(e.severity || ' ' || e.rule || ' ' || coalesce(CAST(e.line AS VARCHAR), '-'), '; ' ORDER BY e.place), '')
        AS listing
    FROM code_files f LEFT JOIN ({_ordered}) e USING (path) GROUP BY f.path, f.content""", "local_findings"))
def file_entries(spark, sf_dir):
    entries = review_entries(spark, sf_dir, "quick")
    listing = F.array_join(F.transform("findings", lambda f: F.concat_ws(
        " ", f["severity"], f["rule"], F.coalesce(f["line"].cast("string"), F.lit("-")))), "; ")
    return entries.select("path", "size", F.size("findings").cast("long").alias("findings"), listing.alias("listing"))


@register("attach_findings", compose("""
    SELECT f.path, CAST(strlen(f.content) AS BIGINT) AS size, count(e.rule) AS findings,
      coalesce(min(e.line), 0) AS first_line
    FROM code_files f LEFT JOIN c_call_findings e USING (path) GROUP BY f.path, f.content""",
    "code_files", "c_call_findings"))
def attach_findings(spark, sf_dir):
    files = code_files(spark, sf_dir)
    hits = files.filter("language = 'c'").select(
        "path", c_rules.call_hits(c_rules.numbered(F.col("lines"))).alias("hits"))
    sized = files.select("path", F.octet_length("content").cast("long").alias("size"))
    joined = algebra.attach(sized, findings_from_hits(hits, "hits", "path"), "path")
    lines = F.transform("findings", lambda f: f["line"])
    return joined.select("path", "size", F.size("findings").cast("long").alias("findings"),
                         F.coalesce(F.array_min(lines), F.lit(0)).alias("first_line"))


@register("fast_review", compose("""
    SELECT path, rule, severity, message FROM file_findings WHERE rule IN ('todo-comment', 'unsafe-usage')""",
    "file_findings"))
def fast_review(spark, sf_dir):
    entries = review_entries(spark, sf_dir, "quick", options=ReviewOptions(rule_set="scan", fast=True))
    return unnest_findings(entries, "findings", "path").select("path", "rule", "severity", "message")


_kernel_words = [w.lower() for w in BY_NAME["kernel-c"].suspicious_patterns]


@register("kernel_review", compose(f"""
    SELECT path, line, col, rule, CASE WHEN severity IN ('high', 'medium', 'low', 'critical', 'info') THEN severity
      ELSE 'info' END AS severity, category, message
    FROM ({" UNION ALL ".join(f"SELECT {D.FINDING} FROM {c}" for c in D.C_FINDINGS)})
    JOIN (SELECT path FROM code_files WHERE {D.has("lower(content)", _kernel_words)}) USING (path)
    WHERE rule IN {in_list(V.KERNEL_RULES)}""", "code_files", *D.C_FINDINGS))
def kernel_review(spark, sf_dir):
    entries = review_entries(spark, sf_dir, "kernel-c", "c")
    return unnest_findings(entries, "findings", "path").selectExpr(*C_AT)


_security_words = [w.lower() for w in BY_NAME["security"].suspicious_patterns]
_security = f"""
    SELECT {D.FINDING}, origin FROM local_findings
    WHERE origin = 'registry' OR rule IN {in_list(BY_NAME["security"].rules)}
    UNION ALL
    SELECT {D.FINDING}, origin FROM language_findings
    WHERE path IN (SELECT path FROM code_files WHERE {D.has("lower(content)", _security_words)})"""


@register("security_review", compose(
    f"SELECT path, coalesce(line, 0) AS line, rule, severity, message, origin FROM ({_security})",
    "local_findings", "language_findings"))
def security_review(spark, sf_dir):
    found = unnest_findings(review_entries(spark, sf_dir, "security"), "findings", "path")
    return found.select("path", F.coalesce("line", F.lit(0)).alias("line"), "rule", "severity", "message", "origin")


@register("report", compose(f"""
    SELECT '2' AS schema_version, 'security' AS profile, d.n AS files_discovered, d.n AS files_scanned,
      d.n AS files_selected, 0 AS files_skipped, d.bytes AS total_bytes, 0 AS skipped_large_files,
      false AS truncated, s.* , 'Scanned ' || d.n || ' files (' || d.n || ' scanned), ' || s.findings_total
      || ' findings' AS summary
    FROM (SELECT count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM code_files) d,
      (SELECT {_counters}, count(*) AS findings_total FROM ({_security})) s""", "local_findings", "language_findings"))
def report_query(spark, sf_dir):
    result = review(binary_code_files(spark, sf_dir), policy_named("security"), ReviewOptions(rule_set="all"))
    row = report.report_row(result, root="src")
    return row.select(
        "schema_version", F.col("metadata.profile").alias("profile"), "files_discovered", "files_scanned",
        "files_selected", "files_skipped", "total_bytes", "skipped_large_files", "truncated",
        "severity_breakdown.*", F.col("stats.findings_total").alias("findings_total"), "summary")


LIMITED = BY_NAME["security"].with_limits(max_file_size_bytes=900)
_placed = """SELECT *, strlen(content) + CASE WHEN nth % 11 = 3 THEN 1 ELSE 0 END AS size FROM (
    SELECT *, CAST(regexp_extract(path, '/f([0-9]+)', 1) AS BIGINT) AS nth FROM code_files)"""


@register("file_counters", compose(f"""
    SELECT count(*) AS files_discovered, count(*) FILTER (size <= 900) AS files_scanned,
      count(*) FILTER (size <= 900 AND nth % 11 <> 3) AS files_reviewed, 0 AS files_selected,
      count(*) FILTER (size > 900 OR nth % 11 = 3) AS files_skipped, CAST(sum(size) FILTER (size <= 900) AS BIGINT) AS total_bytes,
      count(*) FILTER (size > 900) AS skipped_large_files, count(*) FILTER (size <= 900 AND nth % 11 = 3) AS unreadable
    FROM ({_placed}) WHERE nth % 5 <> 0 AND nth % 7 <> 0""", "code_files"))
def file_counters(spark, sf_dir):
    """Counters of a summary-only report over excluded, hidden, large and unreadable files."""
    nth = F.col("file_id")
    placed = code_files(spark, sf_dir).select(
        F.concat(F.when(nth % 5 == 0, "node_modules/").when(nth % 7 == 0, ".cache/").otherwise(""), "path").alias("path"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.concat(F.encode("content", "UTF-8"), F.when(nth % 11 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))).alias("content"))
    result = review(placed.withColumn("size", F.octet_length("content").cast("long")), LIMITED,
                    ReviewOptions(rule_set="scan", size_limit=True))
    row = report.report_row(result, summary_only=True)
    notes = report.unreadable_diagnostics(result.unreadable).agg(F.count("*").alias("unreadable"))
    return row.crossJoin(notes).select(
        "files_discovered", "files_scanned", F.col("stats.files_selected").alias("files_reviewed"), "files_selected",
        "files_skipped", "total_bytes", "skipped_large_files", "unreadable")


_turns = "(SELECT conv_id || '/' || turn AS key, text FROM conversations)"


@register("conversation_style", "SELECT path AS turn_key, line, col, rule, severity, message FROM ("
          + D.worded(D.style_rows("turn_lines", "key", rules=DOC_STYLE), V.C_STYLE_RULES, "detail").replace(
              "FROM turn_lines", f"FROM ({D.lines_of(_turns, 'key', 'text')})") + ")")
def conversation_style(spark, sf_dir):
    """Style rules on every line of the conversations."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("turn_key"), "text")
    found = c_rules.style_findings(explode_lines(turns, "turn_key", content="text"), "turn_key", rules=DOC_STYLE)
    return found.select("turn_key", "line", F.col("column").alias("col"), "rule", "severity", "message")


@register("json_report", compose(f"""
    SELECT f.path, CAST(strlen(f.content) AS VARCHAR) AS size, coalesce(e.rule, 'none') AS first_rule,
      coalesce(CAST(e.line AS VARCHAR), 'none') AS first_line, coalesce(e.message, 'none') AS first_message
    FROM code_files f LEFT JOIN (SELECT * FROM ({_ordered}) WHERE place = 1) e USING (path)""", "local_findings"))
def json_report(spark, sf_dir):
    documents = report.json_entries(review_entries(spark, sf_dir, "quick"))
    none = F.lit("none")
    return documents.select(
        "path", F.get_json_object("json", "$.size").alias("size"),
        F.coalesce(F.get_json_object("json", "$.findings[0].rule"), none).alias("first_rule"),
        F.coalesce(F.get_json_object("json", "$.findings[0].line"), none).alias("first_line"),
        F.coalesce(F.get_json_object("json", "$.findings[0].message"), none).alias("first_message"))


@register("written_report", compose(f"""
    SELECT 'file' AS part, f.path, CAST(strlen(f.content) AS BIGINT) AS size, coalesce(string_agg(
        e.severity || ' ' || e.rule || ' ' || e.message || ' ' || coalesce(CAST(e.line AS VARCHAR), '-'), '; ' ORDER BY e.place), '') AS listing
    FROM code_files f LEFT JOIN ({_ordered}) e USING (path) GROUP BY f.path, f.content
    UNION ALL
    SELECT 'report', NULL, (SELECT CAST(sum(strlen(content)) AS BIGINT) FROM code_files),
           'Scanned ' || (SELECT count(*) FROM code_files) || ' files (' || (SELECT count(*) FROM code_files) || ' scanned), '
           || (SELECT count(*) FROM ({_ordered})) || ' findings'""", "local_findings"))
def written_report(spark, sf_dir):
    """A report as written to its sink, from one review, read back: every finding of every file, and the report row."""
    target = scratch_dir(spark, "report")
    report.write_json(review(binary_code_files(spark, sf_dir), policy_named("quick"), WHOLE), target)
    fields = "path string, size bigint, findings array<struct<severity:string,rule:string,message:string,line:int>>"
    shown = F.transform("findings", lambda f: F.concat_ws(" ", f["severity"], f["rule"], f["message"],
                                                          F.coalesce(f["line"].cast("string"), F.lit("-"))))
    documents = spark.read.schema(fields).json(f"{target}/files").select(
        F.lit("file").alias("part"), "path", "size", F.array_join(shown, "; ").alias("listing"))
    row = spark.read.json(f"{target}/report").select(
        F.lit("report").alias("part"), F.lit(None).cast("string").alias("path"), F.col("total_bytes").alias("size"), F.col("summary").alias("listing"))
    return documents.unionByName(row)


@register("markdown_sections", compose(f"""
    SELECT path, '### `' || path || '`' || chr(10) || string_agg('- **' || severity || '** [' ||
      CASE plane WHEN 0 THEN 'local-rules' ELSE 'rule-registry' END || ' / ' || rule ||
      coalesce(' line ' || line, '') || '] ' || message, chr(10) ORDER BY place) || chr(10) AS markdown
    FROM ({_ordered}) GROUP BY path""", "local_findings"))
def markdown_sections(spark, sf_dir):
    return report.markdown_entries(review_entries(spark, sf_dir, "quick"))


# --- fixes --------------------------------------------------------------------------------
_fix_rules = ("commented-out-code", "debug-print", "wildcard-import")
_fixes = f"""
    SELECT path, line, text, CASE {" ".join(
        f"WHEN {' OR '.join(D.trigger(t, D.VIEWS) for t in V.LINE_TRIGGERS if t.rule == r)} THEN '{r}'"
        for r in _fix_rules)} END AS rule FROM code_lines"""


@register("fix_apply", compose(f"""
    SELECT path, count(rule) AS fixes, string_agg(CASE WHEN rule IS NULL THEN text
        WHEN rule = 'wildcard-import' THEN '// REVIEW: replace wildcard import with explicit imports (line ' || line || ')'
        END, chr(10) ORDER BY line) AS fixed
    FROM ({_fixes}) GROUP BY path HAVING count(rule) > 0""", "code_lines"))
def fix_apply(spark, sf_dir):
    files = code_files(spark, sf_dir).select("path", "language", "content")
    return fixes.fix_files(files).select("path", F.size("fixes").cast("long").alias("fixes"), "fixed")


@register("fix_summary", compose(f"""
    SELECT path, count(rule) AS fixes, true AS dry_run,
      'todo-comment, debug-print, commented-out-code, wildcard-import' AS fixable_rules
    FROM ({_fixes}) GROUP BY path HAVING count(rule) > 0""", "code_lines"))
def fix_summary(spark, sf_dir):
    files = code_files(spark, sf_dir).select("path", "language", "content")
    return fixes.fix_summary(fixes.fix_files(files))


@register("fix_versions", f"""
    SELECT path, sha256(coalesce(fixed, content)) AS content_hash, fixed IS NOT NULL AS changed FROM (
      {compose("SELECT path, content FROM code_files", "code_files")}) LEFT JOIN ({ORACLES["fix_apply"]}) USING (path)""")
def fix_versions(spark, sf_dir):
    """A corpus and a version of it with all safe fixes, read back; only files that the fixes change are written."""
    folder = scratch_dir(spark, "corpus")
    code_files(spark, sf_dir).select("path", "language", "content").write.parquet(f"{folder}/base")
    corpus = CorpusVersions(spark, f"{folder}/versions", f"{folder}/base")
    corpus.fix()
    before = corpus.read(0).select("path", F.sha2("content", 256).alias("was"))
    return corpus.read().join(before, "path").select(
        "path", F.sha2("content", 256).alias("content_hash"), (F.sha2("content", 256) != F.col("was")).alias("changed"))


# --- incremental rescans --------------------------------------------------------------------
VERSION = incremental.ruleset_version("quick")


def fingerprinted(spark, sf_dir) -> DataFrame:
    return incremental.with_fingerprint(document_files(spark, sf_dir))


def prior_store(files: DataFrame) -> DataFrame:
    """What an earlier scan left: the even documents, some under an older text or version,
    and one entry per even document whose file is gone."""
    doc = F.substring_index("path", "/", -1).cast("long")
    even = files.filter(doc % 2 == 0)
    stale = F.when(doc % 10 == 4, F.sha2(F.lit("older"), 256)).otherwise(F.col("content_hash"))
    version = F.when(doc % 10 == 6, F.lit("1:quick:all")).otherwise(F.lit(VERSION))
    empty = F.array().cast("array<struct<rule:string>>")
    store = even.select("path", "size", "modified", stale.alias("content_hash"), version.alias("ruleset_version"),
                        empty.alias("findings"), F.lit(None).cast("string").alias("content_preview"))
    gone = store.withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    return store.unionByName(gone)


_hash = "sha256(text)"
_hit = "doc_id % 2 = 0 AND doc_id % 10 NOT IN (4, 6)"


@register("incremental_hits", f"""
    SELECT {DOC_PATH} AS path, {_hash} AS content_hash, CASE WHEN {_hit} THEN 'hit' ELSE 'miss' END AS status
    FROM documents""")
def incremental_hits(spark, sf_dir):
    files = fingerprinted(spark, sf_dir)
    store = prior_store(files)
    found = incremental.hits(files, store, VERSION).select("path", "content_hash", F.lit("hit").alias("status"))
    missed = incremental.misses(files, store, VERSION)
    return found.unionByName(missed.select("path", "content_hash", F.lit("miss").alias("status")))


@register("incremental_store", f"""
    SELECT {DOC_PATH} AS path, {_hash} AS content_hash, '{VERSION}' AS ruleset_version FROM documents
    UNION ALL
    SELECT 'gone/' || {DOC_PATH}, CASE WHEN doc_id % 10 = 4 THEN sha256('older') ELSE {_hash} END, '{VERSION}'
    FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 6""")
def incremental_store(spark, sf_dir):
    files = fingerprinted(spark, sf_dir)
    store = prior_store(files)
    empty = F.array().cast("array<struct<rule:string>>")
    analysed = incremental.misses(files, store, VERSION).select(
        *incremental.KEY_COLUMNS, empty.alias("findings"), F.lit(None).cast("string").alias("content_preview"))
    fresh = incremental.entries_to_store(analysed, VERSION)
    return incremental.upsert(store, fresh, VERSION).select("path", "content_hash", "ruleset_version")


def edited(files: DataFrame) -> DataFrame:
    """The corpus as a later scan finds it: every third document has another end, of the same length."""
    doc = F.substring_index("path", "/", -1).cast("long")
    ended = F.concat(F.substring("content", F.lit(1), F.greatest(F.char_length("content") - 6, F.lit(0))), F.lit("secret"))
    return files.withColumn("content", F.when((doc % 3 == 0) & (F.octet_length("content") == F.octet_length(ended)), ended)
                            .otherwise(F.col("content")))


_rewritten = """(SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND strlen(text) = strlen(ended) THEN ended ELSE text END AS text FROM (
    SELECT doc_id, text, substr(text, 1, greatest(length(text) - 6, 0)) || 'secret' AS ended FROM documents))"""


@register("incremental_rescan", f"""
    SELECT {DOC_PATH} AS path, {_hash} AS content_hash, coalesce(rules, '') AS rules FROM {_rewritten} d LEFT JOIN (
      SELECT path AS doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
        {D.worded(D.file_rule_rows(_rewritten, "doc_id", "text"), V.FILE_RULES)})
      WHERE rule IN {in_list(BY_NAME["quick"].rules)} GROUP BY path) f USING (doc_id)""")
def incremental_rescan(spark, sf_dir):
    """A first scan, edits near the ends of texts, and a rescan that reviews the edited texts only; equal to a full scan."""
    policy, options = policy_named("quick"), ReviewOptions(rule_set="scan")
    files = document_files(spark, sf_dir)
    nothing = files.sparkSession.createDataFrame([], incremental.store_schema())
    store = stored(incremental.rescan(files, nothing, policy, options), "review-store")
    now = incremental.rescan(edited(files), store, policy, options)
    return now.select("path", "content_hash", F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule"])), ",").alias("rules"))


# --- review queue -----------------------------------------------------------------------------
QUEUED = replace(BY_NAME["security"], review=ReviewBudget(True, 80))


@register("review_queue", f"""
    SELECT {DOC_PATH} AS path, 'security' AS policy, row_number() OVER (ORDER BY doc_id) AS place,
      row_number() OVER (ORDER BY doc_id) <= {QUEUED.review.max_files} AS within_budget,
      sha256(CASE WHEN strlen(text) > 12000 THEN substr(text, 1, 12000) ELSE text END) AS content_hash
    FROM documents WHERE {D.has("lower(text)", _security_words)}""")
def review_queue(spark, sf_dir):
    files = document_files(spark, sf_dir)
    gated = files.withColumn("suspicious", selection.is_suspicious(F.col("content"), QUEUED.suspicious_patterns))
    return queue.review_queue(gated, QUEUED).select(
        "path", "policy", F.col("place").cast("long").alias("place"), "within_budget", F.sha2("content", 256).alias("content_hash"))


_response = r"""CASE WHEN doc_id % 7 = 0 THEN '{"choices": [{"message": {"content": "  "}}]}'
  WHEN doc_id % 5 = 0 THEN '{"choices": [{"message": {"content": "sorry {not json"}}]}'
  WHEN doc_id % 3 = 0 THEN '{"choices": [{"message": {"content": "Here: {@findings@: [{@rule@: 7, @line@: -4}, '
    || '{@severity@: @low@, @message@: @m' || doc_id || '@, @category@: @style@, @line@: 2.5}]}"}}]}'
  ELSE '{"choices": [{"message": {"content": "{@findings@: [{@severity@: @high@, @rule@: @r' || (doc_id % 11)
    || '@, @line@: ' || doc_id || '}]}"}}]}' END"""


def _bodies(quote: str) -> str:
    return _response.replace("@", quote)


_decoded = f"""SELECT doc_id, content[greatest(strpos(content, '{{'), 1):] AS content FROM (
    SELECT doc_id, trim(json_extract_string(body, '$.choices[0].message.content')) AS content
    FROM (SELECT doc_id, {_bodies(chr(92) + '"')} AS body FROM documents)) WHERE content <> ''"""


def _json_text(name: str) -> str:
    return f"CASE WHEN json_type(item, '$.{name}') = 'VARCHAR' THEN json_extract_string(item, '$.{name}') END"


@register("review_decode", f"""
    SELECT {DOC_PATH} AS path, coalesce({_json_text("severity")}, 'info') AS severity,
      coalesce({_json_text("rule")}, 'ai-review') AS rule,
      coalesce({_json_text("message")}, 'No review message') AS message,
      coalesce({_json_text("category")}, 'none') AS category,
      coalesce(CASE WHEN json_type(item, '$.line') = 'UBIGINT' THEN CAST(json_extract(item, '$.line') AS BIGINT) END, -1)
        AS line, 'ollama:' || {DOC_PATH} AS source
    FROM (SELECT doc_id, unnest(CAST(json_extract(content, '$.findings') AS JSON[])) AS item
          FROM (SELECT * FROM ({_decoded}) WHERE json_valid(content)))""")
def review_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    responses = docs.select(F.format_string("doc/%012d", "doc_id").alias("path"),
                            F.expr(_bodies(chr(92) * 2 + '"')).alias("body"))
    found = queue.decode_responses(responses, "path")
    return found.select("path", "severity", "rule", "message", F.coalesce("category", F.lit("none")).alias("category"),
                        F.coalesce("line", F.lit(-1)).alias("line"), "source")


@register("review_diagnostics", f"""
    SELECT 'warning' AS level, 'scan' AS source, 'runtime' AS code,
      'ai provider security: decode provider findings payload' AS message, {DOC_PATH} AS path
    FROM ({_decoded}) WHERE NOT json_valid(content)""")
def review_diagnostics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    responses = docs.select(F.format_string("doc/%012d", "doc_id").alias("path"),
                            F.expr(_bodies(chr(92) * 2 + '"')).alias("body"))
    return queue.decode_diagnostics(responses, "security")


OUTCOME_BUDGET = 6
_outcomes = f"""(
    SELECT path, place, outcome, CAST(coalesce(sum(CASE WHEN outcome = 'failed' THEN 0 ELSE 1 END)
             OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before
    FROM (SELECT {DOC_PATH} AS path, row_number() OVER (ORDER BY doc_id) AS place,
                 CASE WHEN doc_id % 4 = 3 THEN 'pending' WHEN json_valid(content) OR content IS NULL THEN 'done' ELSE 'failed' END AS outcome
          FROM (SELECT doc_id, text FROM documents) LEFT JOIN ({_decoded}) USING (doc_id)
          WHERE {D.has("lower(text)", _security_words)}))"""


def outcome_queue(spark, sf_dir):
    """Suspicious documents in order, with stored answers for three in four of them, and what became of each."""
    files = document_files(spark, sf_dir)
    gated = files.select("path", "size", "content", selection.is_suspicious(F.col("content"), QUEUED.suspicious_patterns).alias("suspicious"))
    asked = table(spark, sf_dir, "documents", "doc_id").filter("doc_id % 4 <> 3")
    responses = asked.select(F.format_string("doc/%012d", "doc_id").alias("path"), F.expr(_bodies(chr(92) * 2 + '"')).alias("body"))
    return queue.by_outcome(gated.filter("suspicious"), responses, OUTCOME_BUDGET), responses


@register("review_outcomes", f"""
    SELECT path, place, outcome, used_before, used_before < {OUTCOME_BUDGET} AS attempted FROM {_outcomes}""")
def review_outcomes(spark, sf_dir):
    return outcome_queue(spark, sf_dir)[0].withColumn("place", F.col("place").cast("long"))


_accepted = f"(SELECT path FROM {_outcomes} WHERE used_before < {OUTCOME_BUDGET})"


@register("review_merged", f"""
    SELECT 'finding' AS kind, path, severity, rule, message FROM (
      SELECT {DOC_PATH} AS path, coalesce({_json_text("severity")}, 'info') AS raw_severity, coalesce({_json_text("rule")}, 'ai-review') AS rule,
             coalesce({_json_text("message")}, 'No review message') AS message,
             CASE WHEN lower(trim(raw_severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(raw_severity)) ELSE 'info' END AS severity
      FROM (SELECT doc_id, unnest(CAST(json_extract(content, '$.findings') AS JSON[])) AS item
            FROM (SELECT * FROM ({_decoded}) WHERE json_valid(content) AND doc_id % 4 <> 3)))
    WHERE path IN {_accepted}
    UNION ALL
    SELECT 'diagnostic', {DOC_PATH}, 'warning', 'runtime', 'ai provider security: decode provider findings payload'
    FROM ({_decoded}) WHERE NOT json_valid(content) AND doc_id % 4 <> 3 AND {DOC_PATH} IN {_accepted}
    UNION ALL
    SELECT 'high', NULL, NULL, NULL, CAST(count(*) AS VARCHAR) FROM (
      SELECT path, {_json_text("severity")} AS severity FROM (
        SELECT {DOC_PATH} AS path, unnest(CAST(json_extract(content, '$.findings') AS JSON[])) AS item
        FROM (SELECT * FROM ({_decoded}) WHERE json_valid(content) AND doc_id % 4 <> 3)))
    WHERE path IN {_accepted} AND severity = 'high'""")
def review_merged(spark, sf_dir):
    """Stored answers as findings of the entries, as diagnostics, and in the report's counters (the review's own findings left out)."""
    outcomes, responses = outcome_queue(spark, sf_dir)
    outcomes = stored(outcomes, "review-outcomes")
    found, said = queue.review_findings(queue.accepted_responses(outcomes, responses), QUEUED)
    result = review(document_files(spark, sf_dir).withColumn("content", F.encode("content", "UTF-8")), replace(QUEUED, rules=(), language_planes=False),
                    ReviewOptions(rule_set="scan"))
    entries = stored(add_findings(result.entries, found), "reviewed-entries")
    none = F.lit(None).cast("string")
    return (unnest_findings(entries, "findings", "path").select(F.lit("finding").alias("kind"), "path", "severity", "rule", "message")
            .unionByName(said.select(F.lit("diagnostic").alias("kind"), "path", F.col("level").alias("severity"), F.col("code").alias("rule"), "message"))
            .unionByName(report.entry_totals(entries).select(F.lit("high").alias("kind"), none.alias("path"), none.alias("severity"), none.alias("rule"),
                                                             F.col("high").cast("string").alias("message"))))


# --- streaming ----------------------------------------------------------------------------------
_streamed = f"""(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN d.text ELSE r.text END AS text
    FROM documents d JOIN {_rewritten} r USING (doc_id))"""


@register("stream_reviews", f"""
    SELECT {DOC_PATH} AS path, {_hash} AS content_hash, coalesce(rules, '') AS rules FROM {_streamed} d LEFT JOIN (
      SELECT path AS doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
        {D.worded(D.file_rule_rows(_streamed, "doc_id", "text"), V.FILE_RULES)})
      WHERE rule IN {in_list(evaluated_rules(BY_NAME["maintainability"]))} GROUP BY path) f USING (doc_id)""")
def stream_reviews(spark, sf_dir):
    """Documents arrive in three batches: all of them, edited ones, and every fifth as it was at first."""
    target = scratch_dir(spark, "stream-reviews")
    files = document_files(spark, sf_dir).select("path", "size", "modified", "content")
    doc = F.substring_index("path", "/", -1).cast("long")
    for arrival in (files, edited(files).filter(doc % 3 == 0), files.filter(doc % 5 == 0)):
        arrival.write.mode("append").parquet(f"{target}/in")
        start_reviews(spark, f"{target}/in", target, f"{target}/checkpoint", policy_named("maintainability"),
                      ReviewOptions(rule_set="scan")).awaitTermination()
    return current_entries(spark, target).select("path", "content_hash", F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule"])), ",").alias("rules"))


ARRIVALS = 20
_arrived = f"(SELECT doc_id, CASE WHEN d.doc_id % {ARRIVALS} < 10 THEN r.text ELSE d.text END AS text FROM documents d JOIN {_rewritten} r USING (doc_id))"


@register("stream_compaction", f"""
    SELECT {DOC_PATH} AS path, {_hash} AS content_hash, coalesce(rules, '') AS rules FROM {_arrived} d LEFT JOIN (
      SELECT path AS doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
        {D.worded(D.file_rule_rows(_arrived, "doc_id", "text"), V.FILE_RULES)})
      WHERE rule IN {in_list(BY_NAME["quick"].rules)} GROUP BY path) f USING (doc_id)""")
def stream_compaction(spark, sf_dir):
    """Documents arrive in twenty parts, the first ten edited once more with the last ten; one batch a part, compacted on the way.

    A part is as many files as its tasks write. The table is dealt out into parts in one pass.
    """
    target = scratch_dir(spark, "stream-compaction")
    files = document_files(spark, sf_dir).select("path", "size", "modified", "content")
    slot = F.substring_index("path", "/", -1).cast("long") % ARRIVALS
    files.withColumn("slot", slot).write.partitionBy("slot").parquet(f"{target}/dealt")
    dealt = spark.read.schema(f"{FILES_SCHEMA}, slot bigint").parquet(f"{target}/dealt")
    for n in range(ARRIVALS):
        arrival = dealt.filter(F.col("slot") == n).drop("slot")
        if n >= 10:
            arrival = arrival.unionByName(edited(dealt.filter(F.col("slot") == n - 10).drop("slot")))
        arrival.write.mode("append").parquet(f"{target}/in")
        start_reviews(spark, f"{target}/in", target, f"{target}/checkpoint", policy_named("quick"),
                      ReviewOptions(rule_set="scan")).awaitTermination()
    return current_entries(spark, target).select(
        "path", "content_hash", F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule"])), ",").alias("rules"))


_touched = "(doc_id % 100 = 3)"


@register("rescan_store", f"""
    SELECT {DOC_PATH} AS path, CASE WHEN {_touched} THEN {DOC_TIME} + INTERVAL 1 DAY ELSE {DOC_TIME} END AS modified,
           {_hash} AS content_hash, coalesce(rules, '') AS rules FROM documents LEFT JOIN (
      SELECT path AS doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM (
        {D.worded(D.file_rule_rows(f"(SELECT doc_id, CASE WHEN {_touched} THEN text || ' secret' ELSE text END AS text FROM documents)", "doc_id", "text"), V.FILE_RULES)})
      WHERE rule IN {in_list(BY_NAME["quick"].rules)} GROUP BY path) f USING (doc_id)""".replace(
    f"{_hash} AS content_hash", f"sha256(CASE WHEN {_touched} THEN text || ' secret' ELSE text END) AS content_hash"))
def rescan_store(spark, sf_dir):
    """A first scan into a store, edits of one document in a hundred, and a rescan that goes by sizes and times."""
    policy, options = policy_named("quick"), ReviewOptions(rule_set="scan")
    files = document_files(spark, sf_dir).select("path", "size", "modified", "content")
    touched = F.substring_index("path", "/", -1).cast("long") % 100 == 3
    content = F.when(touched, F.concat("content", F.lit(" secret"))).otherwise(F.col("content"))
    now = files.withColumns({
        "content": content, "size": F.octet_length(content).cast("long"),
        "modified": F.when(touched, F.col("modified") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified"))})
    store = ReviewStore(spark, scratch_dir(spark, "rescan-store"))
    for scan in (files, now):
        rescan(scan, store, policy, options)
    return store.current().select("path", F.col("modified").cast("timestamp_ntz").alias("modified"), "content_hash",
                                  F.array_join(F.array_sort(F.transform("findings", lambda f: f["rule"])), ",").alias("rules"))
