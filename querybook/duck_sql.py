"""Oracle SQL: the same questions asked of DuckDB, composed from named CTEs.

Order-dependent rules are written with windows, self-joins or recursion here, where the
engine folds over arrays inside a row, so the two sides share no method.
"""

from __future__ import annotations

from lineweave.functions import fixed_values as V
from lineweave.functions.text import WHITESPACE

from .templates import (
    DENSE, CLOSERS, DEFAULT_CLOSER, DEFAULT_FILLER, EXTENSIONS, FILLERS, LANGUAGES, LINES_PER_FILE, OPENERS, TEMPLATES,
)


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(function: str, text: str, words) -> str:
    return "(" + " OR ".join(f"{function}({text}, {q(w)})" for w in words) + ")"


def has(text: str, words) -> str:
    return any_of("contains", text, words)


def trim(text: str) -> str:
    return f"trim({text}, {q(WHITESPACE)})"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_lang(value_of, column: str = "language") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(x)} THEN {value_of(x)}" for x in LANGUAGES) + " END"


def lines_of(table: str, key: str, text: str) -> str:
    """Lines of a text column: a final line break opens no line, CRLF counts once."""
    body = f"replace({text}, chr(13) || chr(10), chr(10))"
    return (f"SELECT {key}, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS text FROM ("
            f"SELECT {key}, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS l FROM ("
            f"SELECT {key}, string_split({body}, chr(10)) AS a FROM {table}))")


CTES: dict[str, str] = {}

# --- the derived code corpus ----------------------------------------------------------
_opener = case_lang(lambda x: q(OPENERS.get(x, FILLERS.get(x, DEFAULT_FILLER))))
_closer = case_lang(lambda x: q(CLOSERS.get(x, DEFAULT_CLOSER)))
_filler = case_lang(lambda x: q(FILLERS.get(x, DEFAULT_FILLER)))
_template = case_lang(lambda x: "([" + ", ".join(q(t) for t in TEMPLATES[x]) + "])[k + 1]")
CTES["code_lines"] = f"""
  SELECT 'src/d' || (file_id % 7) || '/f' || file_id || '.' || ext AS path, language, file_id, line,
    CASE WHEN line = 1 AND file_id % 3 = 0 THEN {_opener} WHEN line = {LINES_PER_FILE} THEN {_closer}
      ELSE CASE WHEN language = 'python' THEN '    ' ELSE '' END || coalesce({_template}, {_filler}) END AS text
  FROM (SELECT *, ([{", ".join(map(q, LANGUAGES))}])[file_id % {len(LANGUAGES)} + 1] AS language,
               ([{", ".join(map(q, EXTENSIONS))}])[file_id % {len(LANGUAGES)} + 1] AS ext
        FROM (SELECT event_id // {LINES_PER_FILE} AS file_id,
                     CAST(event_id % {LINES_PER_FILE} + 1 AS INTEGER) AS line,
                     CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events))"""


def dense_lines(name: str, giant: bool = False) -> str:
    """The dense corpora: line k of a file shows template k modulo their number. ``giant``: file 0 has half of all lines."""
    size, languages = DENSE[name]
    file_id, line = f"event_id // {size}", f"event_id % {size} + 1"
    if giant:
        file_id = f"CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id // {2 * size} + 1 END"
        line = f"CASE WHEN event_id % 2 = 0 THEN event_id // 2 ELSE event_id // 2 % {size} END + 1"
    names = list(languages)
    cases = " ".join(f"WHEN {q(x)} THEN ([{', '.join(q(t) for t in languages[x])}])[k % {len(languages[x])} + 1]"
                     for x in names)
    return f"""
  SELECT '{name}/f' || file_id || '.x' AS path, language, file_id, line, CASE language {cases} END AS text
  FROM (SELECT *, ([{", ".join(map(q, names))}])[file_id % {len(names)} + 1] AS language
        FROM (SELECT {file_id} AS file_id, CAST({line} AS INTEGER) AS line,
                     CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events))"""


CTES["code_files"] = """
  SELECT path, language, file_id, string_agg(text, chr(10) ORDER BY line) AS content FROM code_lines
  GROUP BY path, language, file_id"""


def texts(rules) -> str:
    return "(VALUES " + ", ".join(
        f"({q(r.name)}, {q(r.severity)}, {q(r.category)}, {q(r.message)})" for r in rules
    ) + ") AS t(rule, severity, category, message)"


def worded(select: str, rules, detail: str = "CAST(NULL AS VARCHAR)") -> str:
    """Rows ``(path, line, col, rule[, detail])`` with their rule's texts."""
    return (f"SELECT h.path, h.line, h.col, h.rule, t.severity, t.category, "
            f"replace(t.message, '{{n}}', coalesce(h.detail, '')) AS message FROM "
            f"(SELECT path, line, col, rule, {detail} AS detail FROM ({select})) h JOIN {texts(rules)} USING (rule)")


# --- file rules -----------------------------------------------------------------------
def file_rule_rows(table: str, key: str, text: str) -> str:
    tests = {
        "todo-comment": f"contains({text}, 'TODO')",
        "unsafe-usage": f"contains({text}, 'unsafe')",
        "possible-secret": has(f"lower({text})", ("password", "secret")),
        "large-file": f"strlen({text}) > {V.LARGE_FILE_BYTES}",
        "hardcoded-value": has(f"lower({text})", ("api_key", "token", "password")),
    }
    return " UNION ALL ".join(
        f"SELECT {key} AS path, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS col, {q(rule)} AS rule "
        f"FROM {table} WHERE {test}" for rule, test in tests.items())


CTES["file_findings"] = worded(file_rule_rows("code_files", "path", "content"), V.FILE_RULES)


# --- line rules -----------------------------------------------------------------------
def trigger(t: V.Trigger, views: dict[str, str], language: str = "language") -> str:
    text, parts = views[t.view], []
    if t.langs:
        parts.append(f"{language} IN {in_list(t.langs)}")
    if t.starts:
        parts.append(any_of("starts_with", text, t.starts))
    if t.equals:
        parts.append(f"{text} IN {in_list(t.equals)}")
    if t.has:
        parts.append(has(text, t.has))
    if t.also:
        parts.append(has(views[t.also_view or t.view], t.also))
    if t.ends:
        parts.append(any_of("ends_with", text, t.ends))
    if t.without:
        parts.append("NOT " + has(text, t.without))
    return "(" + " AND ".join(parts) + ")"


VIEWS = {"raw": "text", "lower": "lower(text)", "trim": trim("text")}


def line_rule_rows(table: str, key: str, rules=None) -> str:
    names = rules or list(dict.fromkeys(t.rule for t in V.LINE_TRIGGERS))
    return " UNION ALL ".join(
        f"SELECT {key} AS path, line, CAST(NULL AS INTEGER) AS col, {q(name)} AS rule FROM {table} WHERE "
        + " OR ".join(trigger(t, VIEWS) for t in V.LINE_TRIGGERS if t.rule == name) for name in names)


CTES["line_findings"] = worded(line_rule_rows("code_lines", "path"), V.LINE_RULES)

# Empty handlers: a state machine over the five lines of the window, as a list reduction.
# The state is 'look' (before the body), 'body', 'yes' or 'no'.
_T = "t"
_tail = f"{trim('substr(t, strpos(t, chr(123)) + 1)')}"
_step = f"""CASE
  WHEN s IN ('yes', 'no') OR t = '' THEN s
  WHEN s = 'look' THEN CASE
    WHEN contains(t, '{{}}') THEN 'yes'
    WHEN contains(t, '{{') THEN CASE WHEN {_tail} IN {in_list(V.EMPTY_BRACE_TAILS)} THEN 'yes'
                                     WHEN {_tail} = '' THEN 'body' ELSE 'no' END
    WHEN ends_with(t, ':') THEN 'body' ELSE 'look' END
  WHEN t IN {in_list(V.EMPTY_BODY_LINES)} THEN 'yes'
  WHEN {any_of("starts_with", "t", V.SKIPPED_BODY_STARTS)} THEN 'body'
  ELSE 'no' END"""
CTES["handler_findings"] = worded(f"""
  SELECT path, line, CAST(NULL AS INTEGER) AS col, 'empty-error-handler' AS rule FROM (
    SELECT path, language, line, text, list(text) OVER (
        PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND {V.HANDLER_LOOKAHEAD - 1} FOLLOWING) AS ahead
    FROM code_lines)
  WHERE ({" OR ".join(trigger(t, VIEWS) for t in V.HANDLER_TRIGGERS)})
    AND (contains({trim("text")}, '{{}}') OR ends_with({trim("text")}, '{{ }}')
         OR list_reduce(list_prepend('look', list_transform(ahead, lambda x: {trim("x")})),
                        lambda s, t: {_step}) = 'yes')""", V.LINE_RULES)

# Long functions: a recursion over the lines of each file.
_marker = case_lang(lambda x: has("trimmed", V.FUNCTION_MARKERS[x]) if x in V.FUNCTION_MARKERS else "false")
_opens = "length(trimmed) - length(replace(trimmed, '{', ''))"
_shuts = "length(trimmed) - length(replace(trimmed, '}', ''))"
CTES["long_findings"] = worded(f"""
  SELECT path, open_line AS line, CAST(NULL AS INTEGER) AS col, 'hard-to-read-function' AS rule,
         CAST(span AS VARCHAR) AS detail
  FROM walk WHERE span > {V.LONG_FUNCTION_LINES}""", V.LINE_RULES, "detail")
CTES["walk_lines"] = f"""
  SELECT path, line, language = 'python' AS py, trimmed = '' AS blank, {_marker} AS marker,
         ({_opens}) - ({_shuts}) AS delta, contains(trimmed, '}}') AS has_close,
         length(text) - length(ltrim(text, {q(WHITESPACE)})) AS indent
  FROM (SELECT *, {trim("text")} AS trimmed FROM code_lines)"""
CTES["walk"] = """
  SELECT path, line, CASE WHEN marker THEN line END AS open_line, CASE WHEN marker THEN delta ELSE 0 END AS depth,
         CASE WHEN marker THEN indent END AS base, CAST(NULL AS BIGINT) AS span, false AS closed
  FROM walk_lines WHERE line = 1
  UNION ALL
  SELECT path, line,
    CASE WHEN was_open IS NOT NULL THEN was_open WHEN marker THEN line END,
    CASE WHEN was_open IS NOT NULL THEN d WHEN marker THEN delta ELSE 0 END,
    CASE WHEN was_open IS NOT NULL THEN base WHEN marker THEN indent END,
    CASE WHEN closes THEN CAST(line - was_open + CASE WHEN py THEN 0 ELSE 1 END AS BIGINT) END,
    coalesce(closes, false)
  FROM (
    SELECT n.path, n.line, n.marker, n.delta, n.indent, n.py, w.base,
      CASE WHEN w.closed THEN NULL ELSE w.open_line END AS was_open,
      w.depth + n.delta AS d,
      CASE WHEN w.closed OR w.open_line IS NULL THEN false
           WHEN n.py THEN NOT n.blank AND n.indent <= w.base
           ELSE w.depth + n.delta <= 0 AND n.has_close END AS closes
    FROM walk w JOIN walk_lines n ON n.path = w.path AND n.line = w.line + 1)"""


# --- script planes --------------------------------------------------------------------
def re2(pattern: str) -> str:
    return pattern.replace("(?U)", "")


def script_pattern(p: V.ScriptPattern) -> str:
    text = VIEWS[p.view]
    parts = [has(text, p.seen)]
    if p.match:
        parts.append(f"regexp_matches({text}, {q(re2(p.match))})")
    if p.words:
        parts.append(has(text, p.words))
    if p.also:
        parts.append(f"regexp_matches({text}, {q(p.also)})")
    if p.unless:
        parts.append(f"NOT regexp_matches({text}, {q(p.unless)})")
    return "(" + " AND ".join(parts) + ")"


def script_rows(langs, rules, patterns) -> str:
    return " UNION ALL ".join(
        f"SELECT path, line, CAST(NULL AS INTEGER) AS col, {q(r.name)} AS rule FROM code_lines "
        f"WHERE language IN {in_list(langs)} AND (" + " OR ".join(
            script_pattern(p) for p in patterns if p.rule == r.name) + ")" for r in rules[:-1])


def flow_rows(langs, rule: str, source: str, sink: str, word: str) -> str:
    return f"""
  SELECT s.path, s.line, CAST(NULL AS INTEGER) AS col, {q(rule)} AS rule, s.variable AS detail
  FROM (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, {q(re2(word))})) AS variable FROM code_lines
        WHERE language IN {in_list(langs)} AND regexp_matches(text, {q(sink)})) s
  JOIN (SELECT path, variable, min(line) AS first FROM (
          SELECT path, line, regexp_extract(text, {q(source)}, 1) AS variable FROM code_lines
          WHERE language IN {in_list(langs)}) WHERE variable <> '' GROUP BY path, variable) d
    ON s.path = d.path AND s.variable = d.variable AND s.line >= d.first"""


CTES["ts_findings"] = worded(script_rows(V.JS, V.TS_RULES, V.TS_PATTERNS), V.TS_RULES)
CTES["java_findings"] = worded(script_rows(V.JAVA, V.JAVA_RULES, V.JAVA_PATTERNS), V.JAVA_RULES)
CTES["ts_flow"] = worded(flow_rows(V.JS, "ts-tainted-flow", V.TS_TAINT_SOURCE, V.TS_TAINT_SINK, V.TS_WORD),
                         V.TS_RULES, "detail")
CTES["java_flow"] = worded(flow_rows(V.JAVA, "java-tainted-flow", V.JAVA_TAINT_SOURCE, V.JAVA_TAINT_SINK,
                                     V.JAVA_WORD), V.JAVA_RULES, "detail")


# --- C sources ------------------------------------------------------------------------
def word_at_first_hit(text: str, word: str) -> str:
    at = f"strpos({text}, {q(word)})"
    return (f"({at} > 0 AND NOT ({at} > 1 AND regexp_matches(substr({text}, {at} - 1, 1), '[A-Za-z0-9_]')) "
            f"AND NOT regexp_matches(substr({text}, {at} + {len(word)}, 1), '[A-Za-z0-9_]'))")


def byte_at(text: str, word: str) -> str:
    at = f"strpos({text}, {q(word)})"
    return f"CAST(CASE WHEN {at} > 0 THEN strlen(substr({text}, 1, {at} - 1)) + 1 ELSE 1 END AS INTEGER)"


def style_rows(table: str, key: str, where: str = "true", rules=tuple(r.name for r in V.C_STYLE_RULES)) -> str:
    none = "CAST(NULL AS VARCHAR)"
    rows = []
    if "line-length" in rules:
        rows.append(("line-length", "1", "CAST(strlen(text) AS VARCHAR)",
                     f"strlen(text) > {V.STYLE_LINE_BYTES} AND NOT starts_with(text, '#') AND NOT "
                     + has("text", ("/*", "//"))))
    if "space-before-tab" in rules:
        tab = "' ' || chr(9)"
        rows.append(("space-before-tab", f"strlen(substr(text, 1, strpos(text, {tab}) - 1)) + 2", none,
                     f"contains(text, {tab})"))
    if "trailing-whitespace" in rules:
        rows.append(("trailing-whitespace", "strlen(text)", none, "text LIKE '% ' OR ends_with(text, chr(9))"))
    if "keyword-spacing" in rules:
        for w in V.C_SPACING_KEYWORDS:
            at = f"strpos(text, {q(w)})"
            rows.append(("keyword-spacing", byte_at("text", w), none,
                         f"{at} > 0 AND substr(text, {at} + {len(w)}, 1) = '(' AND NOT ({at} > 1 AND "
                         f"regexp_matches(substr(text, {at} - 1, 1), '[A-Za-z0-9_]'))"))
    if "brace-style" in rules:
        rows.append(("brace-style", byte_at("text", "{"), none, "contains(text, '{') AND ("
                     + " OR ".join(word_at_first_hit("text", w) for w in V.C_BRACE_KEYWORDS) + ")"))
    return " UNION ALL ".join(
        f"SELECT {key} AS path, line, CAST({col} AS INTEGER) AS col, {q(rule)} AS rule, {detail} AS detail "
        f"FROM {table} WHERE ({where}) AND ({test})" for rule, col, detail, test in rows)


CTES["c_lines"] = "SELECT path, line, text FROM code_lines WHERE language = 'c'"
CTES["c_style_findings"] = worded(style_rows("c_lines", "path"), V.C_STYLE_RULES, "detail")


def _called(call: str) -> str:
    return f"regexp_extract(text, {q(call + '[^(]*[(][ &*]*([A-Za-z0-9_-]*)')}, 1)"


CTES["c_lock_events"] = f"""
  SELECT path, line, 1 AS held, contains(text, 'spin_lock') AS spin,
         CASE WHEN contains(text, 'spin_lock') THEN {_called("spin_lock")} ELSE {_called("mutex_lock")} END AS name
  FROM c_lines WHERE {has("text", V.C_LOCK_CALLS)}
  UNION ALL
  SELECT path, line, 0, false,
         CASE WHEN contains(text, 'spin_unlock') THEN {_called("spin_unlock")} ELSE {_called("mutex_unlock")} END
  FROM c_lines WHERE {has("text", V.C_UNLOCK_CALLS)}"""
CTES["c_lock_findings"] = worded(f"""
  WITH judged AS (
    SELECT path, line, {byte_at("text", "return")} AS pos, {word_at_first_hit("text", "return")} AS returns,
           {has("text", V.C_SLEEP_CALLS)} AS sleeps FROM c_lines),
  state AS (
    SELECT j.path, j.line, j.pos, j.returns, j.sleeps, e.held, e.spin,
           row_number() OVER (PARTITION BY j.path, j.line, e.name ORDER BY e.line DESC, e.held) AS latest
    FROM judged j JOIN c_lock_events e ON e.path = j.path AND e.line <= j.line AND e.name <> ''
    WHERE j.returns OR j.sleeps)
  SELECT DISTINCT path, line, pos AS col, 'return-without-unlock' AS rule FROM state
  WHERE latest = 1 AND held = 1 AND returns
  UNION ALL
  SELECT DISTINCT path, line, 1, 'sleeping-in-atomic' FROM state WHERE latest = 1 AND held = 1 AND spin AND sleeps
""", V.C_FLOW_RULES)
CTES["c_rcu_findings"] = worded(f"""
  SELECT path, line, 1 AS col, 'RCU-missing-annotation' AS rule FROM (
    SELECT path, line, text, takes, coalesce(lag(after) OVER (PARTITION BY path ORDER BY line), 0) AS before FROM (
      SELECT *, total - least(0, min(total) OVER (PARTITION BY path ORDER BY line)) AS after FROM (
        SELECT path, line, text, takes, sum(takes - drops) OVER (PARTITION BY path ORDER BY line) AS total FROM (
          SELECT path, line, text, CAST(contains(text, 'rcu_read_lock(') AS INTEGER) AS takes,
                 CAST(contains(text, 'rcu_read_unlock(') AS INTEGER) AS drops FROM c_lines))))
  WHERE before + takes > 0 AND contains(text, '->') AND NOT {has("text", V.C_RCU_SAFE)}""", V.C_FLOW_RULES)
_after = V.GOTO_LABEL_WITHIN + V.GOTO_CLEANUP_WITHIN
CTES["c_goto_findings"] = worded(f"""
  SELECT path, line, {byte_at("text", "goto")} AS col, 'goto-out-without-cleanup' AS rule FROM (
    SELECT *, ahead[label + 1:label + {V.GOTO_CLEANUP_WITHIN}] AS body FROM (
      SELECT *, coalesce(list_position(list_transform(ahead[1:{V.GOTO_LABEL_WITHIN}],
                                                      lambda x: contains(x, 'out:')), true), 0) AS label FROM (
        SELECT path, line, text, coalesce(list(text) OVER (PARTITION BY path ORDER BY line
               ROWS BETWEEN 1 FOLLOWING AND {_after} FOLLOWING), []) AS ahead FROM c_lines)
      WHERE contains(text, 'goto out;')))
  WHERE NOT (label > 0 AND list_reduce(
    list_prepend(0, list_transform(body, lambda x: CASE WHEN {has("x", V.C_CLEANUP_WORDS)} THEN 1
                                                        WHEN {word_at_first_hit("x", "return")} THEN 2 ELSE 0 END)),
    lambda a, b: CASE WHEN a <> 0 THEN a ELSE b END) = 1)""", V.C_FLOW_RULES)
CTES["c_null_findings"] = worded("""
  SELECT d.path, d.line, 1 AS col, 'null-deref-before-check' AS rule FROM (
    SELECT path, line, regexp_extract(substr(text, 1, strpos(text, '->') - 1), '([A-Za-z0-9_)]+)$', 1) AS pointer
    FROM c_lines WHERE contains(text, '->')) d
  WHERE d.pointer <> '' AND EXISTS (
    SELECT 1 FROM c_lines t WHERE t.path = d.path AND t.line > d.line AND contains(t.text, d.pointer)
      AND (contains(t.text, 'if (') OR contains(t.text, 'if('))
      AND (contains(t.text, 'NULL') OR contains(t.text, '!')))""", V.C_FLOW_RULES)
CTES["c_marker_findings"] = worded("""
  SELECT path, 1 AS line, 1 AS col, 'missing-__init-__exit' AS rule FROM c_lines GROUP BY path
  HAVING (bool_or(contains(text, '__init')) AND bool_or(contains(text, '__exit')))
      OR bool_or(contains(text, '__init') AND contains(text, '_exit('))
      OR bool_or(contains(text, '__exit') AND contains(text, '_init('))""", V.C_FLOW_RULES)
CTES["c_call_findings"] = worded("""
  SELECT path, line, 1 AS col, 'printk-without-level' AS rule FROM c_lines
  WHERE contains(text, 'printk(') AND NOT contains(text, 'KERN_')
  UNION ALL
  SELECT path, line, 1, 'BUG_ON-usage' FROM c_lines WHERE contains(text, 'BUG_ON(')""", V.C_FLOW_RULES)

# --- everything a policy with language planes sees -------------------------------------
FINDING = "path, line, col, rule, severity, category, message"
C_FINDINGS = ("c_style_findings", "c_lock_findings", "c_rcu_findings", "c_goto_findings", "c_null_findings",
              "c_marker_findings", "c_call_findings")
CTES["local_findings"] = " UNION ALL ".join(
    f"SELECT {FINDING}, '{origin}' AS origin FROM {name}" for name, origin in (
        ("file_findings", "file"), ("line_findings", "registry"), ("handler_findings", "registry"),
        ("long_findings", "registry")))
_clean = "CASE WHEN severity IN ('critical', 'high', 'medium', 'low', 'info') THEN severity ELSE 'info' END"
CTES["language_findings"] = " UNION ALL ".join(
    f"SELECT path, line, col, rule, {_clean} AS severity, category, message, 'language' AS origin FROM {name}"
    for name in ("ts_findings", "java_findings", "ts_flow", "java_flow") + C_FINDINGS)

NEEDS = {
    "code_lines": (), "code_files": ("code_lines",), "file_findings": ("code_files",),
    "line_findings": ("code_lines",), "handler_findings": ("code_lines",), "walk_lines": ("code_lines",),
    "walk": ("walk_lines",), "long_findings": ("walk",), "ts_findings": ("code_lines",),
    "java_findings": ("code_lines",), "ts_flow": ("code_lines",), "java_flow": ("code_lines",),
    "c_lines": ("code_lines",), "c_style_findings": ("c_lines",), "c_lock_events": ("c_lines",),
    "c_lock_findings": ("c_lines", "c_lock_events"), "c_rcu_findings": ("c_lines",),
    "c_goto_findings": ("c_lines",), "c_null_findings": ("c_lines",), "c_marker_findings": ("c_lines",),
    "c_call_findings": ("c_lines",),
    "local_findings": ("file_findings", "line_findings", "handler_findings", "long_findings"),
    "language_findings": ("ts_findings", "java_findings", "ts_flow", "java_flow") + C_FINDINGS,
}


def compose(select: str, *names: str, lines: str | None = None) -> str:
    """``select`` with the CTEs it needs, in order; ``lines`` replaces the code corpus."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for needed in NEEDS[name]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    bodies = CTES if lines is None else {**CTES, "code_lines": lines}
    parts = [f"{name} AS ({bodies[name]})" for name in order]
    recursive = "RECURSIVE " if "walk" in order else ""
    return f"WITH {recursive}" + ",\n".join(parts) + f"\n{select}" if parts else select
