"""Values that results depend on: names, word lists, messages and limits.

Everything in this module is data.  The operators read these tables and compile
them to Spark columns; no rule logic lives here.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Severities, in falling order, with the rank used to compare.
SEVERITY_RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}

# Aliases folded to a severity before counting or comparing.
SEVERITY_ALIASES = {"warn": "medium", "warning": "medium"}

# ---------------------------------------------------------------------------
# File extensions that count as text without looking inside.
TEXT_EXTENSIONS = (
    "rs", "toml", "md", "txt", "json", "yaml", "yml", "py", "js", "ts", "tsx", "jsx", "java",
    "c", "h", "cpp", "hpp", "go", "rb", "php", "sh", "html", "css", "sql", "Dockerfile",
)

# Extension to language.
EXTENSION_LANGUAGES = {
    "py": "python", "rs": "rust", "java": "java", "js": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "json": "json", "toml": "toml", "md": "markdown",
    "mdx": "markdown", "go": "go", "php": "php", "rb": "ruby", "sh": "shell", "bash": "shell",
    "c": "c", "h": "c",
}

# Roots under which the kernel policy reviews every C file.
KERNEL_ROOTS = ("drivers", "fs", "include", "ipc", "kernel", "mm", "net")
KERNEL_SUBTREE_INCLUDE = ("**/*.c", "**/*.h")

# The only rules the kernel policy reports.
KERNEL_RULES = (
    "goto-out-without-cleanup", "return-without-unlock", "null-deref-before-check",
    "missing-__init-__exit", "RCU-missing-annotation", "sleeping-in-atomic",
    "BUG_ON-usage", "printk-without-level",
)

# ---------------------------------------------------------------------------
# Sizes and limits.
LARGE_FILE_BYTES = 20 * 1024
PREVIEW_CHARS = 1024
LONG_FUNCTION_LINES = 60
STYLE_LINE_BYTES = 80
MAX_EXTERNAL_FINDINGS = 500
MAX_NAME_BYTES = 256
MAX_MESSAGE_BYTES = 4096
STORE_VERSION = 2
REPORT_SCHEMA_VERSION = "2"


# The rule catalog (name, severity, category, summary, has a safe fix).
@dataclass(frozen=True)
class CatalogEntry:
    name: str
    severity: str
    category: str
    summary: str
    supports_fix: bool


CATALOG = (
    CatalogEntry("todo-comment", "info", "maintainability", "TODO marker left in comments", True),
    CatalogEntry("unsafe-usage", "high", "safety", "Unsafe language construct present in code", False),
    CatalogEntry("possible-secret", "high", "security", "Secret-like assignment detected", False),
    CatalogEntry("hardcoded-value", "high", "security", "Hardcoded credential-like literal detected", False),
    CatalogEntry("large-file", "low", "maintainability", "Large file may hide complexity", False),
    CatalogEntry("deprecated-api", "medium", "modernization", "Deprecated API markers or imports detected", False),
    CatalogEntry("hard-to-read-function", "medium", "maintainability",
                 "Function body exceeds simple readability limits", False),
    CatalogEntry("debug-print", "low", "maintainability", "Debug print statement left in repository code", True),
    CatalogEntry("commented-out-code", "low", "maintainability", "Comment appears to contain disabled code", True),
    CatalogEntry("wildcard-import", "medium", "maintainability", "Wildcard import detected", True),
    CatalogEntry("empty-error-handler", "medium", "reliability",
                 "Error handling block is empty or only suppresses the failure", False),
    CatalogEntry("weak-hash-usage", "high", "security", "Weak hash primitive detected", False),
    CatalogEntry("insecure-random", "high", "security",
                 "Non-cryptographic randomness used in security-sensitive context", False),
    CatalogEntry("shell-command-concatenation", "high", "security",
                 "Shell command is assembled via string concatenation or interpolation", False),
    CatalogEntry("network-without-timeout", "medium", "reliability",
                 "Network client call is made without an explicit timeout", False),
    CatalogEntry("sql-string-concatenation", "high", "security",
                 "SQL query appears to be assembled via string concatenation", False),
    CatalogEntry("path-traversal-join", "high", "security",
                 "Path is built from user-controlled input without normalization", False),
    CatalogEntry("dangerous-deserialization", "high", "security", "Unsafe deserialization primitive detected", False),
    CatalogEntry("assert-or-panic-in-production", "medium", "reliability",
                 "Assertion or panic-style failure remains in production code paths", False),
)


# What each rule says when it fires (rule, severity, category, message).
@dataclass(frozen=True)
class RuleText:
    name: str
    severity: str
    category: str
    message: str


FILE_RULES = (
    RuleText("todo-comment", "info", "maintainability", "TODO marker found in file content"),
    RuleText("unsafe-usage", "high", "safety", "Possible unsafe usage detected"),
    RuleText("possible-secret", "high", "security", "Possible secret or sensitive value text detected"),
    RuleText("large-file", "low", "maintainability", "Large file snippet may hide complexity/quality issues"),
    RuleText("hardcoded-value", "high", "security", "Possible hardcoded credential-like token detected"),
)

LINE_RULES = (
    RuleText("commented-out-code", "low", "maintainability", "Comment appears to contain disabled code"),
    RuleText("debug-print", "low", "maintainability", "Debug print statement left in code"),
    RuleText("wildcard-import", "medium", "maintainability", "Wildcard import detected"),
    RuleText("deprecated-api", "medium", "modernization", "Deprecated marker or API usage detected"),
    RuleText("empty-error-handler", "medium", "reliability", "Error handling block is empty and suppresses failures"),
    RuleText("weak-hash-usage", "high", "security",
             "Weak hash primitive detected; prefer a modern password hashing or SHA-256+ primitive"),
    RuleText("insecure-random", "high", "security",
             "Non-cryptographic randomness appears to generate a sensitive value"),
    RuleText("shell-command-concatenation", "high", "security",
             "Shell command is constructed dynamically; prefer argument arrays or strict escaping"),
    RuleText("network-without-timeout", "medium", "reliability",
             "Network call lacks an explicit timeout and may hang indefinitely"),
    RuleText("sql-string-concatenation", "high", "security",
             "SQL query appears to be assembled dynamically; prefer parameterized queries"),
    RuleText("path-traversal-join", "high", "security",
             "Path uses request-derived input; validate and normalize before filesystem access"),
    RuleText("dangerous-deserialization", "high", "security",
             "Unsafe deserialization primitive detected on potentially untrusted data"),
    RuleText("assert-or-panic-in-production", "medium", "reliability",
             "Assertion-style failure remains in repository code; confirm it is intended for production"),
    RuleText("hard-to-read-function", "medium", "maintainability",
             "Function spans {n} lines; consider splitting for readability"),
)

TS_RULES = (
    RuleText("ts-eval-usage", "high", "security", "eval() usage detected; avoid executing dynamic code"),
    RuleText("ts-dynamic-code", "high", "security", "Dynamic code execution primitive detected"),
    RuleText("ts-dom-xss", "high", "security", "innerHTML assignment without obvious sanitization"),
    RuleText("ts-command-injection", "high", "security", "Shell command appears to be built from dynamic input"),
    RuleText("ts-path-traversal", "high", "security",
             "Filesystem path uses request-derived input without normalization"),
    RuleText("ts-network-no-timeout", "medium", "reliability",
             "fetch() call lacks an explicit timeout/cancellation path"),
    RuleText("ts-empty-catch", "medium", "reliability", "Empty catch block suppresses failures"),
    RuleText("ts-jwt-none-alg", "high", "security", "JWT signing appears to allow the none algorithm"),
    RuleText("ts-weak-hash", "high", "security", "Weak hash primitive detected"),
    RuleText("ts-tainted-flow", "high", "security", "Request-derived variable {n} flows into a sensitive sink"),
)

JAVA_RULES = (
    RuleText("java-command-exec", "high", "security", "Command execution primitive detected"),
    RuleText("java-dangerous-deserialization", "high", "security", "Unsafe Java deserialization primitive detected"),
    RuleText("java-weak-hash", "high", "security", "Weak hash primitive detected"),
    RuleText("java-sql-concatenation", "high", "security", "SQL query appears to be assembled dynamically"),
    RuleText("java-network-no-timeout", "medium", "reliability", "Network call lacks an explicit timeout"),
    RuleText("java-empty-catch", "medium", "reliability", "Empty catch block suppresses failures"),
    RuleText("java-path-traversal", "high", "security",
             "Filesystem path uses request-derived input without normalization"),
    RuleText("java-assertion-leftover", "medium", "reliability",
             "Assertion-style failure remains in repository code"),
    RuleText("java-tainted-flow", "high", "security", "Request-derived variable {n} flows into a sensitive sink"),
)

# Python symbol rules as (rule, severity, message, symbol kind, symbol name).
PYTHON_SYMBOL_RULES = (
    ("python-eval-usage", "high", "Use of eval() detected", "call", "eval"),
    ("debug-print", "low", "print() detected", "call", "print"),
    ("debugger-import", "medium", "pdb imported", "import", "pdb"),
)

C_STYLE_RULES = (
    RuleText("line-length", "warning", "style", "Line exceeds 80 characters ({n} characters)"),
    RuleText("space-before-tab", "error", "style", "Space before tab in indentation"),
    RuleText("trailing-whitespace", "warning", "style", "Trailing whitespace at end of line"),
    RuleText("keyword-spacing", "warning", "style", "Missing space after keyword"),
    RuleText("brace-style", "warning", "style", "Opening brace should follow kernel style"),
)

C_FLOW_RULES = (
    RuleText("goto-out-without-cleanup", "medium", "reliability", "goto out reaches a label without visible cleanup"),
    RuleText("return-without-unlock", "high", "concurrency", "Return occurs while a lock is still held"),
    RuleText("sleeping-in-atomic", "high", "concurrency", "Sleeping or blocking call appears in atomic context"),
    RuleText("null-deref-before-check", "high", "correctness",
             "Pointer is dereferenced before it is checked for NULL"),
    RuleText("RCU-missing-annotation", "medium", "concurrency",
             "RCU-protected pointer dereference should use rcu_dereference"),
    RuleText("printk-without-level", "warning", "style", "printk should include a KERN_ log level"),
    RuleText("BUG_ON-usage", "medium", "reliability", "Prefer WARN_ON when the condition is recoverable"),
    RuleText("missing-__init-__exit", "medium", "lifecycle",
             "Inconsistent __init/__exit annotation markers in this file"),
)


# ---------------------------------------------------------------------------
# Trigger words of the line rules.  A row fires when every group it
# fills is met; a group is met by any one of its words.
@dataclass(frozen=True)
class Trigger:
    rule: str
    langs: tuple[str, ...] = ()          # empty: every language
    view: str = "trim"                   # trim | lower | raw
    starts: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    also_view: str = ""                  # view of ``also``, if it is another one
    ends: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


JS = ("javascript", "typescript")
PY = ("python",)
RS = ("rust",)
JAVA = ("java",)
GO = ("go",)
PHP = ("php",)
RB = ("ruby",)
SH = ("shell",)

LINE_TRIGGERS = (
    Trigger("commented-out-code", starts=("//", "#", "/*", "*"),
            has=("if (", "return ", "let ", "const ", "public ", "private ", ";")),

    Trigger("debug-print", RS, starts=("dbg!", "println!")),
    Trigger("debug-print", PY, starts=("print(",)),
    Trigger("debug-print", JS, starts=("console.log(", "console.debug(")),
    Trigger("debug-print", JAVA, starts=("System.out.println(",)),
    Trigger("debug-print", GO, starts=("fmt.Println(", "fmt.Printf(")),
    Trigger("debug-print", PHP, starts=("var_dump(", "print_r(")),
    Trigger("debug-print", RB, starts=("puts ", "p ")),
    Trigger("debug-print", SH, starts=("echo DEBUG", "set -x")),

    Trigger("wildcard-import", PY, starts=("from ",), has=(" import *",)),
    Trigger("wildcard-import", JAVA, starts=("import ",), ends=(".*;",)),
    Trigger("wildcard-import", JS, starts=("import * as ",)),
    Trigger("wildcard-import", PHP, starts=("use ",), has=("*",), ends=(";",)),

    Trigger("deprecated-api", view="lower", has=("deprecated",)),

    Trigger("weak-hash-usage", view="lower", has=("md5", "sha1")),

    Trigger("insecure-random", JS, "lower", has=("math.random()",), also=("token", "secret", "password", "key")),
    Trigger("insecure-random", PY, "lower", has=("random.random(",)),
    Trigger("insecure-random", PY, "lower", has=("random.choice(",), also=("token", "secret")),
    Trigger("insecure-random", JAVA, "lower", has=("new random(",), also=("token", "secret", "password")),
    Trigger("insecure-random", GO, "lower", has=("rand.int(", "rand.read(", "math/rand"),
            also=("token", "secret", "password", "session")),
    Trigger("insecure-random", PHP, "lower", has=("mt_rand(", "rand("),
            also=("token", "secret", "password", "session")),
    Trigger("insecure-random", RB, "lower", has=("rand(",), also=("token", "secret", "password", "session")),

    Trigger("shell-command-concatenation", JS, has=("exec(", "spawn("), also=("+", "${")),
    Trigger("shell-command-concatenation", PY, has=("subprocess",), also=("+", "%s", ".format(")),
    Trigger("shell-command-concatenation", JAVA, has=("exec(",), also=("+", "String.format(")),
    Trigger("shell-command-concatenation", GO, has=("exec.Command(",), also=("+", "fmt.Sprintf(")),
    Trigger("shell-command-concatenation", PHP, has=("shell_exec(", "exec(", "system(", "passthru("),
            also=(".", "sprintf(")),
    Trigger("shell-command-concatenation", RB, has=("system(", "Open3.capture"), also=("+", "format(")),
    Trigger("shell-command-concatenation", SH, starts=("sh -c ",)),

    Trigger("network-without-timeout", JS, "lower", has=("fetch(", "axios.get(", "axios.post("),
            without=("signal", "timeout")),
    Trigger("network-without-timeout", PY, "lower", has=("requests.get(", "requests.post("), without=("timeout=",)),
    Trigger("network-without-timeout", JAVA, "lower", has=("httpclient.newhttpclient(",)),
    Trigger("network-without-timeout", JAVA, "lower", has=("url.openconnection(",),
            without=("setconnecttimeout", "setreadtimeout")),
    Trigger("network-without-timeout", GO, "lower", has=("http.get(", "http.post(", "client := &http.client{}"),
            without=("timeout",)),
    Trigger("network-without-timeout", PHP, "lower", has=("curl_init(", 'file_get_contents("http'),
            without=("curlopt_timeout", "timeout")),
    Trigger("network-without-timeout", RB, "lower", has=("net::http.start(", "net::http.get("),
            without=("read_timeout", "open_timeout")),
    Trigger("network-without-timeout", SH, "lower", has=("curl ", "wget "),
            without=("--max-time", "--connect-timeout", "--timeout")),

    Trigger("sql-string-concatenation", view="lower", has=("select ", "insert ", "update ", "delete "),
            also=("+", "${", ".format(", " . "), also_view="raw"),

    Trigger("path-traversal-join", JS, "lower", has=("path.join(", "path.resolve("),
            also=("req.", "params", "query", "body")),
    Trigger("path-traversal-join", PY, "lower", has=("os.path.join(", "pathlib.path("),
            also=("request", "user_input", "filename")),
    Trigger("path-traversal-join", JAVA, "lower", has=("paths.get(", "path.of("),
            also=("request", "param", "filename")),
    Trigger("path-traversal-join", GO, "lower", has=("filepath.join(", "path.join("),
            also=("request", "filename", "userinput", "r.url")),
    Trigger("path-traversal-join", PHP, "lower", has=("$base", "$basedir"),
            also=(".$_GET[", ".$_POST[", " . $_GET[", " . $_POST[", ".$filename", " . $filename",
                  ".$path", " . $path"), also_view="raw"),
    Trigger("path-traversal-join", RB, "lower", has=("file.join(", "pathname.new("),
            also=("params[", "filename", "user_input")),
    Trigger("path-traversal-join", SH, "lower", has=("$filename", "$path", "$user_input"),
            also=("cp ", "cat ", "tar ", "rm ")),

    Trigger("dangerous-deserialization", PY, "lower", has=("pickle.loads(", "yaml.load(")),
    Trigger("dangerous-deserialization", JS, "lower", has=("deserialize(",), also=("user",)),
    Trigger("dangerous-deserialization", JAVA, "lower", has=("objectinputstream", "xmldecoder")),
    Trigger("dangerous-deserialization", GO, "lower", has=("gob.newdecoder(",)),
    Trigger("dangerous-deserialization", GO, "lower", has=("json.newdecoder(",), also=("r.body",)),
    Trigger("dangerous-deserialization", PHP, "lower", has=("unserialize(", "yaml_parse(")),
    Trigger("dangerous-deserialization", RB, "lower", has=("marshal.load(", "yaml.load(")),

    Trigger("assert-or-panic-in-production", RS, has=("panic!(", "assert!(")),
    Trigger("assert-or-panic-in-production", PY, starts=("assert ",)),
    Trigger("assert-or-panic-in-production", JS, has=("console.assert(",)),
    Trigger("assert-or-panic-in-production", JS, has=("throw new Error(",), also=("TODO",)),
    Trigger("assert-or-panic-in-production", JAVA, starts=("assert ",)),
    Trigger("assert-or-panic-in-production", JAVA, has=("throw new AssertionError(",)),
    Trigger("assert-or-panic-in-production", GO, has=("panic(",)),
    Trigger("assert-or-panic-in-production", PHP, has=("assert(", "die(", "exit(")),
    Trigger("assert-or-panic-in-production", RB, has=('raise "TODO', 'fail "TODO')),
    Trigger("assert-or-panic-in-production", SH, equals=("set -e",)),
)

# Lines that open an error handler.
HANDLER_TRIGGERS = (
    Trigger("empty-error-handler", JS, starts=("catch",)),
    Trigger("empty-error-handler", JS, has=(".catch(() =>", ".catch((", "catch (")),
    Trigger("empty-error-handler", JAVA, starts=("catch ", "catch(")),
    Trigger("empty-error-handler", JAVA, has=("catch (",)),
    Trigger("empty-error-handler", PY, starts=("except",)),
    Trigger("empty-error-handler", RS, has=("if let Err(", "match ")),
    Trigger("empty-error-handler", GO, has=("if err != nil {", "if err :=", "if err:=")),
    Trigger("empty-error-handler", RB, equals=("rescue",)),
    Trigger("empty-error-handler", RB, starts=("rescue ",)),
    Trigger("empty-error-handler", PHP, starts=("catch (", "catch(")),
)
# How far ahead a handler body is looked for, and the lines that leave it empty.
HANDLER_LOOKAHEAD = 5
EMPTY_BODY_LINES = ("}", "pass", "// ignored", "// ignore", "// noop", "/* ignored */")
SKIPPED_BODY_STARTS = ("except", "catch")
EMPTY_BRACE_TAILS = ("}", "};")

# Words that open a function, by language.
FUNCTION_MARKERS = {
    "rust": ("fn ",),
    "python": ("def ",),
    "javascript": ("function ", "=> {"),
    "typescript": ("function ", "=> {"),
    "java": (" void ", " String ", " int "),
}

# ---------------------------------------------------------------------------
# Patterns of the script-language rules.  ``seen`` is a plain word that any
# match must contain; it is tested first because it is far cheaper than a pattern.
@dataclass(frozen=True)
class ScriptPattern:
    rule: str
    seen: tuple[str, ...]
    match: str = ""
    words: tuple[str, ...] = ()
    also: str = ""
    unless: str = ""
    view: str = "raw"


TS_PATTERNS = (
    ScriptPattern("ts-eval-usage", ("eval",), r"\beval\s*\("),
    ScriptPattern("ts-dynamic-code", ("new Function", "setTimeout", "setInterval"),
                  r"""(new Function\s*\()|(setTimeout\s*\(\s*["'])|(setInterval\s*\(\s*["'])"""),
    ScriptPattern("ts-dom-xss", ("innerHTML",), r"innerHTML\s*=", unless=r"(?i)DOMPurify|sanitize"),
    ScriptPattern("ts-command-injection", ("child_process", "exec(", "spawn(", "execSync("), words=("+", "${")),
    ScriptPattern("ts-path-traversal",
                  ("fs.readFile", "fs.writeFile", "fs.createReadStream", "path.join", "path.resolve"),
                  words=("req.", "params", "query", "body")),
    ScriptPattern("ts-network-no-timeout", ("fetch(",), unless=r"(?i)signal|timeout"),
    ScriptPattern("ts-empty-catch", ("catch",), r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ScriptPattern("ts-jwt-none-alg", ("jwt.sign(",), words=("'none'", "'none\"", "\"none'", '"none"')),
    ScriptPattern("ts-weak-hash", ("crypto.createhash(",), words=("md5", "sha1"), view="lower"),
)
TS_TAINT_SOURCE = (
    r"(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*="
    r".*(?:req\.(?:body|query|params)|context\.request|location\.search|process\.argv)"
)
TS_TAINT_SOURCE_WORDS = ("req.body", "req.query", "req.params", "context.request", "location.search", "process.argv")
TS_TAINT_SINK = r"(?i)exec\(|spawn\(|fetch\(|axios\.|innerHTML\s*=|path\.join\(|path\.resolve\("
TS_WORD = r"[A-Za-z0-9_]+"

JAVA_PATTERNS = (
    ScriptPattern("java-command-exec", ("Runtime.getRuntime().exec", "new ProcessBuilder")),
    ScriptPattern("java-dangerous-deserialization", ("ObjectInputStream", "XMLDecoder")),
    ScriptPattern("java-weak-hash", ("MessageDigest.getInstance",), words=("MD5", "SHA-1", "SHA1")),
    ScriptPattern("java-sql-concatenation", ("Statement",), "execute", words=("+",)),
    ScriptPattern("java-sql-concatenation", ("SELECT ", "INSERT ", "UPDATE ", "DELETE "), words=("+",)),
    ScriptPattern("java-network-no-timeout", ("HttpClient.newHttpClient()", ".send(", "openConnection()"),
                  unless=r"(?i)timeout"),
    ScriptPattern("java-empty-catch", ("catch",), r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ScriptPattern("java-path-traversal", ("Paths.get(", "Path.of(", "new File("), also=r"(?i)request|param|filename"),
    ScriptPattern("java-assertion-leftover", ("assert ", "throw new AssertionError")),
)
JAVA_TAINT_SOURCE = (
    r"(?:String|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*="
    r".*(?:request\.getParameter|req\.getParameter|System\.getProperty|args\[)"
)
JAVA_TAINT_SOURCE_WORDS = ("request.getParameter", "req.getParameter", "System.getProperty", "args[")
JAVA_TAINT_SINK = (
    r"Runtime\.getRuntime\(\)\.exec|ProcessBuilder|Files\.readString|Files\.writeString"
    r"|Paths\.get|Path\.of|Statement\.execute|PreparedStatement"
)
JAVA_WORD = r"(?U)\w+"

# ---------------------------------------------------------------------------
# C source words.
C_SPACING_KEYWORDS = ("if", "for", "while", "switch")
C_BRACE_KEYWORDS = ("if", "for", "while", "switch", "do")
C_CLEANUP_WORDS = (
    "kfree(", "free(", "mutex_unlock(", "spin_unlock(", "up(", "put_", "release(", "cleanup",
    "unlock(", "destroy(", "close(", "rcu_read_unlock(",
)
C_LOCK_CALLS = ("spin_lock(", "spin_lock_irqsave(", "spin_lock_bh(", "mutex_lock(")
C_UNLOCK_CALLS = ("spin_unlock(", "spin_unlock_irqrestore(", "spin_unlock_bh(", "mutex_unlock(")
C_SLEEP_CALLS = ("msleep(", "schedule(", "might_sleep(")
C_RCU_SAFE = ("rcu_dereference(", "list_for_each_entry_rcu", "hlist_for_each_entry_rcu")
GOTO_LABEL_WITHIN = 7
GOTO_CLEANUP_WITHIN = 5


# ---------------------------------------------------------------------------
# Secret assignments.
SECRET_KEY_WORDS = ("password", "secret", "api_key", "token")
SECRET_PLACEHOLDERS = ("changeme", "example", "dummy")

# Line rules whose findings have a safe fix.
FIXABLE_RULES = ("todo-comment", "debug-print", "commented-out-code", "wildcard-import")
REVIEW_MARKER = "// REVIEW: replace wildcard import with explicit imports (line {n})"
REVIEW_SUFFIX = " // REVIEW: replace wildcard import with explicit imports"
