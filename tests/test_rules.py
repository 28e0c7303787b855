"""Rules on small texts; every case lists all rules that fire, by line."""

import pytest
from pyspark.sql import functions as F

from lineweave.functions.findings_schema import findings_from_hits
from lineweave.operators import c_rules, file_rules, line_rules, python_symbols, script_rules, secrets
from lineweave.operators.lines import explode_lines, with_lines
from lineweave.operators.rulepack import RulePack, UserRule, analyze_with
from lineweave.plans.policies import Policy
from lineweave.plans.review import ReviewOptions, review_files

LINE_CASES = [
    ("rust", "  dbg!(x);", {"debug-print"}),
    ("rust", "let y = 1; // println!", set()),
    ("rust", "panic!(\"md5\")", {"assert-or-panic-in-production", "weak-hash-usage"}),
    ("python", "from a.b import *", {"wildcard-import"}),
    ("python", "from a import b", set()),
    ("python", "# return 1", {"commented-out-code"}),
    ("python", "# a remark", set()),
    ("python", "x = random.random() * 2", {"insecure-random"}),
    ("python", "x = Random.Random(1)", {"insecure-random"}),
    ("python", "token = random.choice(a)", {"insecure-random"}),
    ("python", "n = random.choice(a)", set()),
    ("python", "requests.post(u, TIMEOUT=3)", set()),
    ("python", "requests.post(u)", {"network-without-timeout"}),
    ("python", "subprocess.run('ls %s' % d)", {"shell-command-concatenation"}),
    ("python", "yaml.load(f)", {"dangerous-deserialization"}),
    ("python", "os.path.join(a, user_input)", {"path-traversal-join"}),
    ("python", "assert x", {"assert-or-panic-in-production"}),
    ("javascript", "import * as x from 'y'", {"wildcard-import"}),
    ("typescript", "console.debug(1)", {"debug-print"}),
    ("javascript", "const key = Math.random();", {"insecure-random"}),
    ("javascript", "fetch(u, { signal })", set()),
    ("javascript", "spawn(a + b)", {"shell-command-concatenation"}),
    ("javascript", "q = `select * from t where a = ${b}`", {"sql-string-concatenation"}),
    ("javascript", "throw new Error('TODO')", {"assert-or-panic-in-production"}),
    ("javascript", "throw new Error('x')", set()),
    ("javascript", "path.resolve(root, req.url)", {"path-traversal-join"}),
    ("java", "import a.b.*;", {"wildcard-import"}),
    ("java", "import a.b.C;", set()),
    ("java", "url.openConnection().setReadTimeout(1)", set()),
    ("java", "URL.openConnection()", {"network-without-timeout"}),
    ("java", "rt.exec(String.format(a))", {"shell-command-concatenation"}),
    ("java", "new XMLDecoder(s)", {"dangerous-deserialization"}),
    ("go", "fmt.Printf(x)", {"debug-print"}),
    ("go", "json.NewDecoder(r.Body)", {"dangerous-deserialization"}),
    ("go", "json.NewDecoder(f)", set()),
    ("go", "client := &http.Client{}", {"network-without-timeout"}),
    ("go", "session = rand.Read(b)", {"insecure-random"}),
    ("php", "use A\\*;", {"wildcard-import"}),
    ("php", "$p = $baseDir . $filename;", {"path-traversal-join"}),
    ("php", "file_get_contents(\"https://x\")", {"network-without-timeout"}),
    ("php", "exit(1)", {"assert-or-panic-in-production"}),
    ("php", "passthru($a . $b)", {"shell-command-concatenation"}),
    ("ruby", "p x", {"debug-print"}),
    ("ruby", "system(format(a))", {"shell-command-concatenation"}),
    ("ruby", "fail \"TODO\"", {"assert-or-panic-in-production"}),
    ("ruby", "Net::HTTP.start(h, read_timeout: 1)", set()),
    ("shell", "set -e", {"assert-or-panic-in-production"}),
    ("shell", "set -x", {"debug-print"}),
    ("shell", "rm $PATH", {"path-traversal-join"}),
    ("shell", "wget u --timeout 3", set()),
    ("shell", "sh -c x", {"shell-command-concatenation"}),
    ("html", "/* public x */ Deprecated SHA1", {"commented-out-code", "deprecated-api", "weak-hash-usage"}),
    ("sql", "delete from t . x", {"sql-string-concatenation"}),
]

def test_line_rules_by_case(spark):
    rows = [(str(i), lang, i, text) for i, (lang, text, _) in enumerate(LINE_CASES)]
    lines = spark.createDataFrame(rows, "path string, language string, line int, text string")
    got = {}
    for row in line_rules.line_rule_findings(lines, "path").collect():
        got.setdefault(int(row["path"]), set()).add(row["rule"])
    for i, (lang, text, want) in enumerate(LINE_CASES):
        assert got.get(i, set()) == want, (lang, text)


def test_single_pass_review_agrees_with_line_table(spark):
    rows = [(str(i), lang, text) for i, (lang, text, _) in enumerate(LINE_CASES)]
    files = spark.createDataFrame(rows, "path string, language string, content string").withColumn(
        "size", F.length("content").cast("long"))
    entries = review_files(files, Policy(name="none", rules=()), ReviewOptions(rule_set="registry"))
    got = {int(r["path"]): {f["rule"] for f in r["findings"]} for r in entries.collect()}
    for i, (lang, text, want) in enumerate(LINE_CASES):
        assert got[i] - {"empty-error-handler"} == want, (lang, text)


def test_file_rules(spark):
    rows = [("a", "TODO unsafe"), ("b", "PassWord"), ("c", "x" * 20480), ("d", "x" * 20481), ("e", "API_KEY"), ("f", "todo")]
    df = spark.createDataFrame(rows, "path string, content string")

    def rules(**kw):
        hits = df.select("path", file_rules.file_rule_hits(F.col("content"), **kw).alias("h"))
        got = {}
        for r in findings_from_hits(hits, "h", "path").collect():
            got.setdefault(r["path"], []).append(r["rule"])
        return {k: sorted(v) for k, v in got.items()}

    assert rules() == {"a": ["todo-comment", "unsafe-usage"], "b": ["hardcoded-value", "possible-secret"],
                       "d": ["large-file"], "e": ["hardcoded-value"]}
    assert rules(fast=True) == {"a": ["todo-comment", "unsafe-usage"]}
    assert rules(kernel=True)["a"] == ["unsafe-usage"]
    assert rules(enabled=["large-file"]) == {"d": ["large-file"]}


SCRIPT_CASES = [
    (script_rules.TYPESCRIPT, "eval (x)", {"ts-eval-usage"}),
    (script_rules.TYPESCRIPT, "medieval(x)", set()),
    (script_rules.TYPESCRIPT, "setTimeout('x', 1)", {"ts-dynamic-code"}),
    (script_rules.TYPESCRIPT, "setTimeout(x, 1)", set()),
    (script_rules.TYPESCRIPT, "a.innerHTML = sanitize(b)", set()),
    (script_rules.TYPESCRIPT, "a.innerHTML = b", {"ts-dom-xss"}),
    (script_rules.TYPESCRIPT, "execSync(`a ${b}`)", {"ts-command-injection"}),
    (script_rules.TYPESCRIPT, "fs.readFile(query.x)", {"ts-path-traversal"}),
    (script_rules.TYPESCRIPT, "fetch(u)", {"ts-network-no-timeout"}),
    (script_rules.TYPESCRIPT, "fetch(u, {Timeout: 1})", set()),
    (script_rules.TYPESCRIPT, "catch (e) {  }", {"ts-empty-catch"}),
    (script_rules.TYPESCRIPT, "jwt.sign(p, k, {algorithm: 'none'})", {"ts-jwt-none-alg"}),
    (script_rules.TYPESCRIPT, "Crypto.createHash('MD5')", {"ts-weak-hash"}),
    (script_rules.JAVA, "new ProcessBuilder(x)", {"java-command-exec"}),
    (script_rules.JAVA, "new XMLDecoder(x)", {"java-dangerous-deserialization"}),
    (script_rules.JAVA, "MessageDigest.getInstance(\"SHA-1\")", {"java-weak-hash"}),
    (script_rules.JAVA, "MessageDigest.getInstance(\"SHA-256\")", set()),
    (script_rules.JAVA, "Statement s; s.execute(a + b)", {"java-sql-concatenation"}),
    (script_rules.JAVA, "\"SELECT \" + a", {"java-sql-concatenation"}),
    (script_rules.JAVA, "\"select \" + a", set()),
    (script_rules.JAVA, "c.send(r)", {"java-network-no-timeout"}),
    (script_rules.JAVA, "c.send(r).timeout(1)", set()),
    (script_rules.JAVA, "new File(Filename)", {"java-path-traversal"}),
    (script_rules.JAVA, "catch(E e) {}", {"java-empty-catch"}),
    (script_rules.JAVA, "throw new AssertionError", {"java-assertion-leftover"}),
]


@pytest.mark.parametrize("plane", script_rules.SCRIPT_PLANES, ids=lambda p: p.name)
def test_script_patterns(spark, plane):
    cases = [(t, w) for p, t, w in SCRIPT_CASES if p is plane]
    lines = spark.createDataFrame([(str(i), plane.languages[0], i, t) for i, (t, _) in enumerate(cases)],
                                  "path string, language string, line int, text string")
    got = {}
    for r in script_rules.script_line_findings(plane, lines, "path").collect():
        got.setdefault(int(r["path"]), set()).add(r["rule"])
    for i, (text, want) in enumerate(cases):
        assert got.get(i, set()) == want, text


C_CASES = {
    "goto.c": ("int f(int e)\n{\n\tif (e)\n\t\tgoto out;\n\tx();\nout:\n\treturn 1;\n}\n",
               [("goto-out-without-cleanup", 4, 3)]),
    "goto_clean.c": ("\tgoto out;\nout:\n\tkfree(p);\n\treturn 1;\n", []),
    "held.c": ("\tmutex_lock(&m);\n\tif (a)\n\t\treturn 1;\n\tmutex_unlock(&m);\n\treturn 0;\n",
               [("return-without-unlock", 3, 3)]),
    "sleep.c": ("\tspin_lock(&a);\n\tmsleep(1);\n\tspin_unlock(&a);\n\tmsleep(1);\n", [("sleeping-in-atomic", 2, 1)]),
    "prototype.c": ("void spin_lock(spinlock_t *l);\nvoid msleep(int n);\n", [("sleeping-in-atomic", 2, 1)]),
    "null.c": ("\tv = q->v;\n\tif (!q)\n\t\tx();\n", [("null-deref-before-check", 1, 1)]),
    "null_ok.c": ("\tif (!q)\n\t\tx();\n\tv = q->v;\n", []),
    "rcu.c": ("\trcu_read_unlock();\n\trcu_read_lock();\n\tv = p->v;\n\tw = rcu_dereference(p->w);\n"
              "\trcu_read_unlock();\n\tv = p->v;\n", [("RCU-missing-annotation", 3, 1)]),
    "marks.c": ("int __init a(void);\nint __exit b(void);\n", [("missing-__init-__exit", 1, 1)]),
    "marks2.c": ("x = __init m_exit();\n", [("missing-__init-__exit", 1, 1)]),
    "calls.c": ("printk(\"a\");\nprintk(KERN_INFO \"a\");\nBUG_ON(x);\n",
                [("printk-without-level", 1, 1), ("BUG_ON-usage", 3, 1)]),
    "clean.c": ("int f(void)\n{\n\treturn 0;\n}\n", []),
}


def test_c_flow_rules(spark):
    df = spark.createDataFrame([(p, "c", t) for p, (t, _) in C_CASES.items()],
                               "path string, language string, content string")
    lines = with_lines(df, keep_cr=True)
    hits = lines.select("path", c_rules.flow_hits(F.col("lines"), F.col("content")).alias("h"))
    got = {}
    for r in findings_from_hits(hits, "h", "path").collect():
        got.setdefault(r["path"], []).append((r["rule"], r["line"], r["column"]))
    for path, (_, want) in C_CASES.items():
        assert sorted(got.get(path, [])) == sorted(want), path


def test_files_and_names_are_followed_whole(spark):
    text = "".join(f"\tspin_lock(&l{i});\n" for i in range(70)) + "\tspin_unlock(&l0);\n"
    unlocked = "".join(f"\tspin_unlock(&l{i});\n" for i in range(64))
    long = "x" * 63
    other = f"\tspin_lock(&{long}a);\n\tspin_unlock(&{long}b);\n\treturn 0;\n"
    df = spark.createDataFrame([("a.c", "c", text + unlocked + "\treturn 0;\n"), ("b.c", "c", other)],
                               "path string, language string, content string")
    hits = with_lines(df, keep_cr=True).select("path", c_rules.flow_hits(F.col("lines"), F.col("content")).alias("h"))
    found = findings_from_hits(hits, "h", "path").collect()
    assert sorted((r["path"], r["rule"]) for r in found) == [("a.c", "return-without-unlock"), ("b.c", "return-without-unlock")]


def test_c_style(spark):
    text = "if(a){\n \tx;\ny; \n" + "z" * 81 + "\n#" + "z" * 90 + "\n// " + "z" * 90 + "\né {do}\nxif(1) if(2)\n"
    df = spark.createDataFrame([("a.c", "c", text)], "path string, language string, content string")
    got = sorted((r["line"], r["rule"], r["column"]) for r in c_rules.style_findings(
        explode_lines(df, "path", "language"), "path").collect())
    assert got == [(1, "brace-style", 6), (1, "keyword-spacing", 1), (2, "space-before-tab", 2),
                   (3, "trailing-whitespace", 3), (4, "line-length", 1), (7, "brace-style", 4)]


def test_python_symbols(spark):
    df = spark.createDataFrame([
        ("a.py", "import pdb, os\nprint(eval('1'))\nos.eval(2)\n"), ("b.py", "from pdb import x\n"), ("c.py", "def f(:\n")],
        "path string, content string")
    found = python_symbols.symbol_findings(python_symbols.python_symbols(df, "path"), "path").collect()
    assert sorted((r["path"], r["line"], r["rule"]) for r in found) == [
        ("a.py", 1, "debugger-import"), ("a.py", 2, "debug-print"), ("a.py", 2, "python-eval-usage")]


def test_secret_assignments(spark):
    text = ('api_key = "k1"\npassword: \'pw\'\n{"token": "t-1", "x": 1}\nsecret = "changeme"\ntoken = "${TOKEN}"\n'
            'password = plain\nmy.token="a" other_secret=\'b\'\nsecret = ""\n')
    df = spark.createDataFrame([("f", text)], "path string, content string")
    got = sorted((r["line"], r["key"], r["value"]) for r in secrets.secret_assignments(df, "path").collect())
    assert got == [(1, "api_key", "k1"), (2, "password", "pw"), (3, "token", "t-1"), (7, "my.token", "a"),
                   (7, "other_secret", "b")]


def test_rule_pack_and_analyzer(spark):
    pack = RulePack("p", [UserRule("tabs", "low", "style", "Tab", lambda v: F.contains(v["raw"], F.lit("\t")), ("go",))])
    df = spark.createDataFrame([("a.go", "go", "\tx\ny"), ("b.py", "python", "\tx")],
                               "path string, language string, content string")
    found = pack.findings(explode_lines(df, "path", "language"), "path").collect()
    assert [(r["path"], r["line"], r["rule"], r["source"]) for r in found] == [("a.go", 1, "tabs", "rule-pack:p")]

    def long_files(path, content):
        return [("long", "HIGH", "size", f"{path} is long", len(content))] if len(content) > 3 else []

    rows = analyze_with(df, "go", long_files, "path").collect()
    assert [(r["path"], r["rule"], r["line"]) for r in rows] == [("a.go", "long", 4)]
