"""Line templates of the derived code corpus (see FIXTURES.md, section 3)."""

# One list per language; line k of a file shows template k, if there is one.
TEMPLATES = {
    "rust": [
        'dbg!(value);',
        'println!("x");',
        '// let old = 1;',
        '// TODO: tidy',
        'unsafe { run() }',
        'if let Err(e) = go() {}',
        'panic!("boom");',
        'assert!(ok);',
        'let h = md5::compute(d);',
        '#[deprecated]',
        'let password = "x1";',
    ],
    "python": [
        "print('debug')",
        'from pkg import *',
        '# return x',
        '# TODO later',
        'except ValueError:',
        'pass',
        'h = hashlib.md5(d)',
        'tok = random.random()',
        "subprocess.run('ls ' + d)",
        'requests.get(url)',
        'q = "SELECT * FROM t WHERE id = " + uid',
        'p = os.path.join(base, filename)',
        'o = pickle.loads(d)',
        'assert ok',
        'eval(expr)',
        'import pdb',
        "api_key = 'k1'",
    ],
    "javascript": [
        'console.log(x);',
        'import * as fs from "fs";',
        '// const old = 1;',
        'try { go(); } catch (err) {}',
        'const token = Math.random();',
        'exec(`cat ${name}`);',
        'fetch(url);',
        'const q = "SELECT * FROM t WHERE id = " + id;',
        'path.join(base, req.params.file);',
        'deserialize(userInput);',
        'console.assert(ok);',
        'eval(expr);',
        'new Function("x");',
        'el.innerHTML = html;',
        'jwt.sign(p, k, { algorithm: "none" });',
        'crypto.createHash("md5");',
        'const uid = req.query.id;',
        'fetch(uid);',
        'exec(uid);',
    ],
    "java": [
        'System.out.println(x);',
        'import java.util.*;',
        '// return old;',
        'catch (Exception e) {}',
        'Random r = new Random(); String token;',
        'Runtime.getRuntime().exec("sh " + f);',
        'HttpClient.newHttpClient();',
        'String q = "SELECT a FROM t WHERE id = " + id;',
        'Path p = Paths.get(base, filename);',
        'new ObjectInputStream(in);',
        'assert ok;',
        'MessageDigest.getInstance("MD5");',
        'String uid = request.getParameter("id");',
        'Path q2 = Path.of(uid);',
    ],
    "go": [
        'fmt.Println(x)',
        'if err != nil {}',
        'sessionToken = rand.Int(9)',
        'exec.Command("sh", "-c", "cat "+f)',
        'http.Get(url)',
        'q := "SELECT a FROM t WHERE id = " + id',
        'filepath.Join(base, filename)',
        'gob.NewDecoder(r.Body)',
        'panic("x")',
        'sum := sha1.Sum(d)',
        '// Deprecated: use g',
    ],
    "php": [
        'var_dump($x);',
        'use Foo\\*;',
        'catch (Exception $e) {}',
        '$token = mt_rand();',
        '$o = shell_exec("cat " . $f);',
        'curl_init($u);',
        '$q = "SELECT a FROM t WHERE id = " . $id;',
        '$p = $base . $_GET["f"];',
        'unserialize($b);',
        'die("x");',
        '$h = md5($p);',
    ],
    "ruby": [
        'puts x',
        'rescue {}',
        'token = rand(100)',
        'system("cat " + f)',
        'Net::HTTP.get(uri)',
        'p = File.join(base, params[:f])',
        'Marshal.load(d)',
        'raise "TODO"',
        'Digest::SHA1.hexdigest(d)',
    ],
    "shell": [
        'echo DEBUG: x',
        'sh -c "cat x"',
        'curl https://example.com/x',
        'cat $filename',
        'md5sum f',
        'set -e',
        '# if (x) return 1;',
    ],
    "c": [
        'spin_lock(&dev_lock);',
        'spin_unlock(&dev_lock);',
        'mutex_lock(&mtx);',
        'mutex_unlock(&mtx);',
        'msleep(10);',
        'return 0;',
        'goto out;',
        'out:',
        'kfree(q);',
        'rcu_read_lock();',
        'rcu_read_unlock();',
        'v = p->val;',
        'if (!p)',
        'w = rcu_dereference(p);',
        'printk("hi");',
        'BUG_ON(x);',
        'static int __init m_init(void)',
        'static void __exit m_exit(void)',
        'if(x){',
        'int y;  ',
        ' \tint z;',
        'int a_long_line_name_that_goes_on = another_long_name_that_goes_on + one_more_name_here_too;',
    ],
}
TEMPLATES["typescript"] = TEMPLATES["javascript"]

LANGUAGES = ["rust", "python", "javascript", "typescript", "java", "go", "php", "ruby", "shell", "c"]
EXTENSIONS = ["rs", "py", "js", "ts", "java", "go", "php", "rb", "sh", "c"]
OPENERS = {
    "rust": "fn f() {", "python": "def f():", "javascript": "function f() {", "typescript": "function f() {",
    "java": "public void f() {",
}
CLOSERS = {"python": "done = 1"}
FILLERS = {"python": "x = 1"}
DEFAULT_CLOSER, DEFAULT_FILLER = "}", "x += y;"
LINES_PER_FILE = 64

# Denser corpora for rules that need certain lines close together.  Every line
# is a template; a corpus is its lines per file and the templates of each of its languages.
DENSE_C = TEMPLATES["c"] + [
    "\tspin_lock_irqsave(&dev->lock, flags);", "\tspin_unlock_irqrestore(&dev->lock, flags);",
    "\tif (q->val)", "\tif (q == NULL)", "\tlist_for_each_entry_rcu(p->next)", "\tp->next = NULL;",
    "\tmutex_lock(dev_mtx);", "\tmutex_unlock(dev_mtx);", "out: put_device(d);", "\treturn ret;", "\tx++;", "\ty--;",
    "\tschedule();", "\t\tgoto out;", "\tnoreturn = 1; return x;",
]
HANDLER_LINES = {
    "typescript": ["try {", "} catch (e) {", "}", "catch (e)", "{", "// ignored", "", "go();", "p.catch(() =>", "catch {};",
                   "/* ignored */", "  // noop  ", "};", "catch (e) { }", "finally {"],
    "java": ["try {", "} catch (E e) {", "}", "catch (E e)", "{", "// ignore", "", "go();", "catch(E e) {}", "};", "pass"],
    "python": ["try:", "except E:", "    pass", "except (A, B) as e:", "    go()", "", "    # pass", "finally:", "pass",
               "except:"],
    "rust": ["if let Err(e) = go() {", "match x {", "}", "_ => {}", "go();", "", "if let Err(e) = go()", "{", "// ignored"],
    "go": ["if err != nil {", "}", "if err := go(); err != nil {", "return err", "", "// noop", "go()", "if err:= f() {}"],
    "ruby": ["begin", "rescue", "rescue E => e", "end", "}", "", "pass", "go()", "rescue {", "{"],
    "php": ["try {", "catch (E $e) {", "}", "catch(E $e) {}", "go();", "", "// ignored", "{"],
}
FLOW_LINES = {
    "typescript": ["const a = req.body;", "let b2 = req.query.x + 1;", "var c_ = process.argv[2];", "exec(a);", "fetch(b2);",
                   "spawn(c_, a);", "el.innerHTML = b2", "path.join(a, c_);", "x = a + b2;", "const d = other;", "EXEC(a)",
                   "const a = location.search;", "ab = a2;", "axios.get(`${b2}`);"],
    "java": ["String a = request.getParameter(q);", "var b = System.getProperty(q);", "String c = args[0];",
             "Runtime.getRuntime().exec(a);", "Path p = Path.of(b);", "Files.readString(c);", "x = a + b;",
             "new ProcessBuilder(a, b);", "Statement.execute(c + a);", "int y = 1;", "Paths.get(ab);"],
}
SPAN_LINES = {
    "rust": ["fn f() {", "}", "if x {", "    }"] + ["x += y;"] * 96,
    "python": ["def f():", "done = 1", "    def g():", ""] + ["    x = 1"] * 96,
    "javascript": ["function f() {", "}", "const g = (x) => {", "};"] + ["x += y;"] * 96,
    "java": ["public void f() {", "}", "private int g() {", "} }"] + ["x += y;"] * 96,
}
SCRIPT_LINES = {
    "python": ["print(x)", "eval(y)", "import pdb", "import os, pdb", "obj.eval(1)", "from pdb import z", "x = 1",
               "password = 'p'", "import pdb.x", "# eval(1)", "print(eval(y))", "f(print)"],
}
DENSE = {
    "scripts": (64, SCRIPT_LINES),
    "dense_c": (64, {"c": DENSE_C}),
    "handlers": (64, HANDLER_LINES),
    "flows": (64, FLOW_LINES),
    "spans": (256, SPAN_LINES),
}
