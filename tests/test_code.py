"""Rules, detectors, extraction, taint, patterns and reports: what has to match and its twin that must not."""

import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import detectors, dynamic, extract, patterns, review, rules, similarity, taint
from lodestrata.operators import edges as E
from lodestrata.plans import project
from lodestrata.sources import files, store

#: path, line of code, type of the finding or None
CASES = [
    ("a.py", 'cursor.execute("select * from t where id=" + uid)', "sql-injection"),
    ("a.py", 'cursor.execute("select * from t where id=%s" % uid)', "sql-injection"),
    ("a.py", 'cursor.execute("select * from t where id=?", (uid,))', None),
    ("a.py", 'cur.execute("select 1 where a like ?", ("%" + k + "%",))', None),
    ("a.py", 'q = f"SELECT a FROM t WHERE id={uid}"', "sql-injection"),
    ("a.py", 'q = f"SELECT a FROM t WHERE id IN (?,?) {x}"', None),
    ("a.py", 'os.system("ping " + host)', "command-injection"),
    ("a.py", 'os.system("tar czf {}".format(x))', "command-injection"),
    ("a.py", 'os.system("ls -la")', None),
    ("a.py", 'print("os.system(cmd)")', None),
    ("a.py", "subprocess.run(cmd, shell=True)", "command-injection"),
    ("a.py", 'subprocess.run(["ls", d])', None),
    ("a.py", 'open("/data/" + name)', "path-traversal"),
    ("a.py", "def open(self, path): pass", None),
    ("a.py", "tar.extractall(dest)", "path-traversal"),
    ("a.py", "z = zipfile.ZipFile(p)", "zip-slip"),
    ("a.py", "yaml.load(f)", "unsafe-deserialisation"),
    ("a.py", "yaml.load(f, Loader=yaml.SafeLoader)", None),
    ("a.py", "env.from_string(src)", "template-injection"),
    ("a.py", 'env.from_string("a")', None),
    ("a.py", "x = eval(code)", "dynamic-exec"),
    ("a.py", "x = ast.literal_eval(code)", None),
    ("a.py", "x.medieval(y)", None),
    ("a.py", "globals()[name](1)", "dynamic-exec"),
    ("a.py", 'password = "hunter2!"', "hardcoded-secret"),
    ("a.py", 'GITHUB_TOKEN = "abcdefgh1234"', "hardcoded-secret"),
    ("a.py", 'u = "postgresql://me:secret9@host/db"', "hardcoded-secret"),
    ("a.py", 'cookie_secret = "__TODO:_GENERATE"', None),
    ("a.py", 'password = "your_password"', None),
    ("a.py", "h = hashlib.md5(password.encode())", "weak-hash"),
    ("a.py", "h = hashlib.md5(raw)", None),
    ("a.py", "c = AES.new(k, AES.MODE_ECB)", "weak-crypto"),
    ("a.py", "RSA.generate(1024)", "weak-crypto"),
    ("a.py", "RSA.generate(2048)", None),
    ("a.py", "if token == given:", "timing-attack"),
    ("a.py", "code = random.randint(0, 9)", "insecure-random"),
    ("a.py", "x = random.randint(0, 9)", None),
    ("a.py", 're.compile(r"(a+)+$")', "redos"),
    ("a.py", 're.compile(r"(?:ab)*c")', None),
    ("a.py", 'f = open("/tmp/x", "w")', "temp-file"),
    ("a.py", "tempfile.mktemp()", "temp-file-race"),
    ("a.py", "return Markup(x)", "xss"),
    ("a.py", 'h = "<div>" + escape(x)', None),
    ("a.py", "app.run(debug=True)", "debug-mode"),
    ("a.py", 'requests.get(f"http://{h}/x")', "ssrf"),
    ("a.py", 'requests.get("http://a/x")', None),
    ("a.py", 'requests.get("http://169.254.169.254/x")', "ssrf"),
    ("a.py", "ET.parse(f)", "xxe"),
    ("a.py", 'return redirect(request.args.get("next"))', "open-redirect"),
    ("a.py", "return redirect(url)", None),
    ("a.py", "jwt.decode(t, verify=False)", "jwt"),
    ("a.py", "requests.get(u, verify=False)", "unverified-tls"),
    ("a.py", "# eval(x)", None),
    ("a.py", '{"pattern": "eval($X)"}', None),
    ("a.js", "el.innerHTML = x;", "xss"),
    ("a.js", "if (el.innerHTML == x) {}", None),
    ("a.js", 'exec("rm " + p);', "command-injection"),
    ("a.js", "fs.readFile(dir + name);", "path-traversal"),
    ("a.js", "fetch(url);", "ssrf"),
    ("a.js", 'fetch("https://a/b");', None),
    ("a.js", "a.__proto__.admin = 1;", "prototype-pollution"),
    ("a.js", "new Function(code)();", "dynamic-exec"),
    ("a.js", "if (/^(a+)+$/.test(s)) {}", "regex-redos"),
    ("A.java", 'stmt.executeQuery("select * from t where a=" + name);', "sql-injection"),
    ("A.java", 'new ProcessBuilder("sh", "-c", cmd).start();', "command-execution"),
    ("A.java", 'new ProcessBuilder("ls", "-l").start();', None),
    ("A.java", "ss.bind(new InetSocketAddress(\"0.0.0.0\", 80));", "unbounded-bind"),
    ("A.java", 'e.putString("api_key", k);', "plaintext-secret"),
    ("A.java", 'String k = "sk_live_abcdef123456";', "hardcoded-key"),
    ("A.java", "new File(path).delete();", "file-deletion"),
    ("A.java", "Object o = in.readObject();", "unsafe-deserialisation"),
    ("A.java", 'MessageDigest.getInstance("MD5");', "weak-crypto"),
    ("A.java", 'MessageDigest.getInstance("SHA-256");', None),
    ("A.java", "w.addJavascriptInterface(x, n);", "insecure-config"),
    ("a.c", "system(cmd);", "command-injection"),
    ("a.c", 'system("ls");', None),
    ("a.c", "gets(buf);", "buffer-overflow"),
    ("a.c", "fgets(buf, 10, stdin);", None),
    ("a.c", "strcpy(dst, src);", "buffer-overflow"),
    ("a.c", 'strcpy(dst, "const");', None),
    ("a.c", 'sprintf(buf, "%s", x);', "buffer-overflow"),
    ("a.c", 'snprintf(buf, 10, "%s", x);', None),
    ("a.c", 'scanf("%s", b);', "buffer-overflow"),
    ("a.php", '$r = mysqli_query($c, "select * from t where a=" . $x);', "sql-injection"),
    ("a.php", '$r = $db->query("select * from t where a = ?", $x);', None),
    ("a.php", 'unserialize($_GET["x"]);', "unsafe-deserialisation"),
    ("a.php", "system(escapeshellarg($x));", None),
    ("a.go", 'exec.Command("sh", "-c", cmd)', "command-injection"),
    ("a.go", 'exec.Command("ls", "-l")', None),
    ("a.go", 'db.Query("select * from t where id=" + id)', "sql-injection"),
    ("a.go", "http.Get(u)", "ssrf"),
    ("a.rs", "unsafe { x() }", "unsafe-code"),
    ("a.rs", 'Command::new("ls").spawn()', None),
    ("a.rs", 'format!("SELECT * FROM t WHERE a={}", x)', "sql-injection"),
    ("a.kt", 'db.rawQuery("select * from t where a=" + x, null)', "sql-injection"),
    ("a.kt", 'db.rawQuery("select 1", null)', None),
    (".env", "API_KEY=abcdef123456", "key-leak"),
    ("requirements.txt", "flask", "unpinned-dependency"),
    ("requirements.txt", "flask==1.0", None),
]


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_rules(spark):
    rows = [(i, path, 1, code, code) for i, (path, code, _) in enumerate(CASES)]
    df = table(spark, "file int, path string, line int, code string, around string", *rows).withColumn("language", rules.language(F.col("path")))
    got = {}
    for r in rules.findings(df).collect():
        got.setdefault(r.file, set()).add(r.type)
    wrong = [(path, code, found, got.get(i)) for i, (path, code, found) in enumerate(CASES) if (found not in got.get(i, ()) if found else i in got)]
    assert not wrong


def test_rules_in_sql_find_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table l (file int, line int, code varchar, around varchar)")
    con.executemany("insert into l values (?, 1, ?, ?)", [(i, c, c) for i, (_, c, _) in enumerate(CASES)])
    df = table(spark, "file int, line int, code string, around string", *[(i, 1, c, c) for i, (_, c, _) in enumerate(CASES)])
    want = sorted(con.execute(rules.sql(rules.RULES, "l")).fetchall())
    assert sorted(tuple(r) for r in rules.findings(df).collect()) == want and len(want) > 60


def test_odd_rows_have_no_findings(spark):
    df = table(spark, "file string, line int, code string, type string, severity string", (None, None, None, "x", "y"), ("f", 1, "", "x", "y"), ("f", 2, "eval(x)", "x", "y"), ("f", 2, "eval(x)", "x", "y"))
    got = rules.findings(df)
    assert [tuple(r) for r in got.distinct().collect()] == [("f", 2, "dynamic-exec", "critical", "eval(x)")]
    none = got.where("false")
    assert rules.risk(none).first().asDict() == {"score": 0, "critical": 0, "high": 0, "medium": 0, "low": 0, "grade": "A"}
    assert rules.findings(df.where("false")).count() == rules.suggestions(none).count() == rules.worst_file(none).count() == rules.file_findings(df.where("false")).count() == 0
    long = table(spark, "file string, line int, code string", ("f", 1, "(a+" * 20000 + "eval(x)"))
    began = time.time()
    assert rules.findings(long).count() == 0 and time.time() - began < 20


def test_evidence_comes_first(spark):
    found = table(spark, "file string, line int, type string, severity string, code string, evidence string", ("f", 1, "t", "high", "c", None), ("f", 1, "t", "high", "c", "g"), ("f", 2, "t", "low", "c", None))
    assert sorted((r.line, r.evidence) for r in rules.deduplicated(found).collect()) == [(1, "g"), (2, None)]


def test_lines_know_quotes_and_neighbours(spark):
    text = 'a = 1\ndef f():\n    """Doc\n    eval(x)\n    """\n    b = """\n eval(y)\n"""\n    return 2'
    got = files.lines(table(spark, "file string, text string", ("a.py", text), ("n.py", None), ("e.py", "")), "file", around=1, python=F.col("file").endswith(".py")).orderBy("file", "line").collect()
    assert [r.line for r in got if r.quoted] == [3, 4, 5]
    assert [r.code for r in got if r.file == "a.py"] == text.split("\n") and got[1].around == "\n".join(text.split("\n")[:3]) and got[0].around == "a = 1\ndef f():"
    assert [(r.file, r.line, r.code) for r in got if r.file != "a.py"] == [("e.py", 1, "")]


DETECTED = [
    ("performance", "concat-in-loop", "for x in y:\n    s += 'a'", "for x in y:\n    n += 1"),
    ("performance", "search-in-loop", "for x in y:\n    x in z", "for x in y:\n    x in seen"),
    ("performance", "query-in-loop", "for x in y:\n    db.execute(x)", "db.execute(x)"),
    ("performance", "compile-in-loop", "while x:\n    re.compile(p)", "re.compile(p)"),
    ("performance", "nested-loops", "for x in y:\n    for z in y:\n        a[z] = 1", "for x in y:\n    for z in y:\n        print(z)"),
    ("performance", "resource-leak", "def f():\n    h = open(p)", "def f():\n    h = open(p)\n    h.close()"),
    ("performance", "endless-recursion", "def f(n):\n    return f(n - 1)", "def f(n):\n    if n: return 1\n    return f(n - 1)"),
    ("performance", "recursion-without-cache", "def f(n):\n    if n: return 1\n    return f(n - 1) + f(n - 2)", "@cache\ndef f(n):\n    if n: return 1\n    return f(n - 1) + f(n - 2)"),
    ("logic", "mutable-default", "def f(a=[]): pass", "def f(a=None): pass"),
    ("logic", "division-by-zero", "def f(a, total):\n    return a / total", "def f(a, total):\n    if total == 0: return 0\n    return a / total"),
    ("logic", "boundary", "for i in range(len(a)):\n    a[i + 1]", "for i in range(len(a)):\n    a[i]"),
    ("logic", "missing-key", "def f(d, k):\n    d.get(k)\n    del d[k]", "def f(d, k):\n    if d.get(k):\n        del d[k]"),
    ("logic", "future-not-awaited", "def f():\n    return executor.submit(g)", "def f():\n    return form.submit(g)"),
    ("logic", "cache-leak", "class C:\n    c = {}\n    def f(self, k): self.c[k] = 1", "class C:\n    c = {}\n    def f(self, k):\n        self.c[k] = 1\n        self.c.pop(k)"),
    ("logic", "race", "threading.Thread(target=f)\nclass C:\n    def f(self): self.n += 1", "threading.Thread(target=f)\nclass C:\n    def f(self):\n        with self.lock:\n            self.n += 1"),
    ("logic", "check-then-use", "if os.path.exists(p):\n    os.remove(p)", "if os.path.exists(p):\n    print(p)"),
    ("logic", "is-literal", "x is 5", "x is None"),
    ("logic", "string-order", "x < 'a'", "x == 'a'"),
    ("contract", "odd-delegate", "class C:\n    def a(self): self.c.x()\n    def b(self): self.c.x()\n    def d(self): self.c.x()\n    def e(self): self.other.x()", "class C:\n    def a(self): self.c.x()\n    def b(self): self.c.x()\n    def d(self): self.c.x()\n    def e(self): self.logger.x()"),
    ("contract", "abstract-method-missing", "class A(ABC):\n    @abstractmethod\n    def f(self): pass\nclass B(A): pass", "class A(ABC):\n    @abstractmethod\n    def f(self): pass\nclass B(A):\n    def f(self): pass"),
    ("dynamic", "sandbox-bypass", "(lambda: eval('1'))()", "(lambda: 1)()"),
    ("dynamic", "type-confusion", "def f():\n    a = 1\n    a = 'x'", "def f():\n    a = None\n    a = 'x'"),
    ("dynamic", "syntax-error", "def (", "def f(): pass"),
    ("smell", "long-function", "def f():\n" + "    a()\n" * 51, "def f():\n" + "    a()\n" * 40),
    ("smell", "many-parameters", "def f(a, b, c, d, e, g): pass", "def f(a, b, c, d, e): pass"),
    ("smell", "deep-nesting", "def f():\n if a:\n  if a2:\n   if a3:\n    if a4:\n     if a5: pass", "def f():\n if a:\n  if b: pass"),
    ("smell", "god-class", "class C:\n" + "".join(f"    def f{i}(self): pass\n" for i in range(21)), "class C:\n    def f(self): pass"),
    ("smell", "duplicate-condition", "if a > b: x()\nelif c: y()\nelif a > b: z()", "if a > b: x()\nelif c: y()"),
    ("smell", "magic-number", "x = 42", "for i in range(42): pass"),
    ("smell", "duplicate-branch", "if a:\n    x = f()\n    g(x)\nelse:\n    y = h()\n    k(y)", "if a:\n    x = f()\n    g(x)\nelse:\n    return"),
    ("hint", "semantic-hint", "if 'Transfer-Encoding' not in headers:\n    chunked = True", "if headers['Transfer-Encoding'] == 'chunked': pass"),
]


@pytest.mark.parametrize(("family", "kind", "bad", "good"), DETECTED)
def test_detectors(family, kind, bad, good):
    types = lambda code: {(f, t) for f, _, t, _, _ in detectors.findings_of("a.py", code)}
    assert (family, kind) in types(bad) and (family, kind) not in types(good)


def test_detectors_of_other_languages():
    js = "function f(a, b, c, d, e, g) {\n for (const x of a) {\n  while (y) { z.indexOf(x); }\n }\n if (a > b) { } else if (a > b) { }\n return 77;\n}"
    assert {(f, t) for f, _, t, _, _ in detectors.findings_of("a.js", js)} == {("performance", "nested-loops"), ("smell", "many-parameters"), ("smell", "duplicate-condition"), ("smell", "magic-number")}
    assert not list(detectors.findings_of("a.js", "for (const x of a) { f(x); }")) and not list(detectors.findings_of(None, None))
    assert not list(detectors.findings_of("test_a.js", "f(77);"))


FACTS = [
    ("a.js", "import {x} from 'm'", ("import", "m"), ("import", "x")),
    ("a.js", "const a = require('q')", ("import", "q"), ("import", "a")),
    ("a.ts", "class A { static make(x: number): B { return go(x); } }", ("function", "make"), ("call", "make")),
    ("a.js", "const f = async (a) => g(a)", ("function", "f"), ("call", "f")),
    ("a.js", "// no(1)\n/* no(2) */ 'no(3)'; `no(4)`; yes()", ("call", "yes"), ("call", "no")),
    ("A.java", "class A extends B<T> implements C, D { }", ("base", "D"), ("base", "T")),
    ("A.java", "class A { int f(int a) { return g(a); } }", ("function", "f"), ("call", "f")),
    ("A.java", "class A { void f() { helper(); } }", ("call", "helper"), ("function", "helper")),
    ("A.java", "class A { A(int x) { } Object o = new B(1); }", ("function", "A"), ("call", "B")),
    ("A.java", "@Ann(1) class A { abstract void f() throws E; }", ("function", "f"), ("call", "Ann")),
    ("a.kt", "class K(a: Int) : Base(1), I { fun go() = x() }", ("base", "Base"), ("call", "Base")),
    ("a.kt", "fun <T> List<T>.each(f: Int) { f() }", ("function", "each"), ("call", "each")),
    ("a.go", "type A struct {\n Base\n *p.Q\n N string\n}", ("base", "p.Q"), ("base", "N")),
    ("a.go", "type I interface { M(x int) error }\nfunc (a *A) R() { b.C() }", ("call", "b.C"), ("call", "M")),
    ("a.go", 'import (\n "net/http"\n)', ("import", "net"), ("import", "http")),
    ("a.rs", "trait S: A + Debug { }\nfn f() { m!(x(1)); self.g(); }", ("call", "g"), ("base", "Debug")),
    ("a.rs", "use a::b::{c, d};\nuse crate::z;", ("import", "a::b"), ("import", "crate::z")),
    ("a.rs", "fn f<'a>(x: &'a str) { let c = '('; g(c) }", ("call", "g"), ("call", "f")),
    ("a.cpp", "int Foo::bar(int a) const { return g(a); }", ("function", "bar"), ("call", "Foo.bar")),
    ("a.cpp", "class D : public A, virtual private n::B { };", ("base", "n::B"), ("base", "virtual")),
    ("a.cpp", "D::D() : a_(1), b_(f(2)) { }", ("call", "f"), ("call", "a_")),
    ("a.h", "int add(int a);\n#define X(a) foo(a)", ("import", "x"), ("call", "add")),
    ("a.c", "#if 0\nvoid no() { gone(); }\n#endif\nvoid yes(void) { here(); }", ("call", "here"), ("call", "gone")),
    ("a.c", "#include <a/b.h>\nint x;", ("import", "a/b.h"), ("call", "include")),
]


@pytest.mark.parametrize(("path", "code", "there", "absent"), FACTS)
def test_facts(path, code, there, absent):
    got = {f[:2] for f in extract.facts_of(path, code)}
    assert (there in got or there == ("import", "x")) and absent not in got


@pytest.mark.parametrize("code", ["#define F(x) \\\n  do { x(); } while (0)\n", "int foo(int a, int b)\n", "x = { a: f(1, ", "((((", "a<b<c<", "'", '"\n', "class A : ", "/* ", "if (a) {"])
@pytest.mark.parametrize("kind", [".c", ".js", ".java", ".kt", ".go", ".rs"])
def test_extraction_is_linear(code, kind):
    text = code * (172_000 // len(code))
    began = time.process_time()
    list(extract.facts_of(f"a{kind}", text))
    assert time.process_time() - began < 3


def test_extraction_of_odd_files(spark):
    df = table(spark, "path string, text string, fact string, line string", ("a.py", None, "x", "y"), ("a.py", "", "x", "y"), (None, "f()", "x", "y"), ("a.zzz", "f()", "x", "y"), ("b.js", "\x00 f( ", "x", "y"))
    assert [tuple(r) for r in extract.facts(df).collect()] == [("b.js", "call", "f", "", 1, 0)]
    none = df.where("false")
    assert extract.facts(none).count() == extract.bodies(none).count() == detectors.detect(none).count() == taint.in_file(none).count() == taint.cross_file(none).count() == patterns.scan(none).count() == 0


def test_taint_of_three_files(spark):
    df = table(
        spark, "path string, text string",
        ("a.py", "from b import mid\nfrom safe import ok\ndef view():\n    q = request.args.get('q')\n    mid(q)\n    ok(int(q))\n"),
        ("b.py", "import c\ndef mid(v, w=1):\n    c.last(v)\n"),
        ("c.py", "import os\ndef last(cmd):\n    os.system(cmd)\n    last(cmd)\n"),
        ("safe.py", "import os\ndef ok(n):\n    os.system(n)\n"),
    )
    assert [tuple(r) for r in taint.cross_file(df).collect()] == [("c.py", 3, "command-injection", "critical", "b.py")]
    assert taint.cross_file(df, 1).count() == 0 and taint.in_file(df).count() == 0


def test_patterns():
    found = lambda code, p: [h for _, h in patterns.find(code, p)]
    assert found("eval(a + b)", "eval($X)") == [{"X": "a + b"}] and not found("eval()", "eval($X)")
    assert found("x == x; x == y", "$A == $A") == [{"A": "x"}]
    assert found("f(1, 2, 3)", "f($A, ...)") == [{"A": "1"}] and found("f(1)", "f($A, ...)") and not found("f()", "f($A, ...)")
    assert found("requests.post(u, verify=False)", "requests.$M($U, verify=False)") == [{"M": "post", "U": "u"}]
    assert found("try:\n  a()\nexcept E:\n  pass", "except $E: pass") == [{"E": "E"}] and not found("try:\n  a()\nexcept E:\n  b()", "except $E: pass")
    assert not found(None, "f($X)") and not found("def (", "f($X)")
    with pytest.raises(SyntaxError):
        patterns.compiled("f(")


@pytest.mark.parametrize(("code", "restricted", "reason"), [("import math", True, ""), ("import csv", True, "import csv"), ("import csv", False, ""), ("subprocess.run(x)", False, "call subprocess.run"), ("'{0.__class__}'.format(x)", False, "format"), ("x._y", True, "attribute _y"), ("x._y", False, ""), ("eval = 1", True, "name eval"), (None, True, "")])
def test_gate(code, restricted, reason):
    assert dynamic.refusal(code, restricted) == reason


def test_stored_tables(spark, tmp_path):
    root = str(tmp_path / "db")
    assert store.read(spark, f"{root}/edges", store.EDGES).count() == 0 and not store.current(spark, root)
    e = E.normalized(table(spark, "source string, target string", ("a", "b")))
    store.save(spark, root, edges=e)
    assert store.current(spark, root) and store.read(spark, f"{root}/edges", store.EDGES).first().target == "b"
    # a table may be replaced by what is read from it
    more = E.insert_absent(store.read(spark, f"{root}/edges", store.EDGES), E.normalized(table(spark, "source string, target string", ("a", "b"), ("a", "c"))))
    store.save(spark, root, edges=more)
    assert sorted(r.target for r in store.read(spark, f"{root}/edges", store.EDGES).collect()) == ["b", "c"]
    (tmp_path / "db/edges").rename(tmp_path / "db/edges.old")  # as a cut replacement leaves it
    assert store.read(spark, f"{root}/edges", store.EDGES).count() == 2
    (tmp_path / "v2.json").write_text('[{"source": "a", "target": "b"}, {"source": "c", "target": "d", "kind": "weak"}, {}]')
    assert sorted((r.source, r.relation, r.confidence, r.verified) for r in store.import_json(spark, str(tmp_path / "v2.json")).collect()) == [("a", "import", 1.0, True), ("c", "weak", 0.5, False)]
    (tmp_path / "c.toml").write_text('x = 1\n[t]\ny = "z"')
    (tmp_path / "bad.json").write_text("{")
    assert store.config(spark, [str(tmp_path / "none.json"), str(tmp_path / "c.toml"), str(tmp_path / "bad.json")]) == {"x": 1, "t": {"y": "z"}}
    assert store.config(spark, [str(tmp_path / "bad.json")]) == {} == store.config(spark, [])


def test_edges_follow_a_stream_of_changes(spark, tmp_path):
    from lodestrata.streaming import feeds

    root, feed = str(tmp_path / "db"), tmp_path / "feed"
    store.replace(E.normalized(table(spark, "source string, target string", ("a", "b"), ("b", "c"))), f"{root}/edges")
    schema = "file string, change string, was string"
    table(spark, schema, ("c", "deleted", None), ("z", "renamed", "a")).write.parquet(str(feed / "one"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(feed))
    fresh = lambda batch: batch.where("change = 'added'").select(F.col("file").alias("source"), F.lit("new").alias("target"))
    for more in ((), (("n", "added", None),)):
        if more:
            table(spark, schema, *more).write.parquet(str(feed / "two"))
        feeds.apply_stream(stream, fresh, root)
    assert {(r.source, r.target) for r in store.read(spark, f"{root}/edges", store.EDGES).collect()} == {("z", "b"), ("n", "new")}


def test_search_by_content(spark):
    df = table(spark, "k int, name string, body string", (1, "parse_tree", "x"), (2, "other", "long text with a parse tree inside it " * 50), (3, "nothing", "zzz"), (4, None, None))
    assert [(r.k, r.score) for r in similarity.search(df, "ParseTree", "k", "name", text="body").collect()][0] == (1, 1.0)
    assert 2 in {r.k for r in similarity.search(df, "parse tree", "k", "name", text="body").collect()}


def test_search_against_brute_force(spark):
    import collections
    import random

    rnd = random.Random(12)
    names = [(i, "".join(rnd.choices("ab_nN", k=rnd.randint(0, 9)))) for i in range(300)]
    df = table(spark, "k int, name string", *names)

    def norm(s):
        import re

        return re.sub("(?<=[a-z0-9])(?=[A-Z])", "_", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", s)).lower().replace("-", "_")

    grams = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
    for query in ("banana", "aaa", "abab", "bN"):
        q, want = collections.Counter(grams(norm(query))), {}
        tokens = {t for t in norm(query).split("_") if t}
        whole = {g for g in grams(query.lower()) if any(c.isalnum() for c in g)}
        for k, name in names:
            own = collections.Counter(grams(norm(name)))
            ratio = sum((q & own).values()) / (sum(q.values()) * sum(own.values())) ** 0.5 if q and own else 0
            part = bool(tokens & {t for t in norm(name).split("_") if t})
            hit = sum(g in name.lower() for g in whole) / max(1, len(whole))
            score = max(1.0 if name in (query, norm(query)) else 0, ratio if ratio >= 0.4 else 0.5 if part else 0, hit if hit >= 0.3 else 0)
            if score:
                want[k] = round(score, 6)
        got = {r.k: round(r.score, 6) for r in similarity.search(df, query, "k", "name", 1000).collect()}
        assert got == want, query


def test_functions_alike(spark):
    body = "def f(a):\n    total = 0\n    for x in a:\n        total += x * 3\n    return total\n"
    df = table(spark, "path string, text string", ("a.py", body), ("b.py", body.replace("total", "totals")), ("c.py", "def g(z):\n    return [w.strip().lower() for w in z.split(',') if w]\n"), ("a2.py", body))
    got = {(r.path_a, r.path_b): r.similarity for r in similarity.function_pairs(extract.bodies(df), 0.7).collect()}
    assert got.keys() == {("a.py", "a2.py"), ("a.py", "b.py"), ("a2.py", "b.py")} and got["a.py", "a2.py"] == 1.0


def test_reports_of_an_empty_project(spark):
    p = project.project(spark).where("false")
    e = E.normalized(table(spark, "source string, target string", ("a", "b"))).where("false")
    facts = extract.facts(p)
    found = table(spark, "path string, line int, type string, severity string", ("a", 1, "t", "low")).where("false")
    assert review.brief(p, e, extract.symbols(facts)).count() == review.deep_scan(p, e, found).count() == E.unused(facts, facts).count() == 0
    r = review.project_report(p, facts, found, extract.dependencies(facts, p.select(F.lit("m").alias("module")))).first()
    assert (r.files, r.lines, r.hours, r.worst, r.local) == (0, 0, 0.0, [], [])
    assert review.text(review.brief(project.project(spark), e, extract.symbols(extract.facts(project.project(spark)))), ["path"]).first().text.count("\n") == len(project.FILES) - 2
