"""Queries over an invented project: a few files of each language, as a table.

The test tables hold no source code, so these queries bring theirs. Their SQL is the rows that are
expected of them (expected.py): results that were read against the files below, not a second way to
them. Brute-force versions and positive and negative twins are in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors, dynamic, extract, graph, patterns, review, rules, scoring, similarity, taint, treesearch
from ..operators import edges as E
from ..sources import files as S
from ..sources import store
from .expected import EXPECTED

FILES = {
    "app/__init__.py": "",
    "app/main.py": '''import os
import db.store as store
from app.util import clean as tidy
from flask import request

__all__ = ["serve"]


@app.route("/admin/delete")
def serve(name, *rest, mode="r"):
    q = request.args.get("q")
    if q and name:
        store.lookup("select " + q, mode)
    return tidy(q)


def _unused(a, b):
    return os.path.join(a, b)


class Page(Base):
    def show(self):
        return self.render()
''',
    "app/util.py": '''import app.main


def clean(text):
    """Make a text clean.

    eval(text) is not done here.
    """
    return text.strip()


def main():
    clean("x")
''',
    "app/flow.py": '''from flask import request


def report():
    name = request.args.get("name")
    path = "/data/" + name
    size = int(request.args.get("size"))
    open(path)
    open(size)
    cur.execute("select ?", (name,))
    cur.execute("select " + name)
''',
    "db/store.py": '''import sqlite3
from app import util


def lookup(sql, mode):
    cur = sqlite3.connect("x").cursor()
    cur.execute(sql)
    return other(mode)


def other(mode):
    return mode
''',
    "tests/test_main.py": '''import app.main


def helper_only():
    return 1
''',
    "tools/slow.py": '''import re, abc


def scan(rows, total, kept=[]):
    text = ""
    for r in rows:
        text += "x"
        if r in rows:
            re.compile("a")
        for s in kept:
            db.execute(rows[s])
    f = open("log")
    return len(rows) / total


def fib(n):
    if n < 2:
        return n
    return fib(n - 1) + fib(n - 2)


class Shape(abc.ABC):
    @abc.abstractmethod
    def area(self):
        pass


class Square(Shape):
    pass
''',
    "tools/risky.py": '''import pickle, hashlib, subprocess
password = "hunter2hunter2"
data = pickle.loads(blob)
subprocess.run(cmd, shell=True)
digest = hashlib.md5(password.encode())
value = eval(source)
safe = "os.system(cmd) in a text"
if kind is 5:
    pass
''',
    "web/app.js": '''import { go } from './lib';
// call(1)
function draw(a, b) { el.innerHTML = a; return go(a) && this.paint('no()'); }
class View extends Base { paint(x) { if (x > 1) { return x ? 1 : 2; } } }
const add = (a, b) => a + b;
''',
    "web/lib.js": '''export function go(x) { return x; }
function draw(a, b) { el.innerHTML = a; return go(a) && this.paint('no()'); }
''',
    "src/M.java": '''import java.util.List;
public class M extends N<T> implements P, Q {
  M(int a) { super(a); }
  public int f(int a, String b) throws E { if (a > 0 && g(a)) { return new H(b).run(); } return 0; }
  void x() { Runtime.getRuntime().exec(cmd); }
}
''',
    "src/K.kt": '''import a.b.C
class K(val x: Int) : Base(1), Face {
  fun go(a: Int): Int { return call(a) }
}
''',
    "src/x.go": '''package x
import (
  "fmt"
  y "host/z"
)
type A struct {
  Base
  Name string
}
func (a *A) Run(n int) { fmt.Println(n) }
''',
    "src/y.rs": '''use std::fmt::{self};
trait Shape: Area + Debug { fn area(&self) -> f64; }
fn run(a: i32) -> i32 { helper(a); self.step(); println!("x(1)"); a }
''',
    "src/z.cpp": '''#include <stdio.h>
#define NO(x) foo(x)
class D : public B1, private ns::B2 { public: D() : a_(1) { } virtual void run() = 0; };
int Foo::bar(char *s) const { strcpy(buf, s); p->go(1); return used(s); }
static int z(void) { for (;;) { } }
''',
    ".env": "API_KEY=abcdef123456\nDEBUG=1\n",
    "requirements.txt": "flask\nnumpy==1.0\n",
    "README.md": "A web server\nwith login over a database\n",
}


def project(spark) -> DataFrame:
    """path, class, size, fingerprint, text."""
    rows = spark.createDataFrame(sorted(FILES.items()), "path string, text string").repartition(2)
    content = F.col("text").cast("binary")
    return rows.select("path", T.file_class(F.col("path")).alias("class"), F.octet_length("text").cast("long").alias("size"), T.content_fingerprint(content, F.octet_length("text")).alias("fingerprint"), "text")


def facts(spark) -> DataFrame:
    return extract.facts(project(spark))


def edge_table(spark) -> DataFrame:
    """Import, call and base edges of the project."""
    f = facts(spark)
    imports = f.where("fact = 'import'").select(F.col("path").alias("source"), F.col("name").alias("target"), F.lit("").alias("symbol"), F.lit("import").alias("relation"))
    calls = E.resolve_calls(f.where("fact = 'call'").select(F.col("path").alias("file"), "name"), f.where("fact in ('function', 'class')").select(F.col("path").alias("file"), "name"))
    return E.normalized(imports.unionByName(calls.select("source", "target", "symbol", "relation")))


def lines(spark) -> DataFrame:
    code = project(spark).select(F.col("path").alias("file"), "text")
    return S.lines(code, "file", around=3, only=rules.near_literals(), python=F.col("file").endswith(".py")).withColumn("language", rules.language(F.col("file")))


def all_findings(spark) -> DataFrame:
    security = rules.findings(lines(spark)).select(F.col("file").alias("path"), "line", "type", "severity")
    others = detectors.detect(project(spark)).select("path", F.col("line").cast("int").alias("line"), "type", "severity")
    return security.unionByName(others).distinct()


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, d, f=f: f(spark)
    return f


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return f"[{', '.join(map(literal, v))}]" if v else "[]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """The SQL of expected rows; columns: name type, ... as DuckDB has them."""
    names = [c.split(" ", 1) for c in columns.split(", ")]
    select = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in names)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {select} FROM (VALUES {body}) t({', '.join(f'"{n}"' for n, _ in names)})"


@query
def code_facts(spark):
    return facts(spark).where("fact not in ('alias', 'string')")


@query
def code_aliases(spark):
    return facts(spark).where("fact = 'alias'").select("path", "name", "detail")


@query
def code_symbols(spark):
    return extract.symbols(facts(spark)).select("path", F.array_join("symbols", ",").alias("symbols"))


@query
def code_parameters(spark):
    return extract.parameters(facts(spark)).where("path like 'app/%' or path like 'src/%'")


@query
def code_dependencies(spark):
    modules = project(spark).where("path like '%.py'").select(T.module_name(F.col("path")).alias("module"))
    return extract.dependencies(facts(spark), modules)


@query
def code_references(spark):
    tried = project(spark).crossJoin(F.broadcast(spark.createDataFrame([("app.main",), ("go",)], "target string")))
    return extract.verified(tried.where("class = 'tree'").select("path", "text", "target")).where("refers").select("path", "target")


@query
def code_rules(spark):
    return rules.findings(lines(spark)).select("file", "line", "type", "severity")


@query
def code_file_rules(spark):
    return rules.file_findings(lines(spark))


@query
def code_scopes(spark):
    return rules.scoped(all_findings(spark), "path")


@query
def code_suggestions(spark):
    return rules.suggestions(rules.findings(lines(spark)))


@query
def code_detectors(spark):
    return detectors.detect(project(spark))


@query
def code_family_scores(spark):
    """Scores of performance and logic findings under their own points and grades."""
    found = detectors.detect(project(spark))
    one = lambda family, grades: rules.risk(found.where(F.col("family") == family), rules.OTHER_POINTS, grades).select(F.lit(family).alias("family"), "score", "grade")
    return one("performance", rules.PERFORMANCE_GRADES).unionAll(one("logic", rules.LOGIC_GRADES))


@query
def code_smell_counts(spark):
    return detectors.detect(project(spark)).where("family = 'smell'").groupBy("type").agg(F.count("*").alias("n"))


@query
def code_patterns(spark):
    return patterns.scan(project(spark))


@query
def code_pattern_search(spark):
    return patterns.search(project(spark), "$F($X, shell=True)").unionAll(patterns.search(project(spark), "$M.execute($Q)"))


@query
def code_taint(spark):
    return taint.in_file(project(spark)).select("path", "line", "type", "severity")


@query
def code_cross_taint(spark):
    return taint.cross_file(project(spark))


@query
def code_dead(spark):
    f = facts(spark)
    return E.unused(f, f)


@query
def code_dead_confirmed(spark):
    f = facts(spark)
    return dynamic.confirmed_dead(E.unused(f, f).where("path like '%.py'"), project(spark)).select("path", "name", "mentions")


@query
def code_coupling(spark):
    reports = spark.createDataFrame([("app/main.py", "db.store"), ("app/main.py", "tools.slow")], "source string, target string")
    return dynamic.confirmed_coupling(reports, facts(spark))


@query
def code_cycles(spark):
    return graph.import_cycles(edge_table(spark), project(spark))


@query
def code_impact(spark):
    return graph.file_impact(edge_table(spark), project(spark), "db/store.py")[0]


@query
def code_impact_symbols(spark):
    return graph.file_impact(edge_table(spark), project(spark), "db/store.py", 3, "lookup")[1]


@query
def code_call_graph(spark):
    return E.call_graph(edge_table(spark), project(spark))[1]


@query
def code_mermaid(spark):
    return E.mermaid(*E.call_graph(edge_table(spark), project(spark)))


@query
def code_core(spark):
    return E.core(edge_table(spark), project(spark))


@query
def code_referring(spark):
    return E.referring(edge_table(spark), project(spark).where("path = 'app/util.py'"))


@query
def code_module_files(spark):
    modules = spark.createDataFrame([("app.main",), ("app",), ("web.lib",), ("no.such",)], "module string")
    return E.candidates(modules, project(spark))


@query
def code_brief(spark):
    b = review.brief(project(spark), edge_table(spark), extract.symbols(facts(spark)))
    return b.select("path", "class", "size", *[F.array_join(c, ",").alias(c) for c in ("out", "inn", "symbols")], "summary")


@query
def code_state(spark):
    session = spark.createDataFrame([(3, 2)], "round int, reports int")
    return review.state(edge_table(spark), session, project(spark))


@query
def code_deep_scan(spark):
    d = review.deep_scan(project(spark), edge_table(spark), all_findings(spark))
    return d.select("path", "n_in", "n_out", "hub", "findings", "worst", F.array_join("top", ",").alias("top"))


@query
def code_bridges(spark):
    return review.core_bridges(project(spark), edge_table(spark))


@query
def code_triage(spark):
    p = project(spark)
    tripped = spark.createDataFrame([("web/lib.js",)], "path string")
    versions = p.select("path", F.when(F.col("path") == "app/util.py", "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return review.triage(p, edge_table(spark), tripped, versions)


@query
def code_project_report(spark):
    f, p = facts(spark), project(spark)
    modules = p.where("path like '%.py'").select(T.module_name(F.col("path")).alias("module"))
    r = review.project_report(p, f, all_findings(spark), extract.dependencies(f, modules))
    return r.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in r.dtypes])


@query
def code_abilities(spark):
    return review.abilities(project(spark))


@query
def code_focus(spark):
    reports = spark.createDataFrame([(1, "Login page is slow and times out"), (2, "nothing here"), (3, None)], "id int, text string")
    tagged = reports.withColumn("symptoms", review.tags(F.col("text"), review.SYMPTOMS))
    return tagged.select("id", F.array_join("symptoms", ",").alias("symptoms"), F.array_join(review.focus(F.col("symptoms"), review.SYMPTOM_FOCUS), ",").alias("focus"))


@query
def code_marked(spark):
    return review.marked(rules.findings(lines(spark)), ["xss", "command-injection"]).where("focused").select("file", "line", "type")


@query
def code_functions_alike(spark):
    return similarity.function_pairs(extract.bodies(project(spark)), 0.8, 30)


@query
def code_docstrings(spark):
    py = lines(spark).where("language = 'py'").select("file", "line", "code")
    return extract.docstring_lines(py).where("quoted").select("file", "line")


@query
def code_in_string(spark):
    at = F.locate("os.system", F.col("code"))
    return lines(spark).where(F.col("code").contains("os.system")).select("file", "line", extract.in_string(F.col("code"), at).alias("quoted"))


@query
def code_loops(spark):
    js = spark.createDataFrame([("a.js", "function f() {\n  for (;;) {\n    while (x) {\n      y();\n    }\n  }\n}")], "file string, text string")
    return extract.loops(extract.brace_depth(S.lines(js, "file")))


@query
def code_gate(spark):
    s = spark.createDataFrame([(1, "x = 1 + 1"), (2, "import socket"), (3, "eval('1')"), (4, "x.__class__"), (5, "def ("), (6, "import math\nmath.sqrt(2)"), (7, "open('f')"), (8, None)], "id int, code string")
    return dynamic.gate(s).withColumn("restricted", F.lit(False)).unionAll(dynamic.gate(s.where("id in (2, 6)"), True).withColumn("restricted", F.lit(True)))


@query
def code_levels(spark):
    runs = spark.createDataFrame([("python", "auto"), ("javascript", "auto"), ("python", "subprocess")], "language string, asked string")
    return runs.withColumn("level", dynamic.level(F.col("language"), F.col("asked")))


@query
def code_inputs(spark):
    p = extract.parameters(facts(spark)).where("path = 'db/store.py'")
    return dynamic.input_plan(spark, p).groupBy("path", "name").agg(F.count("*").alias("inputs"), F.count_if(F.col("place") >= 30).alias("own"))


@query
def code_assignments(spark):
    return extract.per_file(project(spark).where("path in ('app/main.py', 'tools/risky.py')"), taint.assignments, "path string, variable string, line long, origin string")


@query
def code_index(spark):
    """An index with an entry too many and others too few, brought up to date."""
    p, symbols = project(spark), extract.symbols(facts(spark))
    old = store.index_entries(p.where("path like 'app/%'"), symbols).unionByName(spark.createDataFrame([("gone.py", [], [])], store.INDEX))
    return store.refresh_index(old, p, symbols).select("path", F.array_join("symbols", ",").alias("symbols"), (F.size("grams") > 0).alias("has_grams"))


@query
def code_files(spark):
    return project(spark).select("path", "class", "size", "fingerprint")


@query
def code_ignored(spark):
    patterns = ["*.md", "src/*.go", "**/util.py", "tools", "#web", "app/*/x"]
    return project(spark).where(T.ignored(F.col("path"), patterns)).select("path")


@query
def code_bodies(spark):
    return extract.bodies(project(spark)).select("path", "name", "first", "last")


@query
def code_resolved_calls(spark):
    return edge_table(spark).where("relation = 'call'").select("source", "target", "symbol")


@query
def code_module_edges(spark):
    return E.to_files(edge_table(spark).where("relation = 'import'"), project(spark)).where("source like 'app/%' or source like 'db/%'").select("source", "target").distinct()


@query
def code_dead_ratio(spark):
    f = facts(spark)
    defined = f.where("fact in ('function', 'class')").select("path", "fact", "name", "line")
    return scoring.dead_ratio(defined.join(E.unused(f, f), ["path", "fact", "name", "line"], "left"))


@query
def code_health(spark):
    """Health by smells a thousand lines of Python, and by layers."""
    smells = detectors.detect(project(spark)).where("family = 'smell'").agg(F.coalesce(F.sum(F.when(F.col("severity") == "high", 8.0).when(F.col("severity") == "medium", 3.0).otherwise(1.0)), F.lit(0.0)).alias("points"))
    size = project(spark).where("path like '%.py'").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))
    clear = scoring.clear_layers(project(spark).where("class = 'tree'").select("path"))
    row = smells.join(F.broadcast(size)).join(F.broadcast(clear))
    return row.select("lines", "layers", "clear", F.round(scoring.smell_health(F.col("points"), F.col("lines")), 4).alias("smells"), scoring.structure_health(F.col("clear"), F.col("layers")).alias("structure"))


@query
def code_hours(spark):
    return scoring.debt_hours(detectors.detect(project(spark)), ["path"]).withColumn("hours", F.round("hours", 4))


@query
def code_deduplicated(spark):
    """Findings of the rules and of taint, one for each line and type, those with evidence first."""
    code = rules.findings(lines(spark)).select(F.col("file").alias("path"), F.col("line").cast("long").alias("line"), "type", "severity", F.lit(None).cast("string").alias("evidence"))
    both = code.unionByName(taint.cross_file(project(spark))).unionByName(taint.in_file(project(spark))).withColumn("code", F.lit(""))
    return rules.deduplicated(both, "path").where("path like 'app/%' or path like 'db/%'").select("path", "line", "type", "evidence")


@query
def code_report_json(spark):
    return store.to_json(QUERIES["code_project_report"](spark, "").select("files", "lines", "functions", "third_party"))


@query
def code_brief_text(spark):
    b = review.brief(project(spark), edge_table(spark), extract.symbols(facts(spark))).where("path like 'web/%' or class = 'weed'")
    return review.text(b.select("path", "symbols", "summary"), ["path"])


@query
def code_liveness(spark):
    e = E.to_files(edge_table(spark), project(spark)).withColumn("verified", F.col("source") != "db/store.py")
    return E.liveness(e, project(spark).select(F.col("path").alias("file"))).where("source like 'app/%' or source like 'db/%'").select("source", "target", "state").distinct()


@query
def code_new_edges(spark):
    """Edges that are inserted where they are absent."""
    e = edge_table(spark)
    more = E.normalized(spark.createDataFrame([("app/main.py", "flask"), ("app/main.py", "new"), ("app/main.py", "new")], "source string, target string"))
    return E.insert_absent(e, more).where("source = 'app/main.py' and relation = 'import'").select("source", "target")


@query
def code_paths(spark):
    """What is said of a path: test or not, of security's core or not."""
    paths = spark.createDataFrame([("tests/a.py",), ("lib/auth_x.py",), ("a/shell/b.js",), ("a/test_b.py",), ("a/b.test.js",), ("a/plain.py",), (None,)], "path string")
    return paths.select("path", rules.is_test(F.col("path")).alias("test"), rules.is_security_core(F.col("path")).alias("core"))


def search_tree(spark) -> DataFrame:
    rows = [(1, None, 0, 1, "expanded", False, None, "root"), (2, 1, 1, 2, "expanded", False, 0.5, "one"), (3, 1, 1, 3, "open", True, 0.9, "two"), (4, 2, 2, 4, "dead_end", False, 0.2, "three"), (5, 2, 2, 5, "scored", False, 0.8, "four"), (6, 5, 3, 6, "open", False, None, "five")]
    return spark.createDataFrame(rows, "id long, parent long, depth int, seq long, status string, pruned boolean, total double, text string")


@query
def tree_backtrack(spark):
    start = lambda i: spark.createDataFrame([(i,)], "id long")
    one = lambda i: graph.backtrack(search_tree(spark), start(i)).select(F.lit(i).cast("long").alias("at"), "id", "up")
    return one(4).unionAll(one(6)).unionAll(one(5))


@query
def tree_dead(spark):
    return treesearch.dead(search_tree(spark), spark.createDataFrame([(2,)], "id long")).select("id", "status")


@query
def tree_text(spark):
    return treesearch.render(search_tree(spark))


@query
def tree_similarity(spark):
    pairs = spark.createDataFrame([("a cat sat", "a cat sat"), ("abab", "ab"), ("night", "nacht"), ("", "x"), ("A  B c", "a b C")], "a string, b string")
    return pairs.select("a", "b", F.round(treesearch.mixed_similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


@query
def tree_converged(spark):
    older = spark.createDataFrame([(1, 1, "the sky is blue today"), (2, 3, "cats sleep all day")], "layer int, id int, text string")
    newer = spark.createDataFrame([(1, 2, "the sky is blue today!"), (2, 4, "cats sleep all day"), (2, 5, "something else entirely"), (3, 6, "alone")], "layer int, id int, text string")
    return treesearch.converged(newer, older, by="layer").select("layer", "nodes", "alike", "converged")


ORACLES = {name: values(*EXPECTED[name]) for name in QUERIES if name in EXPECTED}
