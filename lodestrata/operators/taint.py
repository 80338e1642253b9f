"""User input on its way to dangerous calls, within files and from file to file.

Within a file, variables of each function have ranks: 1 a parameter, 2 something put together from
parameters, 3 user input. Assignments carry ranks until nothing changes, ROUNDS times at most. A call
that must not get user input, with an argument of rank 2 or more, is a finding.

Between files, calls that hand ranks of 2 or more to an imported function meet that function's
parameters in equi-joins; the files that have them are read again with these parameters as user input.
Each layer goes one call further; what a function's parameter has been seeded with once isn't seeded
again, so rows are bounded by parameters and calls, not by paths.

Cases: null and empty texts, other languages and texts that don't parse have no rows; repeated files
give their findings once; other columns are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name
from .extract import _dotted, extension, parsed
from .graph import _cut

ROUNDS, LAYERS = 10, 4
PARAMETER, MADE, USER = 1, 2, 3
FACTS = "path string, kind string, line long, name string, module string, place long, argument string, rank long, type string, severity string"

SOURCE = re.compile(r"(request|req|r|self\.request)\.(args|form|values|json|data|files|query|cookies|GET|POST)\b.*|(params|request|request\.query)\.get|self\.get_(query_|body_)?argument|input|sys\.argv")
#: type, severity and names of calls that must not get user input; ``first``: only in their first argument.
SINKS = (
    ("sql-injection", "critical", re.compile(r"(.*\.)?(execute|executemany|query|raw)"), True),
    ("command-injection", "critical", re.compile(r"os\.(system|popen)|subprocess\.(call|run|Popen|check_output|check_call)"), True),
    ("dynamic-exec", "critical", re.compile(r"eval|exec"), True),
    ("ssrf", "high", re.compile(r"(requests|httpx)\.(get|post|put|delete|head|patch)|(urllib\.request\.)?urlopen"), True),
    ("path-traversal", "high", re.compile(r"open|(flask\.)?send_file|os\.remove|shutil\.rmtree"), True),
    ("open-redirect", "medium", re.compile(r"(.*\.)?redirect"), True),
)
KEEPING = {"strip", "lstrip", "rstrip", "lower", "upper", "title", "decode", "encode", "replace", "split", "get"}
MAKING = {"format", "join"}


class Scope:
    """A function, or a module's own statements, with the ranks of its variables."""

    def __init__(self, node: ast.AST, outer: dict[str, int], seeded: frozenset[str]):
        self.ranks, self.own = dict(outer), []
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]:
                if x.arg not in ("self", "cls"):
                    self.ranks[x.arg] = USER if x.arg in seeded else PARAMETER
        todo = list(ast.iter_child_nodes(node))[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
                continue
            self.own.append(n)
            todo += list(ast.iter_child_nodes(n))[::-1]
        for _ in range(ROUNDS):
            before = dict(self.ranks)
            for n in self.own:
                self._carry(n)
            if self.ranks == before:
                break

    def _put(self, to: ast.AST, rank: int) -> None:
        if isinstance(to, ast.Tuple | ast.List):
            for x in to.elts:
                self._put(x, rank)
        elif isinstance(to, ast.Name) and rank > self.ranks.get(to.id, 0):
            self.ranks[to.id] = rank

    def _carry(self, n: ast.AST) -> None:
        if isinstance(n, ast.Assign):
            for x in n.targets:
                self._put(x, self.rank(n.value))
        elif isinstance(n, ast.AnnAssign | ast.NamedExpr) and n.value:
            self._put(n.target, self.rank(n.value))
        elif isinstance(n, ast.AugAssign):
            both = max(self.rank(n.target), self.rank(n.value))
            self._put(n.target, max(both, MADE) if both else 0)
        elif isinstance(n, ast.For | ast.AsyncFor):
            self._put(n.target, self.rank(n.iter))
        elif isinstance(n, ast.withitem) and n.optional_vars:
            self._put(n.optional_vars, self.rank(n.context_expr))

    def rank(self, e: ast.AST | None) -> int:
        if e is None:
            return 0
        name = _dotted(e.func if isinstance(e, ast.Call) else e.value if isinstance(e, ast.Subscript) else e)
        if name and (isinstance(e, ast.Call) or name != "input") and SOURCE.fullmatch(name):
            return USER
        if isinstance(e, ast.Name):
            return self.ranks.get(e.id, 0)
        made = lambda parts: (max(MADE, r) if (r := max(map(self.rank, parts), default=0)) else 0)
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add | ast.Mod):
            return made([e.left, e.right])
        if isinstance(e, ast.JoinedStr):
            return made([v.value for v in e.values if isinstance(v, ast.FormattedValue)])
        if isinstance(e, ast.Call):
            arguments = [*e.args, *[k.value for k in e.keywords]]
            if isinstance(e.func, ast.Attribute) and e.func.attr in MAKING:
                return made([*arguments, e.func.value])
            if isinstance(e.func, ast.Attribute) and e.func.attr in KEEPING:
                return self.rank(e.func.value)
            return self.rank(e.args[0]) if name in ("str", "bytes", "repr") and e.args else 0
        if isinstance(e, ast.Subscript | ast.Attribute | ast.Starred | ast.Await):
            return self.rank(e.value)
        if isinstance(e, ast.List | ast.Tuple | ast.Set):
            return max(map(self.rank, e.elts), default=0)
        if isinstance(e, ast.Dict):
            return max(map(self.rank, e.values), default=0)
        if isinstance(e, ast.IfExp):
            return max(self.rank(e.body), self.rank(e.orelse))
        if isinstance(e, ast.BoolOp):
            return max(map(self.rank, e.values))
        return 0


def trace(path: str | None, text: str | None, seeds: frozenset[tuple[str, str]] = frozenset()) -> Iterator[tuple]:
    """FACTS of a file. seeds: (function, parameter) that is user input; with seeds only what comes
    of the seeded functions. Kinds: param, call (of an imported function) and sink."""
    root = parsed(text or "") if extension(path) == ".py" else None
    if root is None:
        return
    names: dict[str, tuple[str, str]] = {}  # local name -> (module, function; "" for a module)
    for n in ast.walk(root):
        if isinstance(n, ast.Import):
            for a in n.names:
                names[a.asname or a.name] = (a.name, "")
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            for a in n.names:
                names[a.asname or a.name] = (n.module, a.name)
    outer = Scope(root, {}, frozenset())
    functions = [n for n in ast.walk(root) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    if not seeds:
        for f in functions:
            for place, a in enumerate(x for x in [*f.args.posonlyargs, *f.args.args] if x.arg not in ("self", "cls")):
                yield "param", f.lineno, f.name, "", place, a.arg, 0, "", ""
    scopes = [] if seeds else [outer]
    wanted = {f for f, _ in seeds}
    scopes += [Scope(f, outer.ranks, frozenset(p for g, p in seeds if g == f.name)) for f in functions if not seeds or f.name in wanted]
    for s in scopes:
        for n in s.own:
            if not isinstance(n, ast.Call) or not (name := _dotted(n.func)):
                continue
            for kind, severity, pattern, first in SINKS:
                if pattern.fullmatch(name) and n.args:
                    if kind == "sql-injection" and len(n.args) > 1 and isinstance(n.args[0], ast.Name | ast.Constant):
                        continue  # bound parameters
                    if max(map(s.rank, n.args[:1] if first else n.args)) >= MADE:
                        yield "sink", n.lineno, name, "", 0, "", max(map(s.rank, n.args)), kind, severity
            base, _, leaf = name.rpartition(".")
            module, function = names.get(name, ("", "")) if not base else (names[base][0], leaf) if base in names and not names[base][1] else (".".join(names[base]), leaf) if base in names else ("", "")
            if module and function:
                for place, a in enumerate(n.args):
                    if (r := s.rank(a)) >= MADE:
                        yield "call", n.lineno, function, module, place, "", r, "", ""
                for k in n.keywords:
                    if k.arg and (r := s.rank(k.value)) >= MADE:
                        yield "call", n.lineno, function, module, -1, k.arg, r, "", ""


def _traced(files: DataFrame, seeded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64).to_pylist()
                rows = [(r["path"], *x) for r in part for x in trace(r["path"], r["text"], frozenset((s["function"], s["parameter"]) for s in r["seeds"]) if seeded else frozenset())]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in FACTS.split(", ")])

    return files.select("path", "text", *(["seeds"] if seeded else [])).mapInArrow(run, FACTS)


def _sinks(facts: DataFrame, evidence: str | None) -> DataFrame:
    return facts.where("kind = 'sink'").select("path", "line", "type", "severity", F.lit(evidence).cast("string").alias("evidence")).distinct()


def in_file(files: DataFrame) -> DataFrame:
    """path, line, type, severity, evidence (null) of files (path, text)."""
    return _sinks(_traced(files, False), None)


def cross_file(files: DataFrame, layers: int = LAYERS) -> DataFrame:
    """path, line, type, severity, evidence (the file the input comes from last) of what files
    (path, text) hand to each other, up to ``layers`` calls away; without in_file()'s own."""
    files = files.select("path", "text").dropDuplicates(["path"])
    facts = _cut(_traced(files, False))
    params = facts.where("kind = 'param'").select("path", F.col("name").alias("function"), "place", F.col("argument").alias("parameter")).distinct()
    modules = files.select("path", module_name(F.col("path")).alias("module"))

    def seeds(calls: DataFrame) -> DataFrame:
        c = calls.where("kind = 'call'").select(F.col("path").alias("source"), "module", F.col("name").alias("function"), "place", "argument")
        there = c.join(modules, "module").withColumnRenamed("path", "target")
        p = params.withColumnRenamed("path", "target").withColumnRenamed("place", "own")
        fits = (F.col("place") == F.col("own")) | (F.col("argument") == F.col("parameter"))
        return there.join(p, ["target", "function"]).where(fits).groupBy(F.col("target").alias("path"), "function", "parameter").agg(F.min("source").alias("source"))

    frontier = _cut(seeds(facts))
    known, out = frontier, None
    for _ in range(layers):
        if frontier.isEmpty():
            break
        by = frontier.groupBy("path").agg(F.collect_set(F.struct("function", "parameter")).alias("seeds"), F.min("source").alias("source"))
        traced = _cut(_traced(files.join(by.select("path", "seeds"), "path"), True))
        found = _sinks(traced, None).drop("evidence").join(by.select("path", F.col("source").alias("evidence")), "path")
        out = found if out is None else out.unionByName(found)
        frontier = _cut(seeds(traced).join(known.select("path", "function", "parameter"), ["path", "function", "parameter"], "left_anti"))
        known = _cut(known.unionByName(frontier))
    if out is None:
        return _sinks(facts.limit(0), "")
    return out.groupBy("path", "line", "type", "severity").agg(F.min("evidence").alias("evidence"))


def assignments(path: str | None, text: str | None) -> Iterator[tuple[str, int, str]]:
    """(variable, line, where its value comes from) of Python code: user, call:<name>, literal,
    name:<name> or expression."""
    for n in ast.walk((parsed(text or "") if extension(path) == ".py" else None) or ast.Module([], [])):
        if isinstance(n, ast.Assign):
            v = n.value
            name = _dotted(v.func if isinstance(v, ast.Call) else v.value if isinstance(v, ast.Subscript) else v)
            kind = "user" if name and SOURCE.fullmatch(name) and not isinstance(v, ast.Name) else f"call:{name}" if isinstance(v, ast.Call) else "literal" if isinstance(v, ast.Constant) else f"name:{name}" if isinstance(v, ast.Name) else "expression"
            for x in n.targets:
                if isinstance(x, ast.Name):
                    yield x.id, n.lineno, kind
