"""Search of Python code by patterns of code with wildcards.

``$X`` stands for any expression (the same one wherever it stands again), also for an attribute's name
and for a whole string; ``...`` as an argument stands for any arguments. A pattern is an expression, a
statement or an except clause.

Cases: code that doesn't parse has no matches, a pattern that doesn't is an error; null texts have none;
repeated rows repeat their matches; an empty table gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .extract import extension, parsed, per_file

HOLE = "hole__"
#: Rules by name, with their pattern and severity.
RULES = {
    "hardcoded_password": ("$VAR = '$PASSWORD'", "medium"),
    "dangerous_eval": ("eval($EXPR)", "high"),
    "dangerous_exec": ("exec($CODE)", "high"),
    "dangerous_compile": ("compile($CODE, ...)", "medium"),
    "shell_injection_system": ("os.system($CMD)", "high"),
    "shell_injection_popen": ("subprocess.Popen($CMD, shell=True)", "high"),
    "shell_injection_call": ("subprocess.call($CMD, shell=True)", "high"),
    "sql_injection": ("$CURSOR.execute($QUERY)", "medium"),
    "insecure_pickle": ("pickle.loads($DATA)", "high"),
    "insecure_yaml": ("yaml.load($DATA)", "high"),
    "weak_hash_md5": ("hashlib.md5(...)", "low"),
    "weak_hash_sha1": ("hashlib.sha1(...)", "low"),
    "insecure_random": ("random.$FUNC(...)", "low"),
    "assert_in_production": ("assert $COND", "low"),
    "broad_exception": ("except:", "medium"),
    "try_except_pass": ("except $EXC: pass", "medium"),
    "insecure_marshal": ("marshal.loads($DATA)", "high"),
    "insecure_shelve": ("shelve.open($PATH)", "medium"),
    "insecure_tempfile": ("tempfile.mktemp(...)", "medium"),
    "insecure_ssl_verify": ("ssl._create_unverified_context(...)", "high"),
    "insecure_requests_verify": ("requests.$METHOD($URL, verify=False)", "high"),
}
#: Names that a password has for hardcoded_password.
PASSWORD = re.compile(r"(?i)pass(word|wd)?|pwd|secret|token|api_?key")


def compiled(pattern: str) -> ast.AST:
    code = re.sub(r"\$(\w+)", HOLE + r"\1", pattern.strip())
    if code.startswith("except"):
        return ast.parse(f"try:\n pass\n{code}{' pass' if code.endswith(':') else ''}").body[0].handlers[0]
    node = ast.parse(code).body[0]
    return node.value if isinstance(node, ast.Expr) else node


def _hole(text) -> str | None:
    return text.removeprefix(HOLE) if isinstance(text, str) and text.startswith(HOLE) else None


def matches(pattern, node, found: dict[str, str], any_body: bool = False) -> bool:
    """Whether a node fits, with what its holes hold added to found."""

    def hold(name: str, value: str) -> bool:
        return found.setdefault(name, value) == value

    if isinstance(pattern, ast.Name) and (h := _hole(pattern.id)):
        return isinstance(node, ast.expr) and hold(h, ast.unparse(node))
    if isinstance(pattern, ast.Constant) and (h := _hole(pattern.value)):
        return isinstance(node, ast.Constant) and isinstance(node.value, str) and hold(h, node.value)
    if type(pattern) is not type(node):
        return False
    if isinstance(pattern, list):
        gap = next((i for i, x in enumerate(pattern) if isinstance(x, ast.Constant) and x.value is ...), None)
        if gap is None:
            return len(pattern) == len(node) and all(matches(p, n, found) for p, n in zip(pattern, node, strict=True))
        after = len(pattern) - gap - 1
        return len(node) >= gap + after and all(matches(p, n, found) for p, n in zip(pattern[:gap], node, strict=False)) and all(matches(p, n, found) for p, n in zip(pattern[gap + 1 :], node[len(node) - after :], strict=True))
    if not isinstance(pattern, ast.AST):
        return hold(h, str(node)) if (h := _hole(pattern)) else pattern == node
    gap = isinstance(pattern, ast.Call) and any(isinstance(a, ast.Constant) and a.value is ... for a in pattern.args)
    for name in pattern._fields:
        if name in ("ctx", "type_comment", "kind") or gap and name == "keywords" or any_body and name == "body":
            continue
        if not matches(getattr(pattern, name, None), getattr(node, name, None), found):
            return False
    return True


def find(text: str | None, pattern: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(line, what holes hold) of every match."""
    wanted = compiled(pattern)
    any_body = pattern.strip().endswith(":")
    for n in ast.walk(parsed(text or "") or ast.Module([], [])):
        held: dict[str, str] = {}
        if type(n) is type(wanted) and matches(wanted, n, held, any_body):
            yield n.lineno, held


def search(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, holes (name=text, in order of names) of matches in Python files (path, text)."""
    compiled(pattern)

    def rows(path, text):
        for line, held in find(text, pattern) if extension(path) == ".py" else ():
            yield line, ",".join(f"{k}={v}" for k, v in sorted(held.items()))

    return per_file(files, rows, "path string, line long, holes string")


def search_all(files: DataFrame, patterns: list[str], every: bool = True) -> DataFrame:
    """path, matched (how many patterns): files that all patterns match, or any of them."""

    def rows(path, text):
        n = sum(any(True for _ in find(text, p)) for p in patterns) if extension(path) == ".py" else 0
        if n == len(patterns) or n and not every:
            yield (n,)

    return per_file(files, rows, "path string, matched long")


def scan(files: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """path, line, rule, severity of the rules' matches, all rules over one parse of a file."""
    rules = rules or RULES

    def rows(path, text):
        root = parsed(text or "") if extension(path) == ".py" else None
        for name, (pattern, severity) in rules.items() if root else ():
            wanted, any_body = compiled(pattern), pattern.strip().endswith(":")
            for n in ast.walk(root):
                held: dict[str, str] = {}
                if type(n) is type(wanted) and matches(wanted, n, held, any_body):
                    if name == "hardcoded_password" and not (PASSWORD.search(held.get("VAR", "")) and held.get("PASSWORD")):
                        continue
                    if name == "broad_exception" and n.type is not None:
                        continue
                    yield n.lineno, name, severity

    return per_file(files, rows, "path string, line long, rule string, severity string").distinct()
