"""What can be said of running code from its text and from recorded rows. Nothing is run here.

Cases: null and empty code is allowed and has no reason; code that doesn't parse is refused with one;
null errors have no class; repeated rows repeat; empty tables give no rows; other columns are kept where
rows are returned.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import _dotted, parsed

#: Modules that restricted code may import.
ALLOWED = frozenset("math statistics itertools collections re json string random datetime time copy functools operator typing dataclasses enum".split())
#: Modules and calls that code in a process of its own may not have.
NETWORK = frozenset("socket urllib urllib3 requests httpx aiohttp http ftplib telnetlib smtplib poplib imaplib ssl asyncio".split())
UNSAFE = frozenset("ctypes pickle cPickle marshal shelve dbm anydbm code codeop pty resource fcntl mmap importlib".split())
OS_CALLS = frozenset(
    "system popen spawnl spawnle spawnlp spawnlpe spawnv spawnve spawnvp spawnvpe execl execle execlp execlpe execv execve execvp execvpe fork forkpty"
    " kill killpg remove unlink rmdir removedirs rename renames replace chmod chown chroot mknod mkfifo mount umount symlink link".split()
)
REFUSED_CALLS = frozenset("eval exec compile __import__ input breakpoint globals locals vars dir help getattr setattr".split())
#: Names that restricted code may neither call nor assign, and attributes it may not have.
RESTRICTED_NAMES = frozenset(
    "open exec eval compile __import__ getattr setattr delattr globals locals vars dir help input breakpoint exit quit memoryview classmethod"
    " staticmethod property super type isinstance issubclass hasattr".split()
)
RESTRICTED_ATTRIBUTES = frozenset("__globals__ __builtins__ __class__ __bases__ __subclasses__ __mro__ __import__ __dict__ __code__ __func__ __self__ __closure__".split())
FORMAT_ESCAPE = re.compile(r"\{\s*[^{}]*__(class|globals|bases|mro|subclasses|import|dict|code|func|self|closure)__")


def _refused(n: ast.AST, restricted: bool, allow_files: bool) -> str:
    """Why a node isn't allowed, or the empty text."""
    if isinstance(n, ast.Import | ast.ImportFrom):
        for m in [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""]:
            top = m.split(".")[0]
            if m and (top not in ALLOWED if restricted else top in NETWORK or top in UNSAFE):
                return f"import {m}"
    elif isinstance(n, ast.Call):
        name = _dotted(n.func) or ""
        if restricted:
            if name in RESTRICTED_NAMES:
                return f"call {name}"
        elif name in REFUSED_CALLS or name == "open" and not allow_files or name.startswith("os.") and name.split(".")[1] in OS_CALLS or name.split(".")[0] in ("subprocess", "socket", "urllib", "requests", "httpx", "ssl"):
            return f"call {name}"
    elif isinstance(n, ast.Attribute):
        special = n.attr.startswith("__") and n.attr.endswith("__")
        if n.attr in RESTRICTED_ATTRIBUTES or (n.attr.startswith("_") and not special if restricted else special):
            return f"attribute {n.attr}"
    elif restricted and isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id in RESTRICTED_NAMES:
        return f"name {n.id}"
    return ""


def refusal(code: str | None, restricted: bool = False, allow_files: bool = False) -> str:
    """Why code may not run, or the empty text. restricted: only ALLOWED modules and no private
    attributes; else no network, unsafe modules or system calls."""
    if not (code or "").strip():
        return ""
    root = parsed(code)
    if root is None:
        return "syntax"
    for n in ast.walk(root):
        if reason := _refused(n, restricted, allow_files):
            return reason
    return "format" if ".format(" in code and FORMAT_ESCAPE.search(code) else ""


def gate(snippets: DataFrame, restricted: bool = False, allow_files: bool = False) -> DataFrame:
    """snippets (id, code) as id, allowed, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons = [refusal(c, restricted, allow_files) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not r for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], ["id", "allowed", "reason"])

    kind = dict(snippets.dtypes)["id"]
    return snippets.select("id", "code").mapInArrow(run, f"id {kind}, allowed boolean, reason string")


def level(language: Column, asked: Column, restricted_only: bool = False) -> Column:
    """Where code would run: as asked, or (auto) restricted for plain Python and in a process of its
    own for other languages."""
    auto = F.when(language == "python", F.lit("subprocess" if restricted_only else "restricted")).otherwise("subprocess")
    return F.when(asked == "auto", auto).otherwise(asked)


#: Classes of errors by what their text contains, the first that fits.
ERRORS = {
    "timeout": ("timeout", "timed out"),
    "memory": ("memory", "memoryerror", "out of memory", "killed", "oom"),
    "syntax": ("syntaxerror", "invalid syntax", "unexpected"),
    "runtime": ("nameerror", "typeerror", "valueerror", "indexerror", "keyerror", "attributeerror", "zerodivisionerror"),
    "security": ("security", "forbidden", "not allowed", "blocked", "denied"),
    "resource": ("recursion", "recursionerror", "output"),
}


def error_class(error: Column) -> Column:
    low = F.lower(error)
    out = F.lit("unknown")
    for kind, words in reversed(ERRORS.items()):
        fits = low.contains(words[0])
        for w in words[1:]:
            fits = fits | low.contains(w)
        out = F.when(fits, kind).otherwise(out)
    return F.when(error.isNull() | (error == ""), "").otherwise(out)


#: Inputs to try a function with, by category, name and value (as a Python literal).
BOUNDARY = {
    "empty_string": "''", "single_space": "' '", "whitespace_only": "' \\t\\n\\r'", "zero": "0", "negative_one": "-1", "max_int": "2**31 - 1", "min_int": "-(2**31)", "none_value": "None",
    "true": "True", "false": "False", "empty_list": "[]", "empty_dict": "{}", "empty_tuple": "()", "special_chars": "string.punctuation", "unicode_null": "'\\x00'", "very_long_string": "'A' * 10000",
}
MALICIOUS = {
    "sql_injection_1": "' OR '1'='1", "sql_injection_2": "1; DROP TABLE users;--", "sql_injection_3": "' UNION SELECT * FROM passwords--",
    "xss_1": "<script>alert('XSS')</script>", "xss_2": "<img src=x onerror=alert('XSS')>", "xss_3": "javascript:alert('XSS')",
    "command_injection_1": "; cat /etc/passwd", "command_injection_2": "| whoami", "command_injection_3": "&& rm -rf /",
    "path_traversal_1": "../../../etc/passwd", "path_traversal_2": "/etc/passwd", "path_traversal_3": "..\\..\\..\\windows\\system32",
    "serialization_payload": "cos\nsystem\n(S'echo pwned'\ntR.", "crlf_injection": "admin\r\nSet-Cookie: session=hacked", "ssrf": "http://169.254.169.254/latest/meta-data/",
    "open_redirect": "//evil.com", "xml_external_entity": "<!DOCTYPE foo [<!ENTITY xxe SYSTEM \"file:///etc/passwd\">]>",
}
EXTREME = {
    "huge_list": "list(range(10000))", "deeply_nested": "a list in a list, 50 deep", "float_max": "float('inf')", "float_min": "float('-inf')", "float_nan": "float('nan')", "float_epsilon": "1e-308",
    "negative_huge": "-(10**100)", "positive_huge": "10**100", "complex_number": "1+2j", "bytes_data": "b'\\x00\\x01\\x02\\xff'", "set_data": "{1, 2, 3}", "frozenset_data": "frozenset([1, 2, 3])",
    "recursive_input": "a list that holds itself", "emoji_string": "😀🎉🔥💻📱🌍🎵🎮", "multibyte_string": "中文日本語한국어العربية", "control_chars": "\x01\x02\x03\x1b\x7f",
}
#: Inputs for parameters whose name contains a word, the first row that fits.
TYPED = (
    (("path", "file", "dir"), ("../../../etc/passwd", "/etc/passwd")),
    (("sql", "query", "id", "name"), ("' OR '1'='1",)),
    (("cmd", "command", "host", "ip"), ("; whoami",)),
    (("url", "link", "href", "redirect"), ("http://127.0.0.1:22", "//evil.com")),
)


def inputs(spark: SparkSession) -> DataFrame:
    """category, name, value, place (from 0, over all)."""
    rows = [(c, n, v) for c, t in (("boundary", BOUNDARY), ("malicious", MALICIOUS), ("extreme", EXTREME)) for n, v in t.items()]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "category string, name string, value string, place int")


def typed_inputs(parameters: DataFrame) -> DataFrame:
    """parameters (parameter) with value: what to try each with, by its name."""
    low, none = F.lower("parameter"), F.array().cast("array<string>")
    out = none
    for words, values in reversed(TYPED):
        out = F.when(low.rlike("|".join(words)), F.array(*[F.lit(v) for v in values])).otherwise(out)
    return parameters.withColumn("value", F.explode(out))


def input_plan(spark: SparkSession, parameters: DataFrame, most: int = 30) -> DataFrame:
    """path, name, place, value: what to call each function with, ``most`` inputs of the general
    tables and then those for its parameters (path, name, parameter), by place: a plan's own bound."""
    general = inputs(spark).where(F.col("place") < most).select("place", "value")
    functions = parameters.select("path", "name").distinct()
    # the table has fewer than 50 rows, of our own
    rows = F.array(*[F.struct(F.lit(r.place).alias("place"), F.lit(r.value).alias("value")) for r in general.collect()])
    first = functions.withColumn("r", F.explode(rows)).select("path", "name", "r.place", "r.value")
    return first.select("path", "name", "place", "value").unionByName(typed_inputs(parameters).select("path", "name", F.lit(most).alias("place"), "value"))


def confirmed_coupling(reports: DataFrame, facts: DataFrame) -> DataFrame:
    """reports (source, target module) with confirmed: the source's own facts import it."""
    imported = facts.where("fact = 'import'").select(F.col("path").alias("source"), F.col("name").alias("target")).distinct().withColumn("__there", F.lit(True))
    return reports.join(imported, ["source", "target"], "left").withColumn("confirmed", F.col("__there").isNotNull()).drop("__there")


def confirmed_dead(dead: DataFrame, files: DataFrame) -> DataFrame:
    """dead (path, name, ...) with mentions: how often its name stands in any file as a word, its
    definition aside; none confirms it. One pass over texts; names meet words in an equi-join."""
    names = dead.select("name").distinct()
    words = files.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    n = words.join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    defined = dead.groupBy("name").agg(F.count("*").alias("d"))
    return dead.join(n, "name", "left").join(defined, "name").withColumn("mentions", F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("d"))).drop("n", "d")
