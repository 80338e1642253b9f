"""Findings from a table of rules, and scores over findings.

Rules become columns of one projection over lines: literal patterns compile once, a literal is tried
before its pattern, and lines are read once for all rules. What stands beside a line comes with it
from files.lines(around=...), so that neither context nor findings need a shuffle.

Cases: null code and null files have no findings; lines of over LONGEST characters are looked at up to
there; repeated lines of a file give one finding each line number and type; other columns are not
looked at; an empty table gives no rows, a score of 0 and the best grade.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from .rulebook import FILE_RULES, RULES, FileRule, Rule

#: Points by severity.
SECURITY_POINTS = {"critical": 15, "high": 8, "medium": 3, "low": 1}
OTHER_POINTS = {"high": 12, "medium": 5, "low": 2}
#: Fixed values: (least points, grade), worst first.
SECURITY_GRADES = ((70, "F"), (50, "D"), (30, "C"), (10, "B"), (0, "A"))
PERFORMANCE_GRADES = ((60, "D"), (35, "C"), (15, "B"), (0, "A"))
LOGIC_GRADES = ((50, "D"), (30, "C"), (10, "B"), (0, "A"))
#: Fixed value: characters of a line that rules look at.
LONGEST = 32768
#: String contents, which rules on bare code don't see.
LITERAL = r"\"(\\.|[^\"\\])*\"|'(\\.|[^'\\])*'"
COMMENT = r"^\s*(#|//|/\*|\*)"


def language(path: Column) -> Column:
    """The rule language of a path: py, js, html, java, c, php, go, rust, kotlin, env, requirements."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(name == ".env", "env").when(name.isin("requirements.txt", "Pipfile"), "requirements").when(path.rlike(r"\.min\.(js|ts)$"), None)
    families = {"py": ("py",), "js": ("js", "jsx", "ts", "tsx", "mjs"), "html": ("html", "htm", "vue"), "java": ("java",), "c": ("c", "h", "cpp"), "php": ("php",), "go": ("go",), "rust": ("rs",), "kotlin": ("kt",)}
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    for family, extensions in families.items():
        out = out.when(ext.isin(*extensions), family)
    return out


def literal(r: Rule) -> Column:
    return reduce(or_, [F.col("__low").contains(x) for x in r.literal.split("|")])


def any_of(words) -> str:
    """A regular expression of some words that looks at each character of a text once or twice: words
    that begin alike are one branch."""
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[0], set()).add(w[1:])
    branch = lambda c, tails: re.escape(c) + ("" if "" in tails else any_of(tails) if len(tails) > 1 else re.escape(next(iter(tails))))
    out = "|".join(branch(c, tails) for c, tails in sorted(heads.items()))
    return f"(?:{out})" if len(heads) > 1 else out


def near_literals() -> tuple[str, ...]:
    """What is in lines that rules look beside."""
    return tuple(sorted({x for r in RULES if r.near for x in r.literal.split("|")}))


def fits(r: Rule, columns: list[str]) -> Column:
    out = F.col("__bare" if r.on == "bare" else "__code").rlike(r.pattern)
    if r.also:
        out = out & F.col("__code").rlike(r.also)
    if r.guard:
        out = out & ~F.col("__bare" if r.on == "bare" else "__code").rlike(r.guard)
    if r.near:
        out = out & F.col("around" if "around" in columns else "__code").rlike(r.near)
    if r.literal:
        out = literal(r) & out
    if r.languages and "language" in columns:
        out = F.col("language").isin(*r.languages) & out
    return out


def of_any_file(rules: list[Rule]) -> list[Rule]:
    """Rules that say something of text whose language isn't known."""
    return [r for r in rules if not r.languages or not {"env", "requirements"}.issuperset(r.languages)]


def findings(lines: DataFrame, rules: list[Rule] | None = None, file: str = "file") -> DataFrame:
    """file, line, type, severity, code: one finding for each file, line and type. Comment lines and
    lines of rule tables are skipped. lines: file, line, code; with a language column rules apply
    to their own languages only (without one all do but those for special files), with an around column (neighbouring lines) near patterns see it,
    with a quoted column lines within strings that stand alone are skipped."""
    rules = rules or RULES
    rules = rules if "language" in lines.columns else of_any_file(rules)
    hits = [F.when(fits(r, lines.columns), F.struct(F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"))) for r in rules]
    code = lines.where(~F.col("quoted")) if "quoted" in lines.columns else lines
    code = code.withColumn("__code", F.substring("code", 1, LONGEST))
    code = code.where(~F.col("__code").rlike(COMMENT) & ~F.col("__code").rlike(r"[\"']pattern[\"']\s*:\s*[rR]?[\"']"))
    # a generator's columns are computed once; others would be computed anew by each rule that names them
    once = lambda df, name, value: df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
    code = once(code, "__low", F.lower("__code"))
    # most lines have no rule's literal, and go no further
    maybe = [F.col("__low").rlike(any_of({x for r in rules if r.literal for x in r.literal.split("|")}))]
    maybe += [F.col("language").isin(*r.languages) if r.languages and "language" in lines.columns else F.lit(True) for r in rules if not r.literal]
    code = code.where(reduce(or_, maybe))
    code = once(code, "__bare", F.regexp_replace("__code", LITERAL, '""'))
    # a line's findings are in one row: of two rules of a type, the first
    first = F.aggregate(F.filter(F.array(*hits), lambda h: h.isNotNull()), F.array().cast("array<struct<type:string,severity:string>>"), lambda a, h: F.when(F.exists(a, lambda x: x["type"] == h["type"]), a).otherwise(F.array_append(a, h)))
    out = code.select(file, "line", F.explode(first).alias("hit"), snippet(F.trim("code")).alias("code"))
    return out.select(file, "line", "hit.type", "hit.severity", "code")


def file_findings(lines: DataFrame, rules: list[FileRule] | None = None, file: str = "file") -> DataFrame:
    """file, line, type, severity of file rules: one pass over lines, one group a file, map-side
    combined, so a file of any length is a few numbers when it is shuffled."""
    code = lines.where(~F.col("code").rlike(COMMENT))
    aggs, out = [], []
    for k, r in enumerate(rules or FILE_RULES):
        own = F.col("language").isin(*r.languages) if "language" in lines.columns else F.lit(True)
        aggs += [
            F.min(F.when(own & F.col("code").rlike(r.present), F.col("line"))).alias(f"at{k}"),
            F.max(F.col("code").rlike(r.also).cast("int") if r.also else F.lit(1)).alias(f"also{k}"),
            F.max(F.col("code").rlike(r.absent).cast("int") if r.absent else F.lit(0)).alias(f"absent{k}"),
        ]
        out.append(F.when(F.col(f"at{k}").isNotNull() & (F.col(f"also{k}") == 1) & (F.col(f"absent{k}") == 0), F.struct(F.col(f"at{k}").alias("line"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"))))
    got = code.groupBy(file).agg(*aggs).select(file, F.explode(F.filter(F.array(*out), lambda h: h.isNotNull())).alias("hit"))
    return got.select(file, "hit.line", "hit.type", "hit.severity")


def deduplicated(found: DataFrame, file: str = "file", evidence: str = "evidence") -> DataFrame:
    """One finding for each file, line and type: the one with evidence from other files first."""
    best = Window.partitionBy(file, "line", "type").orderBy(F.desc_nulls_last(evidence), "severity", "code")
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def is_test(path: Column) -> Column:
    """Whether findings of a path are of tests."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.contains("test_") | name.startswith("test") | name.contains("_test") | name.contains(".test.") | F.concat(F.lit("/"), path).contains("/tests/")


#: What names and folders of security's own files start with or have in them.
SECURITY_CORE = ("guard", "shell", "security", "auth", "token", "crypto", "secret", "ssl", "tls", "exec", "bridge", "proxy")


def is_security_core(path: Column) -> Column:
    """A hint in the file's name, or at the start of a folder's."""
    low = F.concat(F.lit("/"), F.lower(path))
    return F.element_at(F.split(low, "/"), -1).rlike("|".join(SECURITY_CORE)) | low.rlike("/(" + "|".join(SECURITY_CORE) + ")")


def near_lines(lines: DataFrame, pattern: str, beside: str, reach: int = 1, file: str = "file") -> DataFrame:
    """Lines that pattern fits with a line within ``reach`` that beside fits."""
    w = Window.partitionBy(file).orderBy("line").rowsBetween(-reach, reach)
    return lines.withColumn("__beside", F.max(F.col("code").rlike(beside).cast("int")).over(w)).where(F.col("code").rlike(pattern) & (F.col("__beside") == 1)).drop("__beside")


def files_with_and_without(lines: DataFrame, present: str, absent: str, file: str = "file") -> DataFrame:
    """file, line: files where present fits some line (the first one) and absent none."""
    got = lines.groupBy(file).agg(F.min(F.when(F.col("code").rlike(present), F.col("line"))).alias("line"), F.max(F.col("code").rlike(absent).cast("int")).alias("other"))
    return got.where("line is not null and other = 0").select(file, "line")


def points(severity, table: dict[str, int]):
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def grade(score, table) -> F.Column:
    out = F.lit(table[-1][1])
    for least, name in reversed(table):
        out = F.when(score >= least, name).otherwise(out)
    return out


def risk(found: DataFrame, table=SECURITY_POINTS, grades=SECURITY_GRADES, by: list[str] | None = None) -> DataFrame:
    """score (100 at most), grade and counts by severity, of all findings or by columns."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in table]
    out = found.groupBy(*(by or [])).agg(F.least(F.lit(100), F.coalesce(F.sum(points(F.col("severity"), table)), F.lit(0))).cast("long").alias("score"), *counts)
    return out.withColumn("grade", grade(F.col("score"), grades))


def recurring_types(found: DataFrame, file: str = "file", least: int = 2) -> DataFrame:
    """type, files: types found in at least ``least`` files."""
    return found.groupBy("type").agg(F.countDistinct(file).alias("files")).where(F.col("files") >= least)


def scoped(found: DataFrame, file: str = "file") -> DataFrame:
    """scope (core, test), severity, findings."""
    return found.groupBy(F.when(is_test(F.col(file)), "test").otherwise("core").alias("scope"), "severity").agg(F.count("*").alias("findings"))


def ordered(found: DataFrame, most: int, file: str = "file") -> DataFrame:
    """The first ``most`` findings of each severity, by severity, file and line, with their rank: a
    report's order and its display cap."""
    order = F.create_map(*[F.lit(x) for k, s in enumerate(SECURITY_POINTS) for x in (s, k)])[F.col("severity")]
    w = Window.partitionBy("severity").orderBy(file, "line", "type")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("__order", order).orderBy("__order", "rank").drop("__order")


def worst_file(found: DataFrame, file: str = "file") -> DataFrame:
    """file, findings: the file with the most, the first by name of equals."""
    return found.groupBy(file).agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), file).limit(1)


#: What to do, by type.
ADVICE = {
    "sql-injection": "bind parameters", "command-injection": "pass argument lists without a shell", "command-execution": "check commands against an allow-list", "path-traversal": "resolve paths and keep them below a folder",
    "unsafe-deserialisation": "read a data format instead", "dynamic-exec": "replace evaluated text by a table of functions", "hardcoded-secret": "read secrets from the environment", "weak-hash": "use a password hash",
    "weak-crypto": "use an authenticated cipher", "xss": "escape what is shown", "ssrf": "check hosts against an allow-list", "buffer-overflow": "use functions with a size",
}


def suggestions(found: DataFrame) -> DataFrame:
    """type, findings, advice of the types that have some, most findings first."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])[F.col("type")]
    return found.groupBy("type").agg(F.count("*").alias("findings")).withColumn("advice", F.coalesce(advice, F.lit("look at each"))).orderBy(F.desc("findings"), "type")


def sql(rules: list[Rule], lines: str, file: str = "file") -> str:
    """The same findings in DuckDB's SQL: a table of file, line, type, severity, code over a table
    (or subquery) of file, line, code, and around where rules ask for it, without languages."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cases = []
    rules = of_any_file(rules)
    for r in rules:
        on = "b" if r.on == "bare" else "c"
        parts = ["(" + " OR ".join(f"contains(lower(c), {q(x)})" for x in r.literal.split("|")) + ")"] if r.literal else []
        parts += [f"regexp_matches({on}, {q(r.pattern)})"] + ([f"regexp_matches(c, {q(r.also)})"] if r.also else [])
        parts += ([f"NOT regexp_matches({on}, {q(r.guard)})"] if r.guard else []) + ([f"regexp_matches(around, {q(r.near)})"] if r.near else [])
        cases.append(f"CASE WHEN {' AND '.join(parts)} THEN {{'type': {q(r.type)}, 'severity': {q(r.severity)}}} END")
    around = "around" if any(r.near for r in rules) else "'' AS around"
    return f"""
      SELECT {file}, line, h.type AS type, h.severity AS severity, substr(trim(c), 1, 100) AS code FROM (
        SELECT {file}, line, c, unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS h, generate_subscripts(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), 1) AS k
        FROM (SELECT {file}, line, code AS c, {around}, regexp_replace(code, {q(LITERAL)}, '""', 'g') AS b FROM {lines}
              WHERE NOT regexp_matches(code, {q(COMMENT)}) AND NOT regexp_matches(code, {q(r"[\"']pattern[\"']\s*:\s*[rR]?[\"']")})))
      QUALIFY row_number() OVER (PARTITION BY {file}, line, h.type ORDER BY k) = 1"""
