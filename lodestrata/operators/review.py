"""Reports over a project's tables: brief, deep scan, triage, project report, focus by description.

A report is a table, in the order in which it is read; text() makes one text of it. All of it is joins
and aggregates of other operators' results: nothing is read again, and lists in a row have a bound that
is part of the report.

Cases: null texts have no symbols, findings or keywords; files without edges, symbols or findings are in
a report with empty lists and zeros; repeated edges count once; empty tables give an empty report (sums:
zeros); other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import summaries
from . import edges as E
from . import rules

#: Symbols of a file in a brief, findings of a file and bridges of a file in a deep scan.
SYMBOLS, FINDINGS, BRIDGES = 6, 8, 4


def brief(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, class, size, out, inn, symbols, summary of files (path, class, size, text): Python files
    with whom they refer to and who to them, other code with its first symbols, data with a summary."""
    none = F.array().cast("array<string>")
    out = edges.groupBy(F.col("source").alias("path")).agg(F.sort_array(F.collect_set("target")).alias("out"))
    inn = E.to_files(edges, files).where("source != target").groupBy(F.col("target").alias("path")).agg(F.sort_array(F.collect_set("source")).alias("inn"))
    df = files.where("class != 'other'").select("path", "class", "size").join(out, "path", "left").join(inn, "path", "left").join(symbols, "path", "left").join(summaries(files).select("path", "summary"), "path", "left")
    python, code = F.col("path").endswith(".py"), F.col("class") == "tree"
    return df.select(
        "path", "class", "size",
        F.when(python, F.coalesce("out", none)).otherwise(none).alias("out"),
        F.when(python, F.coalesce("inn", none)).otherwise(none).alias("inn"),
        F.when(code & ~python, F.slice(F.coalesce("symbols", none), 1, SYMBOLS)).otherwise(none).alias("symbols"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    ).orderBy(F.desc("class"), "path")


def state(edges: DataFrame, session: DataFrame, files: DataFrame, ratio: float = 0.1) -> DataFrame:
    """One row: edge counts, round and reports of a session (round, reports), whether it has converged
    (2 reports or fewer), and whether edges are dense enough to filter by (files with edges over a
    tenth of code files)."""
    stats = E.stats(edges)
    ends = edges.agg((F.countDistinct("source") + F.countDistinct("target")).alias("ends"))
    code = files.agg(F.count_if(F.col("class") == "tree").alias("code"))
    return stats.join(F.broadcast(ends)).join(F.broadcast(code)).join(F.broadcast(session)).select("total", "strong", "weak", "deep", "round", "reports", (F.col("reports") <= 2).alias("converged"), (F.col("ends") > F.col("code") * ratio).alias("active"))


def text(report: DataFrame, order: list[str]) -> DataFrame:
    """text: one row, a line a row of a report, its columns as name=value."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.array_join(c, ",") if t.startswith("array") else F.col(c).cast("string"), F.lit(""))) for c, t in report.dtypes]
    rows = report.select(F.struct(*order, F.concat_ws("  ", *cells).alias("__line")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["__line"]), "\n").alias("text"))


def deep_scan(files: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """path, n_in, n_out, hub, findings, worst, top (the first findings by severity and line) of a
    project's core, most referred to first. found: path, line, type, severity."""
    own = E.core(edges, files)
    order = F.create_map(*[F.lit(x) for k, s in enumerate(rules.SECURITY_POINTS) for x in (s, k)])[F.col("severity")]
    f = found.join(own.select("path"), "path", "left_semi").withColumn("__order", order)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("__order", "line", "type"))
    top = f.withColumn("__n", rank).where(F.col("__n") <= FINDINGS).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.concat_ws(":", "severity", "type", "line").alias("x")))), lambda x: x["x"]).alias("top"))
    counts = f.groupBy("path").agg(F.count("*").alias("findings"), F.min("__order").alias("worst"))
    names = F.array(*[F.lit(s) for s in rules.SECURITY_POINTS])
    out = own.join(counts, "path", "left").join(top, "path", "left")
    return out.select("path", "n_in", "n_out", "hub", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.get(names, F.col("worst")).alias("worst"), F.coalesce("top", F.array().cast("array<string>")).alias("top")).orderBy(F.desc("n_in"), F.desc("n_out"), "path")


def core_bridges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target: edges between files of the core, the first BRIDGES of each."""
    own = E.core(edges, files).select("path")
    e = E.to_files(edges, files).join(own.withColumnRenamed("path", "source"), "source", "left_semi").join(own.withColumnRenamed("path", "target"), "target", "left_semi")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    return e.where("source != target").select("source", "target").distinct().withColumn("__n", rank).where(F.col("__n") <= BRIDGES).drop("__n")


def triage(files: DataFrame, edges: DataFrame, tripped: DataFrame, versions: DataFrame) -> DataFrame:
    """source, target, state of the core's edges: dead (no such file, or one whose breaker, tripped
    (path), is open), stale (the source has changed since versions (path, fingerprint)), alive."""
    own = E.core(edges, files).select(F.col("path").alias("source"))
    e = edges.join(own, "source", "left_semi").select("source", "target").distinct()
    now = files.select(F.col("path").alias("source"), "fingerprint").join(versions.select(F.col("path").alias("source"), F.col("fingerprint").alias("was")), "source", "left")
    there = files.select(F.col("path").alias("target")).withColumn("there", F.lit(True))
    open_ = tripped.select(F.col("path").alias("target")).distinct().withColumn("open", F.lit(True))
    out = e.join(now, "source", "left").join(there, "target", "left").join(open_, "target", "left")
    gone = F.col("target").contains("/") & F.col("there").isNull() | F.col("open").isNotNull() | (F.col("target") == "")
    return out.select("source", "target", F.when(gone, "dead").when(F.col("was") != F.col("fingerprint"), "stale").otherwise("alive").alias("state"))


def project_report(files: DataFrame, facts: DataFrame, found: DataFrame, origins: DataFrame) -> DataFrame:
    """One row: files, lines, functions, classes, complexity (greatest and mean), findings by
    severity, hours, files with the most findings (10), dependencies by origin, sorted."""
    sizes = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size(F.split("text", "\n"))), F.lit(0)).cast("long").alias("lines"))
    kinds = facts.agg(F.count_if(F.col("fact") == "function").alias("functions"), F.count_if(F.col("fact") == "class").alias("classes"), F.max(F.when(F.col("fact") == "complexity", F.col("value"))).alias("most_complex"), F.round(F.avg(F.when(F.col("fact") == "complexity", F.col("value"))), 2).alias("mean_complexity"))
    hours = F.round(F.coalesce(F.sum(F.when(F.col("severity").isin("critical", "high"), 4.0).when(F.col("severity") == "medium", 1.0).otherwise(1 / 3)), F.lit(0.0)), 1)
    severities = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in rules.SECURITY_POINTS], hours.alias("hours"))
    ranked = found.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)
    worst = ranked.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]).alias("worst"))
    by = [F.sort_array(F.collect_set(F.when(F.col("origin") == o, F.col("module")))).alias(o) for o in ("standard", "third_party", "local")]
    out = sizes
    for part in (kinds, severities, worst, origins.agg(*by)):
        out = out.join(F.broadcast(part))  # one row each
    return out


#: Words of what a project does, by ability, and what to look at then. A table to replace or extend.
ABILITIES = {
    "web": "web http flask django fastapi rest api server url route bottle tornado aiohttp frontend browser html graphql",
    "database": "database sql mysql postgres sqlite redis mongo orm query table sqlalchemy",
    "cli": "cli terminal shell argv console commandline",
    "gui": "android app ui button window desktop apk touch",
    "network": "network socket request download upload crawler scraper urlopen proxy",
    "auth": "login register password auth token jwt session permission cookie account",
    "file": "file path export import csv image compress archive",
    "async": "async await coroutine asyncio eventloop",
    "pay": "pay payment order amount recharge transaction bill invoice",
    "ai": "ai llm model inference ocr speech translate",
    "threads": "thread threading concurrent parallel pool queue",
}
FOCUS = {
    "web": "sql-injection xss open-redirect auth-bypass ssrf crlf-injection path-traversal", "database": "sql-injection query-in-loop", "cli": "command-injection path-traversal mutable-default division-by-zero",
    "gui": "path-traversal debug-mode hardcoded-secret", "network": "ssrf command-injection crlf-injection path-traversal", "auth": "hardcoded-secret weak-hash timing-attack auth-bypass", "file": "path-traversal zip-slip resource-leak check-then-use",
    "async": "future-not-awaited race", "pay": "hardcoded-secret", "threads": "race cache-leak",
}
#: Words of what goes wrong, by symptom, and what to look at then.
SYMPTOMS = {
    "crash": "crash freeze hang exit killed unresponsive", "wrong-result": "wrong incorrect garbled missing duplicate miscalculated", "login": "login password captcha token session permission", "slow": "slow lag stutter memory timeout loading",
    "network": "disconnect offline unreachable 404 500 connection", "security": "inject hack leak bypass exploit attack tamper", "display": "layout font overlap blank icon garbled", "file": "file upload download path save",
    "no-response": "nothing unresponsive broken stuck ignored", "async": "await async coroutine future asyncio", "threads": "thread deadlock concurrent conflict contention",
}
SYMPTOM_FOCUS = {
    "crash": "boundary division-by-zero resource-leak", "wrong-result": "boundary is-literal string-order missing-key", "login": "auth-bypass timing-attack weak-hash hardcoded-secret open-redirect", "slow": "query-in-loop concat-in-loop nested-loops search-in-loop",
    "network": "ssrf crlf-injection", "security": "sql-injection xss command-injection path-traversal xxe unsafe-deserialisation hardcoded-secret", "display": "xss template-injection", "file": "path-traversal zip-slip resource-leak check-then-use",
    "no-response": "future-not-awaited endless-recursion", "async": "future-not-awaited", "threads": "race cache-leak",
}


def tags(content: Column, words: dict[str, str]) -> Column:
    """The keys of which some word stands in a text, in order. A text is taken apart once, into its
    distinct words of ASCII letters and digits."""
    own = F.array_distinct(F.split(F.lower(F.coalesce(content, F.lit(""))), "[^a-z0-9]+"))
    lists = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(w) for w in ws.split()]).alias("ws")) for k, ws in words.items()])
    found = lambda mine: F.transform(F.filter(lists, lambda x: F.arrays_overlap(mine, x["ws"])), lambda x: x["k"])
    return F.get(F.transform(F.array(own), found), F.lit(0))


def focus(tagged: Column, of: dict[str, str]) -> Column:
    """The types to look at for some keys, each once, in order."""
    table = F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)])
    return F.filter(F.array_distinct(F.flatten(F.transform(tagged, lambda k: F.split(F.coalesce(table[k], F.lit("")), " ")))), lambda x: x != "")


def marked(found: DataFrame, types: list[str]) -> DataFrame:
    """found with ``focused``: whether its type is one to look at."""
    return found.withColumn("focused", F.col("type").isin(*types) if types else F.lit(False))


def probe(files: DataFrame) -> DataFrame:
    """path, text of what says what a project does: heads of read-mes, documents and entry points."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    length = F.when(name.rlike(r"^readme(\..*)?$"), 2500).when(F.lower("path").rlike(r"(^|/)docs/.*\.(md|txt)$"), 800).when(name.isin("app.py", "main.py", "run.py", "cli.py", "__main__.py", "server.py", "manage.py"), 1600)
    return files.withColumn("__n", length).where("__n is not null").select("path", F.substring("text", F.lit(1), F.col("__n")).alias("text"))


def abilities(files: DataFrame) -> DataFrame:
    """ability, files: abilities by probe() and how many of its texts name them."""
    return probe(files).select(F.explode(tags(F.col("text"), ABILITIES)).alias("ability"), "path").groupBy("ability").agg(F.countDistinct("path").alias("files"))
