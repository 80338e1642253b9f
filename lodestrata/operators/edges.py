"""The dependency graph as a table of edges, kept up to date by changes.

Cases: null fields of an edge take their defaults (ends and symbols: the empty text); repeated edges
are one; null names match nothing; empty tables give no rows (stats: zeros); columns with other names
are dropped, as are those that happen to be called like a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name, module_paths, stable_id
from .rules import is_security_core

KEY = ["source", "target", "symbol", "relation"]


def normalized(edges: DataFrame) -> DataFrame:
    """Edges with every field, an id and one row for each KEY."""
    have = set(edges.columns)
    field = lambda name, default, kind: (F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)).cast(kind).alias(name)
    out = edges.select(field("source", "", "string"), field("target", "", "string"), field("symbol", "", "string"), field("relation", "import", "string"), field("kind", "strong", "string"), field("confidence", 1.0, "double"), field("verified", True, "boolean"))
    return out.dropDuplicates(KEY).withColumn("id", stable_id("g_", *KEY))


def stats(edges: DataFrame) -> DataFrame:
    """Counts in one pass: total, strong, weak, deep (calls and inheritance)."""
    return edges.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("kind") == "strong").alias("strong"),
        F.count_if(F.col("kind") == "weak").alias("weak"),
        F.count_if(F.col("relation").isin("call", "inherit")).alias("deep"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out. One aggregation over both ends: no join."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with the most incoming, then outgoing, edges."""
    return degrees(edges).orderBy(F.desc("n_in"), F.desc("n_out"), "node").limit(k)


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """direction (out, in), other, relation of a node's edges."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "relation")
    into = edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "relation")
    return out.unionAll(into).distinct()


def insert_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.dropDuplicates(KEY).join(edges, KEY, "left_anti"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change of two snapshots (file, fingerprint): added, modified, deleted or renamed (then
    ``was`` is the old name). Every deleted file whose fingerprint an added one has is renamed to
    it, to the last by name of several. Empty and null fingerprints name no content."""
    side = lambda df, name: df.select("file", F.coalesce("fingerprint", F.lit("")).alias(name))
    both = side(before, "old").join(side(after, "new"), "file", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    diff = both.withColumn("change", kind).where("change is not null")
    content = F.coalesce("old", "new")
    # a row for each content that went and came: the added name that stands for it
    met = diff.where("change != 'modified'").where(content != "").groupBy(content.alias("content")).agg(F.max(F.when(F.col("change") == "added", F.col("file"))).alias("now"), F.count_if(F.col("change") == "deleted").alias("gone"))
    out = diff.join(met.where("now is not null and gone > 0"), (F.col("change") != "modified") & (content == F.col("content")), "left")
    moved = F.col("now").isNotNull() & (F.col("change") == "deleted")
    out = out.where(F.col("now").isNull() | (F.col("change") == "deleted") | (F.col("file") != F.col("now")))
    return out.select(F.when(moved, F.col("now")).otherwise(F.col("file")).alias("file"), F.when(moved, "renamed").otherwise(F.col("change")).alias("change"), F.when(moved, F.col("file")).alias("was"))


def apply_changes(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after changes: those of changed or deleted sources and to deleted targets go, fresh
    ones (extracted from added and modified files) come, renamed ends get their new names."""
    stale = changed.where("change in ('modified', 'deleted', 'added')").select(F.col("file").alias("source"))
    dead = changed.where("change = 'deleted'").select(F.col("file").alias("target"))
    kept = edges.select(*KEY, "kind", "confidence", "verified").join(stale, "source", "left_anti").join(dead, "target", "left_anti")
    names = changed.where("change = 'renamed'").select("was", F.col("file").alias("now"))
    for end in ("source", "target"):
        kept = kept.join(names.withColumnRenamed("was", end), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
    return normalized(kept.unionByName(normalized(fresh).select(*kept.columns)))


def resolve_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Call edges: calls (file, name) to definitions (file, name) in other files, by the whole
    name or else, where nothing has it, by what follows its last dot."""
    d = definitions.select(F.col("file").alias("target"), F.col("name").alias("key")).distinct()
    c = calls.select(F.col("file").alias("source"), F.col("name").alias("symbol")).distinct()
    whole = c.join(d, c["symbol"] == d["key"]).drop("key")
    rest = c.join(d, c["symbol"] == d["key"], "left_anti").withColumn("leaf", F.element_at(F.split("symbol", r"\."), -1))
    leaf = rest.join(d, rest["leaf"] == d["key"]).select("source", "symbol", "target")
    return whole.select("source", "symbol", "target").unionAll(leaf).where("source != target").withColumn("relation", F.lit("call"))


def liveness(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with state: dead (an end is no file), stale (unverified), else alive."""
    f = files.select(F.col("file").alias("f")).distinct()
    out = edges.join(f.withColumnRenamed("f", "s"), edges["source"] == F.col("s"), "left").join(f.withColumnRenamed("f", "t"), edges["target"] == F.col("t"), "left")
    return out.withColumn("state", F.when(F.col("s").isNull() | F.col("t").isNull(), "dead").when(~F.col("verified"), "stale").otherwise("alive")).drop("s", "t")


def unreferenced(definitions: DataFrame, *used: DataFrame) -> DataFrame:
    """Definitions whose name no table of used names has."""
    for u in used:
        definitions = definitions.join(u.select("name").distinct(), "name", "left_anti")
    return definitions


def to_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target, a module, is the path of a file (path) that has it, where there is one:
    the module's own name first, else the likeliest path for it."""
    have = files.select("path", module_name(F.col("path")).alias("module")).groupBy("module").agg(F.min("path").alias("path"))
    found = edges.join(have, edges["target"] == have["module"], "left")
    return found.withColumn("target", F.coalesce("path", "target")).drop("path", "module")


def candidates(modules: DataFrame, files: DataFrame) -> DataFrame:
    """module, path: the file of each module, by the order in which a module is looked for."""
    tried = modules.select("module", F.posexplode(module_paths(F.col("module"))).alias("place", "path"))
    return tried.join(files.select("path"), "path").groupBy("module").agg(F.min_by("path", "place").alias("path"))


def referring(edges: DataFrame, files: DataFrame) -> DataFrame:
    """source of every edge to one of files (path), or to its module."""
    ends = files.select(F.col("path").alias("target")).unionAll(files.select(module_name(F.col("path")).alias("target")))
    return edges.join(ends.distinct(), "target", "left_semi").select("source").distinct()


def call_graph(edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (from, to, relation, symbol) of files: targets as files, one edge
    for each pair and relation (the first symbol), ends that are no files left out."""
    known = files.select("path")
    e = to_files(edges, files).join(known.withColumnRenamed("path", "source"), "source", "left_semi").join(known.withColumnRenamed("path", "target"), "target", "left_semi")
    e = e.where("source != target").groupBy(F.col("source").alias("from"), F.col("target").alias("to"), "relation").agg(F.min("symbol").alias("symbol"))
    nodes = e.select(F.explode(F.array("from", "to")).alias("path")).distinct().select(stable_id("n_", "path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), "path")
    return nodes, e


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """text: one row with a flow chart of call_graph(), its lines in order."""
    safe = lambda c: F.regexp_replace(c, r'[\[\](){}<>"|]', "_")
    heads = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), "id", F.lit('["'), safe(F.col("label")), F.lit('"]')).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), stable_id("n_", "from"), F.lit(" -->|"), F.col("relation"), F.lit("| "), stable_id("n_", "to")).alias("line"))
    return heads.unionAll(arrows).agg(F.concat_ws("\n", F.lit("flowchart LR"), F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])).alias("text"))


def core(edges: DataFrame, files: DataFrame) -> DataFrame:
    """path, n_in, n_out, hub of a project's core: files that others refer to (or, without any, the
    better half by outgoing edges), and those of security's own. hub: referred to by half the core's
    number of files or more. Ranked by aggregates; no file's edges meet in one task."""
    own = files.select("path").distinct()
    ends = to_files(edges, files)
    n_in = ends.where("source != target").groupBy(F.col("target").alias("path")).agg(F.countDistinct("source").alias("n_in"))
    n_out = edges.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_out"))
    d = own.join(n_in, "path", "left").join(n_out, "path", "left").na.fill(0, ["n_in", "n_out"])
    counts = d.agg(F.count("*").alias("files"), F.count_if(F.col("n_in") > 0).alias("referred")).first()
    if counts.referred:
        chosen = F.col("n_in") > 0
    else:
        d = d.join(d.orderBy(F.desc("n_out"), "path").limit(max(1, counts.files // 2)).select("path").withColumn("best", F.lit(True)), "path", "left")
        chosen = F.coalesce("best", F.lit(False))
    chosen = d.where(chosen | is_security_core(F.col("path")))
    least = max(1, chosen.count() // 2)
    return chosen.select("path", "n_in", "n_out", (F.col("n_in") >= least).alias("hub"))


def unused(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Definitions (path, fact, name, line) of facts that nothing calls, makes, inherits, exports,
    registers or names in a string, with confidence: low in tests, high for private names, medium
    for public ones. Entry points and special methods are always used."""
    leaf = F.element_at(F.split("name", r"\.|::"), -1)
    used = facts.where("fact in ('call', 'new', 'base', 'export', 'registered', 'string')").select(leaf.alias("name")).distinct()
    entry = F.col("name").isin("main", "run", "start", "init", "setup") | F.col("name").rlike("^__.*__$")
    dead = found.where("fact in ('function', 'class')").where(~(entry & (F.col("fact") == "function"))).join(used, "name", "left_anti")
    test = F.col("path").rlike(r"(^|/)test_[^/]*$|_test\.py$|(^|/)tests?/")
    public = F.when(F.col("fact") == "function", ~F.col("name").startswith("_")).otherwise(F.substring("name", 1, 1).rlike("[A-Z]"))
    return dead.select("path", "fact", "name", "line", F.when(test, "low").when(public, "medium").otherwise("high").alias("confidence"))
