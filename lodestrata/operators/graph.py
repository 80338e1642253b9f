"""Reachability, cycles, components and trees over edge tables.

Loops run on the driver, over tables: each round is one equi-join of a frontier with the edges, and an
anti-join with what is known. Rounds are bounded by a depth or by the graph's own. Frontiers are written
to the shared folder each round, what is known every few rounds, so that plans stay small and survive
lost executors.

Cases: null ends join nothing; repeated edges and seeds count once; an edge from a node to itself is
on no cycle and changes nothing; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_name
from ..session import shared_dir

#: Rounds after which what is known is written.
WRITE_EVERY = 4


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def impact(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """node, depth of what depends on start (node), by edges source -> target read backwards;
    the least depth of each, without start itself."""
    known = start.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    edges = edges.select("source", "target").where("source is not null and target is not null")
    frontier = known
    for d in range(1, depth + 1):
        found = frontier.select(F.col("node").alias("target")).join(edges.select("source", "target"), "target").select(F.col("source").alias("node")).distinct()
        frontier = _cut(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        known = known if d % WRITE_EVERY else _cut(known)
    return known.where("depth > 0")


def file_impact(edges: DataFrame, files: DataFrame, start: str, depth: int = 3, symbol: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, depth), and functions (path, symbol, depth), that a change of file ``start``
    reaches: imports name modules, calls and bases name files, and a file and its module are one
    node. symbol: the first step goes only along calls of that name, and imports."""
    spark = edges.sparkSession
    module = files.select("path", module_name(F.col("path")).alias("module")).distinct()
    # a module's edges are those of each file that it names
    by_module = edges.where("relation = 'import'").join(module, edges["target"] == module["module"]).select("source", F.col("path").alias("target"), F.lit("").alias("symbol"))
    by_file = edges.where("relation in ('call', 'inherit')").select("source", "target", F.coalesce("symbol", F.lit("")).alias("symbol"))
    known = frontier = spark.createDataFrame([(start, 0)], "path string, depth int")
    back, named = _cut(by_module.unionAll(by_file).where("source != target").distinct()), None
    for d in range(1, depth + 1):
        step = back.join(frontier.select(F.col("path").alias("target")), "target")
        if symbol and d == 1:
            step = step.where(F.col("symbol").isin(symbol, "") | F.col("symbol").endswith("." + symbol))
        step = _cut(step.select(F.col("source").alias("path"), "symbol", F.lit(d).alias("depth")).distinct().join(known.select("path"), "path", "left_anti"))
        frontier = step.select("path", "depth").distinct()
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        own = step.where("symbol != ''").select("path", "symbol", "depth")
        named = own if named is None else named.unionByName(own)
    named = named if named is not None else known.select("path", F.lit("").alias("symbol"), "depth").limit(0)
    return known.where("depth > 0").orderBy("depth", "path"), named.orderBy("depth", "path", "symbol")


def import_cycles(edges: DataFrame, files: DataFrame) -> DataFrame:
    """node, component, size of modules on a cycle of imports, however long; relative imports and
    sources that are no file have no part in it."""
    module = files.select(F.col("path").alias("source"), module_name(F.col("path")).alias("module")).distinct()
    e = edges.where("relation = 'import' and target != '' and target not like '.%'").join(module, "source").select(F.col("module").alias("source"), "target").distinct()
    return components(e)


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """length, cycle: simple cycles of at most ``longest`` nodes, each once, from its least node.
    Paths only go on through nodes greater than their first, which keeps each cycle to one path."""
    e = edges.select("source", "target").where("source != target").distinct()
    # paths only within strongly connected components: all others end nowhere
    own = components(e).select("node", "component")
    e = _cut(e.join(own.toDF("source", "__s"), "source").join(own.toDF("target", "__t"), "target").where("__s = __t").select("source", "target"))
    paths = e.where("target > source").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    out = None
    for n in range(2, longest + 1):
        closed = paths.join(e, (e["source"] == paths["last"]) & (e["target"] == paths["first"]), "left_semi").select(F.lit(n).alias("length"), F.concat_ws(">", "path").alias("cycle"))
        out = closed if out is None else out.unionAll(closed)
        if n < longest:
            paths = _cut(paths.join(e, paths["last"] == e["source"]).where((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target"))).select("first", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path")))
    return out


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: what edges reach from start, itself included."""
    known = frontier = start.select("node").where("node is not null").distinct()
    step = _cut(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).where("node != next").distinct())  # nulls go, too
    rounds = 0
    while not frontier.isEmpty():
        found = frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
        frontier = _cut(found.join(known, "node", "left_anti"))
        known, rounds = known.unionAll(frontier), rounds + 1
        known = known if rounds % WRITE_EVERY else _cut(known)
    return known


def _least_reaching(edges: DataFrame) -> DataFrame:
    """node, label: the least node from which edges reach it, itself included."""
    label = _cut(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("label", F.col("node")))
    frontier = label
    while not frontier.isEmpty():
        found = frontier.join(edges, frontier["node"] == edges["source"]).groupBy(F.col("target").alias("node")).agg(F.min("label").alias("new"))
        frontier = _cut(found.join(label, "node").where("new < label").select("node", F.col("new").alias("label")))
        label = _cut(label.unionByName(frontier).groupBy("node").agg(F.min("label").alias("label")))
    return label


def components(edges: DataFrame) -> DataFrame:
    """node, component, size of all nodes on a cycle of two nodes or more, however long: strongly
    connected components by their least node. A round labels nodes forward with the least node that
    reaches them; what reaches a label's own node backward within the label is its component."""
    e = _cut(edges.select("source", "target").where("source != target").distinct())
    out = e.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    while True:
        # a node without an edge in or out is on no cycle
        n = -1
        while n != (n := e.count()):
            ends = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            e = _cut(ends.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if not n:
            break
        label = _least_reaching(e)
        inside = e.join(label.toDF("source", "label"), "source").join(label.toDF("target", "other"), "target").where("label = other").select("source", "target", "label")
        inside = _cut(inside)
        back = frontier = _cut(label.where("node = label"))
        while not frontier.isEmpty():
            found = frontier.withColumnRenamed("node", "target").join(inside, ["target", "label"]).select(F.col("source").alias("node"), "label").distinct()
            frontier = _cut(found.join(back.select("node"), "node", "left_anti"))
            back = _cut(back.unionByName(frontier))
        sizes = back.groupBy("label").agg(F.count("*").alias("size")).where("size > 1")
        out = _cut(out.unionAll(back.join(sizes, "label").select("node", F.col("label").alias("component"))))
        gone = back.select("node")
        e = inside.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        e = _cut(e.select("source", "target"))
    return out.join(out.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two of nodes (node)."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").where("source != target").select("source", "target").distinct()


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """id of all descendants of roots (id), themselves included; nodes: id, parent."""
    edges = nodes.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return reachable(edges, roots.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """id, up: the ancestors of start (id) and how far up they are."""
    edges = nodes.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return impact(edges, start.select(F.col("id").alias("node")), 1 << 20).select(F.col("node").alias("id"), F.col("depth").alias("up"))


def backtrack(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """The nearest ancestor of ``at`` with a child that is open or scored, not pruned and not
    ``at`` itself, which is dead from here on."""
    live = nodes.where("status in ('open', 'scored') and not pruned").join(at.select("id"), "id", "left_anti").select(F.col("parent").alias("id")).distinct()
    return ancestors(nodes, at).join(live, "id", "left_semi").orderBy("up").limit(1)


def propagate(edges: DataFrame, seeds: DataFrame, layers: int = 4) -> DataFrame:
    """node, rank: labels (1 parameter, 2 concatenation, 3 user input) carried along edges for at
    most ``layers`` steps, the greatest rank of each node."""
    known = seeds.groupBy("node").agg(F.max("rank").alias("rank"))
    frontier = known
    for _ in range(layers):
        found = frontier.join(edges.select(F.col("source").alias("node"), F.col("target").alias("next")), "node").groupBy(F.col("next").alias("node")).agg(F.max("rank").alias("rank"))
        old = known.withColumnRenamed("rank", "old")
        frontier = _cut(found.join(old, "node", "left").where("old is null or rank > old").select("node", "rank"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier).groupBy("node").agg(F.max("rank").alias("rank"))
    return known
