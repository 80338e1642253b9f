"""Tree search over a table of nodes: id, parent, depth, seq, status, pruned, total, text.

Cases: null texts count as empty, and are like nothing; null scores come last; of equal scores the
lower seq comes first; repeated rows are nodes of their own; empty tables give no rows (a stored state:
a fresh root); other columns are kept where nodes are returned.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, ngrams
from ..sources.store import replace
from .graph import _cut, subtree

#: Weights of a node's scores.
WEIGHTS = {"evidence": 0.35, "relevance": 0.30, "novelty": 0.20, "verifiable": 0.15}


def total_score(score) -> F.Column:
    """Of a struct of the four scores; halves are rounded up."""
    return F.round(sum(score[k] * w for k, w in WEIGHTS.items()), 2)


def select(nodes: DataFrame, strategy: str = "beam") -> DataFrame:
    """The next node: bfs (least depth), dfs (greatest), beam (best score, unscored last)."""
    order = {"bfs": [F.asc("depth"), F.asc("seq")], "dfs": [F.desc("depth"), F.asc("seq")], "beam": [F.desc_nulls_last("total"), F.asc("seq")]}[strategy]
    return nodes.where("status in ('open', 'scored') and not pruned").orderBy(*order).limit(1)


def beam(nodes: DataFrame, width: int) -> DataFrame:
    """nodes with cut: whether ``width`` siblings or more come before it by score. Pruned nodes and
    children of dead ends take no place and aren't cut."""
    dead = nodes.where("status = 'dead_end'").select(F.col("id").alias("parent")).withColumn("__dead", F.lit(True))
    out = nodes.join(dead, "parent", "left").withColumn("__in", ~F.col("pruned") & F.col("__dead").isNull())
    best = Window.partitionBy("parent", "__in").orderBy(F.desc_nulls_last("total"), "seq")
    return out.withColumn("cut", F.col("__in") & (F.row_number().over(best) > width)).select(*nodes.columns, "cut")


def dead(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """nodes with status dead_end for start (id) and all below it."""
    gone = subtree(nodes, start).withColumn("__gone", F.lit(True))
    return nodes.join(gone, "id", "left").withColumn("status", F.when(F.col("__gone"), "dead_end").otherwise(F.col("status"))).drop("__gone")


def converged(newer: DataFrame, older: DataFrame, least: float = 0.9, by: str | None = None) -> DataFrame:
    """overlap() with converged: a share of least or more; null where there is no older layer."""
    out = overlap(newer, older, by=by)
    there = older.select(by).distinct().withColumn("__older", F.lit(True)) if by else older.agg((F.count("*") > 0).alias("__older"))
    out = out.join(F.broadcast(there) if not by else there, *([[by], "left"] if by else []))
    return out.withColumn("converged", F.when(F.col("__older"), F.col("overlap") >= least)).drop("__older")


def mixed_similarity(a, b) -> F.Column:
    """The greater of the Jaccard similarity of 3-grams and the Ochiai coefficient of 2-grams."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    x, y = ngrams(clean(a), 2), ngrams(clean(b), 2)
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(x, lambda v: v == g)), F.size(F.filter(y, lambda v: v == g))))
    both = F.when((F.size(x) > 0) & (F.size(y) > 0), shared / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)
    return F.greatest(jaccard(F.array_distinct(ngrams(clean(a))), F.array_distinct(ngrams(clean(b)))), both)


#: The fields of a stored node and what they are without a value.
STATE = "id long, parent long, depth int, seq long, status string, pruned boolean, total double, text string"


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored nodes of a search, or those of a fresh one, a root, where there are none that
    can be read."""
    try:
        got = spark.read.schema(STATE).option("mode", "DROPMALFORMED").json(path)
        if not got.isEmpty():
            return got
    except AnalysisException:
        pass
    return spark.createDataFrame([(0, None, 0, 0, "open", False, None, "")], STATE)


def save_state(nodes: DataFrame, path: str) -> None:
    """Written beside and then put in place, so that a reader sees one state or the other."""
    replace(nodes.select(*[f.split()[0] for f in STATE.split(", ")]), path, "json")


def render(nodes: DataFrame) -> DataFrame:
    """text: one row with the tree, a line a node, children below and right of their parent in
    order of seq, with a mark for the status and the score. Order comes from paths of padded seqs."""
    places = paths(nodes)
    mark = F.create_map(*[F.lit(x) for kv in {"open": "o", "expanded": "+", "scored": "*", "dead_end": "x"}.items() for x in kv])
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("pruned"), "-").otherwise(F.coalesce(mark[F.col("status")], F.lit("?"))), F.lit(" "), F.coalesce(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60), F.lit("")), F.coalesce(F.concat(F.lit(" ["), F.col("total").cast("string"), F.lit("]")), F.lit("")))
    rows = nodes.join(places, "id").select(F.struct("path", line.alias("line")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("text"))


def paths(nodes: DataFrame) -> DataFrame:
    """id, path: the seqs from the root, padded, so that paths sort as a walk through the tree.
    Pointer jumping: every round doubles how far up a path reaches."""
    at = nodes.select("id", F.col("parent").alias("up"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("path"))
    while not at.where("up is not null").isEmpty():
        higher = at.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        at = _cut(at.join(higher, "up", "left").select("id", F.col("further").alias("up"), F.concat_ws("/", "before", "path").alias("path")))
    return at.select("id", "path")


def prune(nodes: DataFrame, width: int) -> DataFrame:
    """nodes with pruned set below every node that beam() cuts."""
    gone = subtree(nodes, beam(nodes, width).where("cut and parent is not null").select("id")).withColumn("__gone", F.lit(True))
    return nodes.join(gone, "id", "left").withColumn("pruned", F.col("pruned") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def overlap(newer: DataFrame, older: DataFrame, least: float = 0.4, by: str | None = None) -> DataFrame:
    """The share of newer texts (id, text) like some older one: Jaccard of 3-grams above least.
    Candidates share one of their rarest 3-grams: an equi-join that frequent grams stay out of."""
    on = [by] if by else []
    g = lambda t, s: t.select(*on, F.col("id").alias(f"id{s}"), F.array_distinct(ngrams(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).alias(f"g{s}"))
    a, b = g(newer, "a"), g(older, "b")
    every = a.select(*on, F.col("ga").alias("g")).unionAll(b.select(*on, F.col("gb").alias("g"))).select(*on, F.explode("g").alias("gram")).groupBy(*on, "gram").agg(F.count("*").alias("df"))
    # of sets this similar, each has a shared gram among its rarest (prefix filter, exact)
    def rare(t, s):
        posted = t.select(*on, f"id{s}", F.size(f"g{s}").alias("n"), F.explode(f"g{s}").alias("gram")).join(every, [*on, "gram"])
        place = F.row_number().over(Window.partitionBy(*on, f"id{s}").orderBy("df", "gram"))
        return posted.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select(*on, f"id{s}", "gram")

    pairs = rare(a, "a").join(rare(b, "b"), [*on, "gram"]).select(*on, "ida", "idb").distinct()
    like = pairs.join(a, [*on, "ida"]).join(b, [*on, "idb"]).where(jaccard(F.col("ga"), F.col("gb")) > least).select(*on, "ida").distinct()
    return a.select(*on, "ida").join(like.withColumn("like", F.lit(1)), [*on, "ida"], "left").groupBy(*on).agg(F.count("*").alias("nodes"), F.count("like").alias("alike")).withColumn("overlap", F.try_divide("alike", "nodes"))


def _profile(s: str) -> tuple[set, Counter, int]:
    """A text's 3-grams, its 2-grams with their counts, and how many 2-grams it has."""
    grams = lambda n: [s[i : i + n] for i in range(len(s) - n + 1)]
    s = " ".join((s or "").lower().split())
    return set(grams(3)), Counter(grams(2)), max(0, len(s) - 1)


def _similar(a: tuple[set, Counter, int], b: tuple[set, Counter, int]) -> float:
    (x, p, m), (y, q, n) = a, b
    both = sum(min(c, q[g]) for g, c in p.items() if g in q) / (m * n) ** 0.5 if m and n else 0.0
    return max(len(x & y) / len(x | y) if x | y else 0.0, both)


def signals(nodes: DataFrame, least: float = 0.4, weak: float = 0.3, head: int = 64) -> DataFrame:
    """depth, id, cluster, weak: leader clusters of each depth in order of seq (a text joins the
    first cluster whose first text is similar), weak where a cluster has at most ``weak`` of them.
    A round finds the leaders among the first ``head`` open nodes of each depth on the driver, and
    all open nodes look for theirs among these in parallel; what stays open comes after them in
    order, so the clusters are those of one scan. Later rounds take more, up to 1024."""
    open_, known, out = _cut(nodes.select("depth", "id", "seq", "text")), Counter(), None
    while True:
        order = Window.partitionBy("depth").orderBy("seq", "id")
        first = open_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= head).orderBy("depth", "place").collect()
        if not first:
            break
        leaders, own = {}, {}
        for r in first:
            mine, profile = leaders.setdefault(r.depth, []), _profile(r.text)
            k = next((k for k, p in mine if _similar(p, profile) > least), None)
            if k is None:
                k = known[r.depth]
                known[r.depth] += 1
                mine.append((k, profile))
            own[r.depth, r.id] = k
        round_ = nodes.sparkSession.sparkContext.broadcast((leaders, own))

        def look(batches, round_=round_):
            leaders, own = round_.value
            for pdf in batches:
                found = []
                for depth, id_, text in zip(pdf["depth"], pdf["id"], pdf["text"]):
                    k = own.get((depth, id_))
                    if k is None:
                        profile = _profile(text)
                        k = next((k for k, p in leaders.get(depth, []) if _similar(p, profile) > least), None)
                    found.append(k)
                yield pdf.assign(cluster=pd.array(found, "Int64"))

        done = _cut(open_.mapInPandas(look, "depth long, id long, seq long, text string, cluster long"))
        closed = done.where("cluster is not null").select("depth", "id", "cluster")
        out = closed if out is None else out.unionAll(closed)
        open_ = done.where("cluster is null").drop("cluster")
        head = min(2 * head, 1024)
    if out is None:
        return nodes.select("depth", "id", F.lit(0).cast("long").alias("cluster"), F.lit(False).alias("weak"))
    sizes = out.groupBy("depth", "cluster").agg(F.count("*").alias("n"))
    total = sizes.groupBy("depth").agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total), "depth").join(sizes, ["depth", "cluster"]).select("depth", "id", "cluster", (F.col("n") / F.col("total") <= weak).alias("weak"))
