"""Complexity, debt, grades, profiles and coverage.

Cases: null measures give null scores, which aggregates leave out; empty tables give no rows, or one
with counts of 0 where all rows are aggregated; repeated rows count each time; of equal order values a
trend takes either first; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import grade

#: Weights of the dimensions of a composite grade.
WEIGHTS = {"security": 0.30, "debt": 0.25, "structure": 0.20, "performance": 0.10, "logic": 0.10, "smells": 0.05}
COMPOSITE_GRADES = ((95, "A+"), (90, "A"), (80, "B"), (65, "C"), (50, "D"), (0, "F"))
DEBT_GRADES = ((45, "D"), (25, "C"), (10, "B"), (0, "A"))
#: Hours to mend a finding.
HOURS = {"critical": 4.0, "high": 4.0, "medium": 1.0, "low": 1 / 3}
BRANCHES = r"\b(if|for|while|case|catch|elif|except)\b|&&|\|\||\?"


def complexity(text) -> F.Column:
    """One plus the branches in a text, by keywords."""
    return F.lit(1) + F.regexp_count(text, F.lit(BRANCHES))


def debt(dead_ratio, n_complex, n_duplicates, n_cycles) -> F.Column:
    """Four parts of 25 points at most."""
    part = lambda x: F.least(F.lit(25), x.cast("long"))
    return part(F.floor(dead_ratio * 125)) + part(n_complex * 3) + part(n_duplicates * 2) + part(n_cycles * 8)


def composite(dims: DataFrame, by: list[str]) -> DataFrame:
    """score and grade of (dim, score) rows by columns: the mean weighted by WEIGHTS, to a tenth. Halves
    go to the even tenth, among them those that a mean of doubles misses by its last bits (bround()
    looks at their decimals instead)."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("dim")]
    mean = F.sum(F.col("score") * weight) / F.sum(weight)
    out = dims.groupBy(*by).agg((F.rint(mean * 10) / 10).alias("score"))
    return out.withColumn("grade", grade(F.col("score"), COMPOSITE_GRADES))


def trend(scores: DataFrame, order: str, by: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """scores with the score before and up, down, same (a change under least) or new. scores are
    aggregated already: without ``by``, all of them are one series, in one task."""
    before = F.lag("score").over(Window.partitionBy(*(by or [])).orderBy(order))
    change = F.col("score") - F.col("before")
    return scores.withColumn("before", before).withColumn("trend", F.when(F.col("before").isNull(), "new").when(change >= least, "up").when(change <= -least, "down").otherwise("same"))


def debt_hours(found: DataFrame, by: list[str]) -> DataFrame:
    hours = F.create_map(*[F.lit(x) for kv in HOURS.items() for x in kv])[F.col("severity")]
    return found.groupBy(*by).agg(F.sum(hours).alias("hours"))


#: Words of layers, the first layer that one of them names wins.
LAYERS = {
    "presentation": "ui view controller handler page screen widget component frontend client web api".split(),
    "business": "service manager business logic core domain usecase use_case processor".split(),
    "data": "model repository dao database db storage entity schema mapper persistence".split(),
    "util": "util utils helper helpers common base tool tools lib library".split(),
}


def layers(path) -> F.Column:
    """Architecture layer of a path (below a project's root): by words in its folder or in its name
    without the extension."""
    where = F.regexp_replace(F.lower(path), r"\.[^./]*$", "")
    out = F.lit("unknown")
    for layer, words in reversed(LAYERS.items()):
        out = F.when(where.rlike("|".join(words)), layer).otherwise(out)
    return out


def clear_layers(files: DataFrame) -> DataFrame:
    """layers, clear of files (path): three layers or more (unknown counts), under half unknown."""
    got = files.agg(F.countDistinct(layers(F.col("path"))).alias("layers"), F.count_if(layers(F.col("path")) == "unknown").alias("unknown"), F.count("*").alias("files"))
    return got.select("layers", ((F.col("layers") >= 3) & (F.col("unknown") < 0.5 * F.col("files"))).alias("clear"))


def smell_health(points, lines) -> F.Column:
    """100 less four times the points of smells (high 8, medium 3, low 1) by thousand lines."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - points / F.greatest(lines / 1000, F.lit(0.1)) * 4))


def structure_health(clear, n_layers) -> F.Column:
    return F.when(clear, F.least(F.lit(100.0), 90.0 + 2 * n_layers)).otherwise(85.0)


def savings(brief_size, full_size) -> F.Column:
    """The share that reading a brief saves; negative where the brief is longer."""
    return 1 - brief_size / full_size


def dead_ratio(definitions: DataFrame) -> DataFrame:
    """ratio: definitions that are dead with high confidence, of all (confidence null: alive)."""
    return definitions.agg((F.count_if(F.col("confidence") == "high") / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


def profile(calls: DataFrame) -> DataFrame:
    """func, calls, total, self, avg, min, max of spans (id, parent, func, seconds): self is a
    span's time without that of its children."""
    children = calls.groupBy(F.col("parent").alias("id")).agg(F.sum("seconds").alias("inner"))
    own = calls.join(children, "id", "left").withColumn("own", F.col("seconds") - F.coalesce("inner", F.lit(0.0)))
    return own.groupBy("func").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.sum("own").alias("self"), F.avg("seconds").alias("avg"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))


def hot_spots(calls: DataFrame, k: int = 10) -> DataFrame:
    """The k functions of profile() with the most time of their own."""
    return profile(calls).orderBy(F.desc("self"), "func").limit(k)


def uncovered(total: DataFrame, executed: DataFrame) -> DataFrame:
    """file, missing: the lines of total (file, line) that executed doesn't have, in order."""
    return total.join(executed, ["file", "line"], "left_anti").groupBy("file").agg(F.sort_array(F.collect_set("line")).alias("missing"))


def overall_coverage(total: DataFrame, executed: DataFrame) -> DataFrame:
    """covered, lines, ratio of all files together, by lines."""
    return coverage(total, executed).agg(F.sum("covered").alias("covered"), F.sum("lines").alias("lines")).withColumn("ratio", F.col("covered") / F.col("lines"))


def call_summary(spans: DataFrame) -> DataFrame:
    """func, calls, depth (its greatest) of call rows (func, event call or return, seq): open calls
    before each, a running sum in order."""
    step = F.when(F.col("event") == "call", 1).otherwise(-1)
    depth = F.sum(step).over(Window.partitionBy("thread").orderBy("seq"))
    return spans.withColumn("depth", depth).where("event = 'call'").groupBy("func").agg(F.count("*").alias("calls"), F.max("depth").alias("depth"))


def coverage(total: DataFrame, executed: DataFrame) -> DataFrame:
    """file, lines, covered, ratio of two tables (file, line), each line once."""
    hit = total.select("file", "line").distinct().join(executed.select("file", "line").distinct().withColumn("hit", F.lit(1)), ["file", "line"], "left")
    return hit.groupBy("file").agg(F.count("*").alias("lines"), F.count("hit").alias("covered")).withColumn("ratio", F.col("covered") / F.col("lines"))
