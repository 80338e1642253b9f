"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints: 64 bits over the XXH64 (seed 42) of every 3-word shingle of a text. Two
fingerprints are linked where at most RADIUS bits differ; a component is what links reach.

The 64 bits are split into m groups, correlated bits together. If thresholds t_i (-1: the
group isn't probed) add up to RADIUS - m + 1, then two fingerprints at most RADIUS bits
apart lie within t_i bits of each other in some group i. Every fingerprint chooses its own
thresholds, by dynamic programming over the candidates that each choice would bring, as
counts of group values estimate them: it avoids crowded values and probes further where
values are rare. Probes meet the fingerprints of a value in an equi-join that verifies the
distance; copies of a fingerprint are one node. Only links between different fingerprints
leave the join. Components come from star contraction over tables in the shared folder.

Cases: null and empty texts have no words and the fingerprint zero, linked like any other;
a text of one or two words has one shingle; a component's id is its smallest doc_id, nulls
aside; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, documents, materialize, partitions, release

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Bits of a group's value that the tables of counts tell apart: m * 2**16 numbers.
TABLE_BITS = 16
#: Rows of one value on one side of the join, about; larger values are dealt to blocks.
BLOCK = 4096
#: Components that are broadcast at most, and components' share of rows that makes them hot.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str) -> int:
    """Of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return 0
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    h = np.array(hashes, "<u8")
    for lo in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[lo : lo + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and fp (the fingerprint's bits as a long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for lo in range(0, b.num_rows, 256) for t in b.column(2).slice(lo, 256).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    return documents(docs).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each fingerprint."""
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")


def group_bits(nodes: DataFrame, m: int) -> list[list[int]]:
    """m groups of bits of about equal size. Each starts with the free bit that is most
    correlated with any other and takes the free bits most correlated with its own. The
    sums behind the correlations cover all nodes: 64 x 64 numbers a task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        if n:
            k = np.arange(BITS * BITS + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.r_[both.ravel(), n].astype(np.int64))], ["k", "n"])

    got = nodes.select("fp").mapInArrow(sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    size = [BITS // m + (i < BITS % m) for i in range(m)]
    if not got:
        return np.split(np.arange(BITS), np.cumsum(size)[:-1])
    flat = np.zeros(BITS * BITS + 1)
    flat[[r.k for r in got]] = [r.n for r in got]
    n, both = flat[-1], flat[:-1].reshape(BITS, BITS)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for s in size:
        own = [max(free, key=lambda b: (max(corr[b, c] for c in free), -b))]
        free.discard(own[0])
        while len(own) < s:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.discard(own[-1])
        groups.append(sorted(own))
    return groups


def group_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each group of bits, a column a group."""
    x = bits_of(fps)
    return np.stack([x[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], 1)


def within(width: int, most: int) -> list[np.ndarray]:
    """For d = 0..most: the masks of exactly d of width bits."""
    from itertools import combinations

    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.int64) for d in range(most + 1)]


def estimates(table: np.ndarray, width: int, most: int) -> np.ndarray:
    """Candidates by threshold -1..most (rows) and value (columns). table: how many nodes have
    each value, or each value of the lower TABLE_BITS bits, whose nodes then count as spread
    evenly over the others."""
    from math import comb

    seen, v = min(width, TABLE_BITS), np.arange(len(table))
    by_distance = [sum(table[v ^ x] for x in masks) for masks in within(seen, most)]
    rest = width - seen
    out = np.zeros((most + 2, len(table)))
    for t in range(most + 1):
        out[t + 1] = out[t] + sum(by_distance[d] * comb(rest, t - d) for d in range(t + 1)) / 2**rest
    return out


def allocate(costs: list[np.ndarray], budget: int) -> np.ndarray:
    """Thresholds of each fingerprint: the cheapest with the sum ``budget``. costs: for each
    group, candidates by threshold -1..RADIUS (rows) and fingerprint (columns)."""
    m, n = len(costs), costs[0].shape[1]
    lowest, span = -m, budget + m  # sums from -m to budget
    best = np.full((span + 1, n), np.inf)
    best[0] = 0
    steps = []
    for i, cost in enumerate(costs):
        new, step = np.full((span + 1, n), np.inf), np.zeros((span + 1, n), np.int8)
        for t in range(len(cost)):
            for s in range(span + 1 - t):
                c = best[s] + cost[t]
                better = c < new[s + t]
                new[s + t][better], step[s + t][better] = c[better], t
        best = new
        steps.append(step)
    at, out = np.full(n, span), np.zeros((n, m), np.int64)
    for i in range(m - 1, -1, -1):
        t = steps[i][at, np.arange(n)]
        out[:, i] = t - 1
        at = at - t
    assert lowest + span == budget
    return out


def groups_for(n: int) -> int:
    """Fewer, wider groups for more nodes: a value then has few nodes by chance."""
    return 4 if n < 1 << 25 else 3 if n < 1 << 30 else 2


def links(spark: SparkSession, nodes: DataFrame, n: int) -> DataFrame:
    """(a, b), a < b: the pairs of different fingerprints at most RADIUS bits apart.
    nodes: distinct fingerprints in a column fp; n: how many."""
    m = groups_for(n)
    groups = group_bits(nodes, m)
    low = (1 << TABLE_BITS) - 1

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((m, low + 1), np.int64)
        for b in batches:
            v = group_values(b.column(0).to_numpy(zero_copy_only=False), groups) & low
            for i in range(m):
                table[i] += np.bincount(v[:, i], minlength=low + 1)
        i, v = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(table[i, v])], ["i", "v", "n"])

    table = np.zeros((m, low + 1), np.int64)
    # at most m * 2**TABLE_BITS rows, whatever the input
    got = nodes.select("fp").mapInArrow(counts, "i int, v int, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).toPandas()
    table[got.i.to_numpy(np.int64), got.v.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(table)

    def blocks(i: int, v: np.ndarray) -> np.ndarray:
        """Blocks of a value: one for each BLOCK of its nodes, by the table's estimate."""
        return 1 + (shared.value[i][v & low] >> max(0, len(groups[i]) - TABLE_BITS)) // BLOCK

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            v = group_values(fps, groups)
            for i in range(m):
                block = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks(i, v[:, i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(v[:, i]), pa.array(block.astype(np.int32)), pa.array(fps)], ["i", "v", "block", "a"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [within(len(g), RADIUS) for g in groups]
        cost = [estimates(shared.value[i], len(g), RADIUS) for i, g in enumerate(groups)]
        per_probe = [np.cumsum([0] + [len(x) for x in masks[i]])[:, None] for i in range(m)]
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            v = group_values(fps, groups)
            # a probe costs about as much as a candidate
            chosen = allocate([cost[i][:, v[:, i] & low] + per_probe[i] for i in range(m)], RADIUS - m + 1)
            for i in range(m):
                for d in range(RADIUS + 1):
                    own = np.flatnonzero(chosen[:, i] >= d)
                    for lo in range(0, len(own), 1024):
                        rows = own[lo : lo + 1024]
                        value = (v[rows, i][:, None] ^ masks[i][d][None, :]).ravel()
                        fp = np.repeat(fps[rows], len(masks[i][d]))
                        some = shared.value[i][value & low] > 0  # nothing has this value
                        value, fp = value[some], fp[some]
                        k = blocks(i, value)
                        block = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), i, np.int32)), pa.array(np.repeat(value, k)), pa.array(block.astype(np.int32)), pa.array(np.repeat(fp, k))], ["i", "v", "block", "b"])

    held_df = nodes.select("fp").mapInArrow(held, "i int, v long, block int, a long")
    probe_df = nodes.select("fp").mapInArrow(probes, "i int, v long, block int, b long")
    # a pair is found from both ends; the greater end's probes are enough
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return held_df.hint("merge").join(probe_df, ["i", "v", "block"]).where(near).select("a", "b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that edges (a, b) reach. Alternating large
    and small stars: every round, each node's larger neighbours move to its smallest one.
    Each round is a table in the shared folder."""
    edges = materialize(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u") if large else F.col("m"))
        moved = both.join(least, "u")
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    while True:
        before = edges
        edges = materialize(spark, stars(stars(before, True), False), "edges")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == before.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, before)
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    spark = docs.sparkSession
    hashed = materialize(spark, fingerprints(docs), "simhash")
    return with_components(hashed, fingerprint_classes(spark, hashed), hashed.count())


def fingerprint_classes(spark: SparkSession, hashed: DataFrame) -> DataFrame:
    """(fp, component_id, stay, size) of the fingerprints of hashed (doc_id, key, fp) that more
    than one row shares or a link reaches; stay: the key of a row with the id component_id; size:
    rows of the fingerprint."""
    first = lambda doc_id: F.min_by("key", F.coalesce(doc_id, F.lit((1 << 63) - 1)))
    nodes = materialize(spark, hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), first("doc_id").alias("key"), F.count("*").alias("size")), "nodes")
    found = materialize(spark, components(spark, links(spark, nodes, nodes.count())), "components")
    linked = nodes.join(found, nodes["fp"] == found["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    linked = linked.where("size > 1 or node is not null").unionByName(nodes.join(found.select(F.col("root").alias("fp")).distinct(), "fp").where("size = 1").withColumn("node", F.lit(None).cast("long")).withColumn("root", F.col("fp")).select(*linked.columns))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), first("least").alias("stay"))
    return materialize(spark, linked.join(ids, "root").select("fp", "component_id", "stay", "size"), "near-classes")


def with_components(hashed: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """hashed with component_id and stay (null: a document alone). Fingerprints of a thousandth
    of all rows or more, at most a thousand, are broadcast, so that no hot fingerprint meets in
    a task; others too, if few."""
    classes = classes.select("fp", "component_id", "stay", "size")
    if classes.count() <= BROADCAST_ROWS:
        out = hashed.join(F.broadcast(classes), "fp", "left")
    else:
        hot = hashed.join(F.broadcast(classes.where(F.col("size") >= rows / 1000)), "fp", "left")
        is_hot = F.col("size").isNotNull()
        out = hot.where(is_hot).unionByName(hot.where(~is_hot).drop("component_id", "stay", "size").join(classes.where(F.col("size") < rows / 1000), "fp", "left"))
    return out.withColumn("component_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("size")


def hex_fingerprint(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component (the smallest doc_id, null after all others),
    with all columns. A document is known by its id and text: rows with one id and different
    texts are different documents, rows with one id and one text are the same, of which one row
    stays."""
    spark = docs.sparkSession
    hashed = materialize(spark, fingerprints(docs), "simhash")
    marked = with_components(hashed, fingerprint_classes(spark, hashed), hashed.count()).where("stay is not null")
    stays = F.expr("doc_id <=> component_id and key = stay")
    gone = materialize(spark, marked.where(~stays).select("doc_id", "key").distinct(), "gone")
    again = materialize(spark, marked.where(stays).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "again")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("key"))

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.toDF("__doc_id", "__key")
        return df.join(few(keys), df["doc_id"].eqNullSafe(keys["__doc_id"]) & (df["key"] == keys["__key"]), how)

    out = among(row, gone, "left_anti")
    if again.count():
        once = among(out, again, "left_semi").dropDuplicates(["doc_id", "key"])
        out = among(out, again, "left_anti").unionByName(once)
    return out.select("__row.*")
