"""Exact dedup through counting quotient filters.

Each task puts the 64-bit fingerprints (XXH64 of the UTF-8 bytes) of its rows into counting
quotient filters, one for each shard of the fingerprint space: a fingerprint's upper bits are
its home slot (quotient), the rest (remainder) is stored, with a count, in a run of sorted
remainders. Quotient and remainder together are the whole fingerprint, so filters of the same
shard merge without loss, as sorted sequences. A group of copies is one entry per task and
shard, however large it is. Fingerprints with a count above one go to byte verification: only
their rows are grouped by the text itself, with partial aggregation before the shuffle.

Cases: null texts are empty texts, and so copies of each other; of equal texts the row with the
largest doc_id stays (a null doc_id is smaller than any other; rows of that doc_id that repeat are
all ``kept`` in find_copies, and drop_copies keeps one of them); an empty table gives none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, partitions

#: Rows of classes that are broadcast at most; each has about 100 bytes.
BROADCAST_ROWS = 200_000
#: Fingerprints that a shard holds, about, and rows from which a task makes one filter a shard; no
#: more shards than give a filter LEAST_ITEMS, so that filters of very large tables aren't all header.
SHARD_ITEMS = 1 << 18
TASK_ITEMS = 1 << 22
LEAST_ITEMS = 64


class CountingQuotientFilter:
    """A filter of ``bits``-bit fingerprints as three arrays over slots.

    ``occupied[q]``: a run of quotient q exists. ``run_end[s]``: slot s ends a run; the i-th
    run end belongs to the i-th occupied quotient. ``slots``: remainders, each run sorted. A
    count of one is ``x``; of two ``x x``; of more ``x d x`` (``x 0 d x`` where d > x, and
    ``0 d 0 0`` for x = 0), with d = count - 2, plus one from x on, which is never x: a
    smaller remainder behind a larger one can only be a counter.
    """

    def __init__(self, bits: int, q: int, occupied: np.ndarray, run_end: np.ndarray, slots: np.ndarray):
        self.bits, self.q, self.occupied, self.run_end, self.slots = bits, q, occupied, run_end, slots

    @classmethod
    def of(cls, items: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """items: sorted distinct uint64 below 2**bits."""
        q = max(1, int(np.ceil(np.log2(max(2, len(items) / 0.85)))))
        r = np.uint64(bits - q)
        quotient = (items >> r).astype(np.int64)
        x = items & np.uint64((1 << int(r)) - 1)
        digit = counts.astype(np.uint64) - np.uint64(2)
        digit = np.where(counts > 2, digit + ((digit >= x) & (x > 0)), 0).astype(np.uint64)
        prefix = (counts > 2) & (x > 0) & (digit > x)
        width = np.where(counts == 1, 1, np.where(counts == 2, 2, 3 + (prefix | (x == 0))))
        first = np.cumsum(width) - width
        # a run starts at its quotient, or where the run before it ends
        new_run = np.r_[True, quotient[1:] != quotient[:-1]] if len(items) else np.zeros(0, bool)
        shift = np.maximum.accumulate(quotient[new_run] - first[new_run]) if len(items) else np.zeros(0, np.int64)
        place = first + (np.repeat(shift, np.diff(np.r_[np.flatnonzero(new_run), len(items)])) if len(items) else 0)
        n = max(1 << q, int(place[-1] + width[-1]) if len(items) else 0)
        occupied, run_end, slots = np.zeros(1 << q, bool), np.zeros(n, bool), np.zeros(n, np.uint64)
        occupied[quotient] = True
        last = np.r_[new_run[1:], True] if len(items) else new_run
        run_end[(place + width - 1)[last]] = True
        slots[place] = x
        two, zero, many = counts == 2, (counts > 2) & (x == 0), (counts > 2) & (x > 0)
        slots[place[two] + 1] = x[two]
        slots[place[zero] + 1] = digit[zero]
        plain, long = many & ~prefix, many & prefix
        slots[place[plain] + 1], slots[place[plain] + 2] = digit[plain], x[plain]
        slots[place[long] + 2], slots[place[long] + 3] = digit[long], x[long]
        return cls(bits, q, occupied, run_end, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        quotients = np.flatnonzero(self.occupied)
        ends = np.flatnonzero(self.run_end)
        if not len(ends):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1])
        lengths = ends - starts + 1
        run = np.repeat(np.arange(len(ends)), lengths)
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        x = self.slots[at]
        # runs that only increase have counts of one
        odd = np.zeros(len(ends), bool)
        odd[run[1:][(run[1:] == run[:-1]) & (x[1:] <= x[:-1])]] = True
        simple = ~odd[run]
        r = np.uint64(self.bits - self.q)
        whole = lambda quotient, rest: (quotient.astype(np.uint64) << r) | rest
        found, counts = [whole(quotients[run[simple]], x[simple])], [np.ones(int(simple.sum()), np.int64)]
        for i in np.flatnonzero(odd):
            got = list(self._counts(self.slots[starts[i] : ends[i] + 1].tolist()))
            found.append(whole(np.full(len(got), quotients[i]), np.array([g[0] for g in got], np.uint64)))
            counts.append(np.array([g[1] for g in got], np.int64))
        found, counts = np.concatenate(found), np.concatenate(counts)
        order = np.argsort(found, kind="stable")
        return found[order], counts[order]

    @staticmethod
    def _counts(slots: list[int]) -> Iterator[tuple[int, int]]:
        i, n = 0, len(slots)
        while i < n:
            x = slots[i]
            if x == 0:
                if i + 3 < n and slots[i + 1] > 0 and slots[i + 2] == 0 and slots[i + 3] == 0:
                    yield 0, slots[i + 1] + 2
                    i += 4
                elif i + 1 < n and slots[i + 1] == 0:
                    yield 0, 2
                    i += 2
                else:
                    yield 0, 1
                    i += 1
            elif i + 1 < n and slots[i + 1] == x:
                yield x, 2
                i += 2
            elif i + 1 < n and slots[i + 1] < x:
                i += 1 + (slots[i + 1] == 0)
                yield x, slots[i] - (slots[i] > x) + 2
                i += 2
            else:
                yield x, 1
                i += 1

    def to_bytes(self) -> bytes:
        return struct.pack("<BBQ", self.bits, self.q, len(self.slots)) + np.packbits(self.occupied).tobytes() + np.packbits(self.run_end).tobytes() + self.slots[np.repeat(True, len(self.slots))].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n = struct.unpack_from("<BBQ", raw)
        at = struct.calcsize("<BBQ")
        a, b = ((1 << q) + 7) // 8, (n + 7) // 8
        unpack = lambda lo, size, count: np.unpackbits(np.frombuffer(raw, np.uint8, size, lo), count=count).astype(bool)
        return cls(bits, q, unpack(at, a, 1 << q), unpack(at + a, b, n), np.frombuffer(raw, np.uint64, n, at + a + b))

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The filter of all their items: sorted sequences merged, counts of equal items added."""
        both = [f.items() for f in filters]
        return cls.of(*added(np.concatenate([x for x, _ in both]), np.concatenate([c for _, c in both])), filters[0].bits)


def added(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct items with the sums of their counts."""
    order = np.argsort(items, kind="stable")
    items, counts = items[order], counts[order]
    first = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    return items[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def repeated_fingerprints(spark: SparkSession, fingerprints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints (one long column) that occur more than once."""
    shard_bits = max(int(np.ceil(np.log2(max(2, rows / SHARD_ITEMS)))), int(np.ceil(np.log2(partitions(spark)))), 1)
    shard_bits = min(shard_bits, max(1, int(np.log2(TASK_ITEMS / LEAST_ITEMS))))
    bits = 64 - shard_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def filters():
            items, counts = added(np.concatenate(kept), np.ones(n, np.int64))
            shards = (items >> np.uint64(bits)).astype(np.int64)
            for s, lo, hi in zip(*(lambda u, i: (u, i, np.r_[i[1:], len(shards)]))(*np.unique(shards, return_index=True)), strict=True):
                own = items[lo:hi] & np.uint64((1 << bits) - 1)
                yield int(s), CountingQuotientFilter.of(own, counts[lo:hi], bits).to_bytes()

        def batch():
            rows = list(filters())
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([f for _, f in rows], pa.binary())], ["shard", "filter"])

        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            kept.append(x)
            n += len(x)
            if n >= TASK_ITEMS:
                yield batch()
                kept, n = [], 0
        if n:
            yield batch()

    def merge(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        items, counts = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(f) for f in group.column("filter").to_pylist()]).items()
        items, counts = items[counts > 1], counts[counts > 1]
        return pa.table({"fp": (items | np.uint64(shard << bits)).view(np.int64), "n": counts})

    return fingerprints.mapInArrow(build, "shard int, filter binary").groupBy("shard").applyInArrow(merge, "fp long, n long")


def _fingerprint(text: Column | str) -> Column:
    return F.xxhash64(text)


def copy_classes(docs: DataFrame, hashed: DataFrame | None = None) -> DataFrame:
    """One row per text that occurs more than once, checked byte by byte:
    fp, text_sha256, keep_id, group_size. hashed: fp of all rows of docs, if there is such a table."""
    spark, df = docs.sparkSession, documents(docs)
    if hashed is None:
        hashed = materialize(spark, df.select(_fingerprint("text").alias("fp")), "fingerprints")
    again = materialize(spark, repeated_fingerprints(spark, hashed.select("fp"), hashed.count()), "repeated")
    keys = again.select("fp")
    # 8 bytes a fingerprint: a bounded set goes to the rows, else rows and set meet by fingerprint
    keys = F.broadcast(keys) if again.count() <= 4 * BROADCAST_ROWS else keys
    routed = df.withColumn("fp", _fingerprint("text")).join(keys, "fp", "left_semi")
    verified = routed.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = verified.where("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    return materialize(spark, verified, "classes")


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (with fp and text_sha256) left-joined to classes. Classes of a thousandth of all
    rows or more, of which there can be a thousand, are broadcast, so that no large group of
    copies meets in a task; the others too, where they are few."""
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), ["fp", "text_sha256"], "left")
    total = classes.agg(F.sum("group_size")).first()[0]
    hot = F.broadcast(classes.where(F.col("group_size") >= total / 1000))
    cold = classes.where(F.col("group_size") < total / 1000)
    # a row of a hot class has nothing to look for among the others
    found = rows.join(hot, ["fp", "text_sha256"], "left")
    is_hot = F.col("group_size").isNotNull()
    rest = found.where(~is_hot).drop("keep_id", "group_size").join(cold, ["fp", "text_sha256"], "left")
    return found.where(is_hot).unionByName(rest)


def find_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    hashed = materialize(spark, documents(docs).select("doc_id", _fingerprint("text").alias("fp"), F.sha2("text", 256).alias("text_sha256")), "hashed")
    found = with_classes(hashed, copy_classes(docs, hashed))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps, with all columns."""
    text = F.coalesce(docs["text"], F.lit(""))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs["doc_id"].cast("long").alias("doc_id"), _fingerprint(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"))
    found = with_classes(row, copy_classes(docs))
    alone = found.where("group_size is null")
    stay = found.where("group_size is not null and doc_id <=> keep_id").dropDuplicates(["fp", "text_sha256"])
    return alone.select("__row.*").unionByName(stay.select("__row.*"))
