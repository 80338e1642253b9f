"""Packing documents into token windows by minimum bin slack.

Documents become token ids with an end id. What fills a whole window is a piece of its own;
the rest of each document is a piece of fewer tokens. How many pieces have each length is all
that the plan needs: at most ``window`` numbers, whatever the corpus. The plan takes, again and
again, the largest remaining length and then the multiset of remaining lengths that fills the
window closest to its capacity: sums that can be reached are the bits of one integer, a shift
and an OR for each length (its count in binary parts), and walking back through the bitsets
gives the counts. A multiset is used as often as the remaining lengths allow, so each step
uses up a length, and the number of steps depends on the window alone.

Pieces of one length are numbered without a shuffle of texts or ids: a task numbers its own,
and tasks' counts by length, summed up in order, say where a task's numbers begin. A piece's
length and number then give its sequence and its place there.

Cases: null and empty texts are a document with the end id only; repeated rows are packed once
each; an empty table gives no pieces. Only the last windows, for which no fitting lengths
remain, have slack; slack is not padded where a sequence's length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize
from .tokens import library_encoder

WINDOW = 2048


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` ids of each document: doc_id, start, length, ids_crc32,
    doc_tokens, ids, with task and number: the how-manieth of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = library_encoder(path), TaskContext.get().partitionId()
        end, seen = int(end_id).to_bytes(4, "little"), [0] * (window + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                row, start, length, crc, total, raw, number = [], [], [], [], [], [], []
                for r, ids in enumerate(encoder.encode_many(b.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        part = ids[4 * s : 4 * (s + window)]
                        k = len(part) // 4
                        row.append(r)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        raw.append(part)
                        number.append(seen[k])
                        seen[k] += 1
                ends = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), long(start), long(length), long(crc), long(total), pa.ListArray.from_arrays(ends, flat), pa.array([task] * len(row), pa.int32()), long(number)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "task", "number"],
                )
        encoder.release()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, task int, number long"
    return documents(docs).mapInArrow(run, schema)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """length -> how many, of the multiset of counts with the largest sum up to capacity.

    Lengths go from large to small, so that a sum that several multisets reach tends to take
    the large ones, which are harder to place later."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        most = min(counts[length], capacity // length)
        steps.append((length, most, reach))
        part = 1
        while most:
            take = min(part, most)
            reach |= (reach << (take * length)) & full
            most -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if at >= k * length and before >> (at - k * length) & 1)
        if k:
            used[length] = k
            at -= k * length
    return used


@dataclass
class Plan:
    """Intervals of pieces of one length, in order of (length, first number): pieces number
    first, first + 1, ... go, ``per`` to a sequence, to sequences from ``sequence`` on, at
    ``offset``, ``offset + length``, ... there."""

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces."""
        # both parts of the key in one order: intervals of a length are next to each other
        lo = np.searchsorted(self.length, length, "left")
        hi = np.searchsorted(self.length, length, "right")
        while (open_ := hi - lo > 1).any():  # the last interval that begins at or before number
            mid = np.where(open_, (lo + hi) // 2, lo)
            up = self.first[mid] <= number
            lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid, hi)
        k = number - self.first[lo]
        return self.sequence[lo] + k // self.per[lo], self.offset[lo] + k % self.per[lo] * length


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """counts: how many pieces have each length."""
    left, used, rows, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while left:
        largest = max(left)
        left[largest] -= 1
        fill = closest_fill(left, window - largest)
        left[largest] += 1
        fill[largest] = fill.get(largest, 0) + 1
        times, offset = min(left[k] // n for k, n in fill.items()), 0
        for k in sorted(fill, reverse=True):
            rows.append((k, used[k], fill[k], sequence, offset))
            offset += k * fill[k]
            used[k] += times * fill[k]
            left[k] -= times * fill[k]
            if not left[k]:
                del left[k]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence)


def pack(spark: SparkSession, cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """cut (a table of pieces(), read again from where it was written) with sequence_id and
    offset instead of task and number."""
    by_task = materialize(spark, cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    # at most ``window`` rows
    made = plan({r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    begin = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    placed = cut.join(by_task.select("task", "length", begin.alias("begin")), ["task", "length"])
    shared = spark.sparkContext.broadcast(made)
    names = [c for c in cut.columns if c not in ("task", "number")]
    fields = [f for f in cut.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("number").to_numpy(zero_copy_only=False)
            s, o = shared.value.place(b.column("length").to_numpy(zero_copy_only=False), number)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(s), pa.array(o)], [*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    return placed.select(*names, (F.col("number") + F.col("begin")).alias("number")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its ids, sequence_id and offset."""
    return pack(docs.sparkSession, materialize(docs.sparkSession, pieces(docs, path, end_id, window), "pieces"), window)


def sequences(packed: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """sequence_id, ids, n_tokens of pack_documents(): the ids of each sequence in order, padded to
    the window, except where their number is a power of two. A group has ``window`` ids at most."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    rows = rows.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    whole = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids")))).alias("ids"), "n_tokens")
