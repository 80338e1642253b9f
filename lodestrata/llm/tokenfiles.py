"""Token ids in ORC files, in ascending order of document ids.

A row is a document: doc_id, first (ids of the file before it), n_tokens, ids. ORC encodes the
integers by run lengths and bit widths and keeps, for each stripe and each group of rows, the
least and greatest doc_id and a Bloom filter of them; readers take stripes in parallel and skip
those that can't hold what is asked for. Documents are dealt to files by ranges of doc_id, as
many as the size of their texts asks for, so file order is document order and a document's place
in the corpus is the number of ids in earlier files plus ``first``. Many rows of one id share
several files.

Cases: null and empty texts are documents with the end id only; null ids come first; repeated
rows are rows of their own, in any order among themselves; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, partitions
from .tokens import library_encoder

SCHEMA = "doc_id long, first long, n_tokens long, ids array<int>"
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}

#: Bytes of text that a file holds at most, on average.
FILE_BYTES = 128 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int | None = None) -> None:
    """Write every document's ids, with end_id behind them, to ORC files below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, first = library_encoder(vocabulary), int(end_id).to_bytes(4, "little"), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                ids = [x + end for x in encoder.encode_many(b.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.r_[0, np.cumsum(n)]
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first + ends[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], ["doc_id", "first", "n_tokens", "ids"])
                first += int(ends[-1])
        encoder.release()

    docs = documents(docs)
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(partitions(docs.sparkSession), -(-size // FILE_BYTES))
    # rows of one id may be many: their place in the input deals them out, too
    dealt = docs.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, "doc_id", "place").sortWithinPartitions("doc_id")
    # a file a task: ``first`` counts from its task's start
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**OPTIONS, maxRecordsPerFile=0).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. A filter on doc_id
    reaches the files' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # a row for each file; its name has the number of its range
    name = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    totals = rows.groupBy(name.alias("file")).agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    begin = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("begin"))
    return rows.withColumn("file", name).join(F.broadcast(begin), "file").select("doc_id", (F.col("begin") + F.col("first")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_tokens(), the last two from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """read_tokens() of files that write_tokens() has written to the shared folder."""
    path = new_path(docs.sparkSession, "tokens-orc")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
