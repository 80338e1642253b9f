"""Streams of events and edges with the batch operators' results.

Cases: null keys are a key of their own; null times are in no window; repeated rows count each time;
an empty stream gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import FAILURES, WINDOW
from ..session import shared_path
from ..sources import store


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of a folder's event files, with a time that watermarks can use."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows; rows later than ``late`` don't count."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def breaker(stream: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """key, order, tripped for each outcome: the last WINDOW outcomes of a key are its state. Within
    a micro-batch a key's outcomes go by order, from one micro-batch to the next by arrival; a null
    outcome didn't fail."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        # a key's rows of one micro-batch, by numbers alone: 9 bytes a row
        parts = [(b[order].to_numpy(), b["failed"].fillna(False).to_numpy(bool)) for b in batches]
        at, failed = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(at, kind="stable")
        at, failed = at[by], failed[by]
        before = np.r_[np.array(last, bool), failed]
        n = np.cumsum(np.r_[0, before])
        end = np.arange(len(last) + 1, len(before) + 1)
        tripped = n[end] - n[np.maximum(0, end - WINDOW)] >= FAILURES
        state.update(([bool(x) for x in before[-WINDOW:]],))
        for lo in range(0, len(at), 10_000):
            yield pd.DataFrame({key: k[0], order: at[lo : lo + 10_000], "tripped": tripped[lo : lo + 10_000]})

    return stream.select(key, order, "failed").groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, tripped boolean", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def confirmations(stream: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, reports, confirmed of a stream of reports, so far: a counter a key, kept by the engine."""
    return stream.groupBy(*keys).agg(F.count("*").alias("reports")).withColumn("confirmed", F.col("reports") >= least)


def run_to_end(stream: DataFrame, mode: str, tag: str) -> DataFrame:
    """What the stream gives for all that is there now. Rows and the checkpoint go to the shared
    folder, none to the driver; in complete mode the last result replaces those before."""
    spark = stream.sparkSession
    path = shared_path(spark, tag)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def apply_stream(changed: DataFrame, fresh, root: str, tag: str = "edges") -> None:
    """Bring the stored edges below a root up to date with a stream of changes (file, change, was):
    fresh(changes) gives the new edges of a micro-batch. A micro-batch replaces the snapshot at once,
    and so counts once however often it is run."""
    spark = changed.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        from ..operators.edges import apply_changes

        old = store.read(spark, f"{root}/{tag}", store.EDGES)
        store.replace(apply_changes(old, batch, fresh(batch)), f"{root}/{tag}")

    q = changed.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint-{tag}").trigger(availableNow=True).start()
    q.awaitTermination()
