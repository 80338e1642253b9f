"""Feedback over outcomes: circuit breakers, confirmation by repetition, convergence.

Cases: a null outcome is an outcome that didn't fail; null keys are a key of their own; of equal order
values either comes first; repeated rows are outcomes of their own; empty tables give no rows; other
columns are kept by the breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes that a breaker looks back on, and failures that trip it.
WINDOW, FAILURES = 3, 2


def breaker(outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """outcomes (key, order, failed) with tripped: FAILURES of the last WINDOW outcomes failed."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(-(WINDOW - 1), 0)
    return outcomes.withColumn("tripped", F.sum(F.coalesce(F.col("failed"), F.lit(False)).cast("int")).over(last) >= FAILURES)


def last_reasons(outcomes: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """key, reasons: the last reasons (failed outcomes with one) of each key, the newest last. Only
    ``most`` rows of a key are gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    own = outcomes.where("failed and reason is not null").withColumn("__n", rank).where(F.col("__n") <= most)
    return own.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "reason"))), lambda x: x["reason"]).alias("reasons"))


def confirmed(reports: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """key, reports: what has been reported ``least`` times or more."""
    return reports.groupBy(*key).agg(F.count("*").alias("reports")).where(F.col("reports") >= least)


def converged(events: DataFrame, round_: str, most: int = 2) -> DataFrame:
    """round, events, converged: rounds of at most ``most`` events have converged."""
    return events.groupBy(round_).agg(F.count("*").alias("events")).withColumn("converged", F.col("events") <= most)
