"""Tables that are kept: snapshots that are replaced whole, older formats, configuration, sinks.

A snapshot is a folder of Parquet files; a new one is written beside it and then takes its place by one
rename, so that readers see the old rows or the new ones, and a failed write changes nothing.

Cases: a snapshot that isn't there reads as an empty table; null fields stay null (normalising: their
defaults); repeated rows are kept; an empty table can be stored; columns that a schema doesn't have are
dropped, those that are missing are null.
"""

from __future__ import annotations

import json
import tomllib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gram_hashes

#: The version of what is stored; older snapshots are built anew.
SCHEMA_VERSION = 3
EDGES = "id string, source string, target string, symbol string, relation string, kind string, confidence double, verified boolean"
FILES = "path string, size long, modified timestamp, fingerprint string"
INDEX = "path string, symbols array<string>, grams array<string>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace(df: DataFrame, path: str, format_: str = "parquet") -> None:
    """Put a table in the place of the one at a path."""
    spark = df.sparkSession
    beside, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").format(format_).save(beside)
    fs, there = _fs(spark, path)
    to = lambda p: _fs(spark, p)[1]
    fs.delete(to(old), True)
    if fs.exists(there):
        fs.rename(there, to(old))
    if not fs.rename(to(beside), there):
        raise OSError(f"can't put {beside} in place")
    fs.delete(to(old), True)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a snapshot, under a schema; none where there is no snapshot. A replacement that
    was cut short leaves the old rows beside it: they are read then."""
    fs, there = _fs(spark, path)
    if not fs.exists(there):
        path = f"{path}.old"
        if not fs.exists(_fs(spark, path)[1]):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def version(spark: SparkSession, root: str) -> int:
    """The version of the snapshots below a root, or 0."""
    got = read(spark, f"{root}/version", "version int").first()
    return got.version if got else 0


def current(spark: SparkSession, root: str) -> bool:
    """Whether what is stored can be brought up to date; else it has to be built anew."""
    return version(spark, root) >= SCHEMA_VERSION


def save(spark: SparkSession, root: str, **tables: DataFrame) -> None:
    """Replace snapshots below a root, and last of all their version: until then a reader that asks
    current() of a new root builds anew."""
    for name, df in tables.items():
        replace(df, f"{root}/{name}")
    replace(spark.createDataFrame([(SCHEMA_VERSION,)], "version int"), f"{root}/version")


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an older store: a JSON array, or lines, of records that may lack any field."""
    raw = spark.read.schema("source string, target string, symbol string, relation string, kind string, confidence double, verified boolean").option("multiLine", True).json(path)
    weak = F.col("kind") == "weak"
    return raw.select(
        "source", "target", "symbol",
        F.coalesce("relation", F.when(weak, "weak").otherwise("import")).alias("relation"),
        F.coalesce("kind", F.lit("strong")).alias("kind"),
        F.coalesce("confidence", F.when(weak, 0.5).otherwise(1.0)).alias("confidence"),
        F.coalesce("verified", F.coalesce("kind", F.lit("strong")) == "strong").alias("verified"),
    ).where("source is not null or target is not null")


def config(spark: SparkSession, candidates: list[str]) -> dict:
    """The first of some TOML or JSON files that is there, read on the driver; {} without one, or
    where it can't be parsed. Later files are not merged in."""
    for path in candidates:
        try:
            row = spark.read.text(path, wholetext=True).first()
        except AnalysisException:
            continue
        if row is not None:
            try:
                return tomllib.loads(row.value) if path.endswith(".toml") else json.loads(row.value)
            except ValueError:
                return {}
    return {}


def index_entries(files: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """path, symbols, grams of files (path, text): what a search looks through."""
    none = F.array().cast("array<string>")
    return files.select("path", gram_hashes(F.col("text"), limit).alias("grams")).join(symbols, "path", "left").select("path", F.coalesce("symbols", none).alias("symbols"), F.coalesce("grams", none).alias("grams"))


def refresh_index(index: DataFrame, files: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """The index with entries for files that it lacks, and without those whose files are gone: only
    what is missing is built."""
    missing = files.join(index.select("path"), "path", "left_anti")
    return index.join(files.select("path"), "path", "left_semi").unionByName(index_entries(missing, symbols, limit))


def to_json(df: DataFrame) -> DataFrame:
    """json: a record a row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def from_json(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """The records of a column under a schema; what is no record is left out."""
    return df.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")
