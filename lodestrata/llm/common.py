"""Helpers that the corpus operators share: tables, shared storage, caches.

Cases that every operator of this package treats alike: a null text counts as the
empty text, a null id stays null, repeated rows stay repeated rows, an empty table
gives an empty result, and columns other than the ones an operator names are never
looked at (so they may have any name, also that of a result column).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in most operators: space and \t \n \v \f \r.
ASCII_SPACES = " \t\n\x0b\x0c\r"
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """The two columns that operators on documents need, null texts as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def lower_az(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (local tests) does it become a temporary folder of this
    machine, and only in local mode.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"
    atexit.register(release, spark, path)
    return path


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without running the
    passes over whole texts again, and sees rows in a fixed order of fixed files.
    """
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def release(spark: SparkSession, path) -> None:
    """Delete a table that materialize() wrote (the table or its path)."""
    path = getattr(path, "_lodestrata_path", path)
    try:
        if spark.sparkContext._jsc is None or not isinstance(path, str):
            return
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the shared folder's owner cleans up
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class TwoGenerationCache(dict):
    """A dict bounded by the memory of its entries: when half of ``most`` bytes are used, what
    wasn't asked for since the last time goes.

    ``fetch(keys)`` makes all keys present; ``make(list of new keys)`` gives their values. Only
    the keys of one call are held beyond the bound.
    """

    #: Bytes of an entry beside its key and value: slots of the dict, headers of two objects.
    ENTRY = 200

    def __init__(self, make, most: int = 64 << 20):
        super().__init__()
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def _weight(self, keys, values) -> int:
        return self.ENTRY * len(keys) + sum(map(len, keys)) + sum(len(v) for v in values if type(v) is bytes)

    def fetch(self, keys: set) -> None:
        new = [k for k in keys if k not in self]
        if self.size > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.size, new = 0, keys
        if self.old:
            old, missing, found = self.old, [], {}
            for k in new:
                if (v := old.get(k)) is None:
                    missing.append(k)
                else:
                    found[k] = v
            self.update(found)
            self.size += self._weight(found, found.values())
            new = missing
        if new:
            new = list(new)
            values = self.make(new)
            self.update(zip(new, values, strict=True))
            self.size += self._weight(new, values)

    def release(self) -> None:
        self.clear()
        self.old, self.size = {}, 0
