"""Files, lines, scripts and links as tables.

Cases: files that aren't UTF-8 lose the bytes that aren't, images have a null text; null texts have no
lines, scripts or links; an empty text has one empty line; repeated rows are repeated in what comes of
them; an empty folder or table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders that a scan never enters, beside those whose names begin with a dot.
SKIPPED = ("__pycache__", "node_modules", "build", "dist")
#: Folders of tests.
TEST_FOLDERS = ("tests", "test", "benchmark_bugs", "fixtures", "testdata", "specs")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, skip_tests: bool = False, ignore_folders: list[str] | None = None) -> DataFrame:
    """path (below root), class, size, modified, fingerprint, text of every file below root,
    without dot folders, SKIPPED ones and what ``ignore`` fits. Contents are read by executors;
    what a filter on path, class or size leaves out is not decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.element_at(F.split("path", re.escape(base) + "/", 2), 2)
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    out = out.where(~F.col("path").rlike(r"(^|/)(\.[^/]+|" + "|".join(map(re.escape, [*SKIPPED, *(ignore_folders or [])])) + ")/"))
    if ignore:
        out = out.where(~T.ignored(F.col("path"), ignore))
    if skip_tests:
        out = out.where(~F.col("path").rlike(r"(^|/)(" + "|".join(TEST_FOLDERS) + r")/|(^|/)test_[^/]*$|_test\.py$"))
    image = T.extension(F.col("path")).isin(*T.IMAGE_EXTENSIONS)
    return out.select("path", T.file_class(F.col("path")).alias("class"), "size", "modified", T.content_fingerprint(F.col("content"), F.col("size")).alias("fingerprint"), F.when(~image, T.decoded(F.col("content"))).alias("text"))


def lines(df: DataFrame, key: str, text: str = "text", around: int = 0, python: Column | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """key, line (from 1), code; with around, also the lines up to so many before and after, joined
    (only: just for lines that contain one of these in lower case, others stand alone); with python (which rows are Python code), also quoted: whether a line is within, or on the edge
    of, a triple-quoted string that stands alone. Both come from the whole text: neither needs a
    window or a shuffle."""
    if not around and python is None:
        return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "code")).select(key, (F.col("pos") + 1).alias("line"), "code")
    joined = lambda i: F.array_join(F.slice("__all", F.greatest(F.lit(1), i + 1 - around), around + 1 + F.least(F.lit(around), i)), "\n")
    near = lambda c, i: F.when(reduce(or_, [F.lower(c).contains(x) for x in only]), joined(i)).otherwise(c) if only else joined(i)
    mark = "\x01"
    # between quotes are the odd parts; each of their lines gets a mark where the quotes open a line
    bare = lambda i: F.get("__parts", i - 1).rlike(r"(^|\n)[ \t]*[rRbBuUfF]{0,2}$")
    inside = lambda x, i: F.when((i % 2 == 1) & bare(i), F.concat(F.lit(mark), F.replace(x, F.lit("\n"), F.lit("\n" + mark)))).otherwise(x)
    flags = F.transform(F.split(F.array_join(F.transform("__parts", inside), "'"), "\n"), lambda x: x.contains(mark))
    split = df.select(key, F.split(text, "\n").alias("__all"), (F.split(F.replace(text, F.lit(mark), F.lit(" ")), "\"\"\"|'''") if python is not None else F.array()).alias("__parts"), (F.lit(False) if python is None else python).alias("__python"))
    split = split.withColumn("__flags", F.when(F.col("__python"), flags))
    cells = lambda c, i: F.struct(c.alias("code"), *([near(c, i).alias("around")] if around else []), *([F.coalesce(F.get("__flags", i), F.lit(False)).alias("quoted")] if python is not None else []))
    rows = split.select(key, F.posexplode(F.transform("__all", cells)).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).alias("line"), "r.*")


def summaries(files: DataFrame) -> DataFrame:
    """path, size, summary of data files: their first three lines that have text, joined and cut
    at 60 characters."""
    first = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.array_join(first, " | ")
    return files.where("class = 'weed'").select("path", "size", F.coalesce(F.when(F.length(joined) > 60, F.concat(F.substring(joined, 1, 60), F.lit("..."))).otherwise(joined), F.lit("")).alias("summary"))


def inline_scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, script (from 0), code of scripts written into pages."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("script", "code")).where(F.trim("code") != "")


def links(pages: DataFrame) -> DataFrame:
    """page_id, host (of the page), target (host of the link, or the page's own), href, internal."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    found = pages.select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    other = F.regexp_extract("href", "^[a-z]+://([^/?#]+)", 1)
    return found.select("page_id", "host", F.when(other == "", F.col("host")).otherwise(other).alias("target"), "href", (other == "").alias("internal"))
