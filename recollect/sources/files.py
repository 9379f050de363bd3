"""Source folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import suffix

LISTED = "project string, rel_path string, size long, modified timestamp"
FILES = f"{LISTED}, hash string, content binary"


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, which may be a remote one, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def wanted(path: Column) -> Column:
    """Neither junk names, resource forks nor pointer stubs."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return ~name.isin(config.SKIP_NAMES) & ~name.startswith("._") & ~suffix(path).isin(config.SKIP_EXTS)


def _shaped(raw: DataFrame, root: str, project: str, *more: Column) -> DataFrame:
    # paths come URI-encoded; what follows the root folder is the relative path
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    base = "/" + root.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    rel = F.substring_index(path, base, -1)
    rows = raw.select(F.lit(project).alias("project"), rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *more)
    return rows.where(wanted(F.col("rel_path")))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("project", "rel_path", "size", "modified", F.sha2("content", 256).alias("hash"), "content")


def _folder(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def listing(spark: SparkSession, root: str, project: str, max_files: int | None = None) -> DataFrame:
    """``(project, rel_path, size, modified)`` of all files under ``root`` but junk; no content is read.

    A missing folder gives no rows; files without a byte are not listed. ``max_files`` keeps the first in path order.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], LISTED)
    rows = _shaped(_folder(spark, root), root, project)
    return rows if max_files is None else rows.orderBy("rel_path").limit(max_files)


def contents(spark: SparkSession, root: str, project: str, listed: DataFrame) -> DataFrame:
    """The files of a listing (a written one) with content and SHA-256.

    Spark opens only files whose time lies between the listing's first and last, a condition on file metadata; for what
    a few files lie around in time, the join decides. An empty listing opens none.
    """
    first, last = listed.agg(F.unix_micros(F.min("modified")), F.unix_micros(F.max("modified"))).first()
    if first is None:
        return spark.createDataFrame([], FILES)
    raw = _folder(spark, root).where(F.col("modificationTime").between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))))
    rows = _shaped(raw, root, project, F.col("content"))
    return _hashed(rows.join(listed.select("rel_path"), "rel_path", "left_semi"))


def scan(spark: SparkSession, root: str, project: str, max_files: int | None = None) -> DataFrame:
    """All files under ``root`` but junk, with content and SHA-256; a missing folder gives no rows.

    ``max_files`` keeps the first in path order.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], FILES)
    rows = _shaped(_folder(spark, root), root, project, F.col("content"))
    return _hashed(rows if max_files is None else rows.orderBy("rel_path").limit(max_files))


def stream(spark: SparkSession, root: str, project: str, per_batch: int = 1000) -> DataFrame:
    """New files under ``root`` as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    return _hashed(_shaped(raw, root, project, F.col("content")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, unusable ones as nulls; a missing path gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
