"""Which files changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, manifest: DataFrame, key: str = "rel_path") -> DataFrame:
    """``files(rel_path, hash)`` with ``status``: ``cached``, ``changed`` or ``new``."""
    old = manifest.select(key, F.col("hash").alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("hash") == F.col("_old"), "cached").otherwise("changed")
    return files.join(old, key, "left").withColumn("status", status).drop("_old", "_known")


def untouched(listed: DataFrame, manifest: DataFrame, key: str = "rel_path") -> DataFrame:
    """Keys of listed files whose size and time are those of the manifest: their content need not be read."""
    old = manifest.select(key, F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    return listed.join(old, key).where("size = _size and modified = _modified").select(key)


def current(log: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a log as they stand: of each key those of the highest ``version``, unless these say that it is ``gone``.

    Keys and versions alone decide which rows are superseded; a log without any (a compact one) is read as it lies, and one of
    a single version needs no look at its keys.
    """
    narrow = log.select(*key, "version", "gone")
    low, high, gone = narrow.agg(F.min("version"), F.max("version"), F.max("gone")).first()
    if low == high and not gone:
        return log
    last = narrow.groupBy(*key).agg(F.max("version").alias("_last"))
    dead = narrow.join(last, key).where("version < _last or gone").select(*key, "version").distinct()
    return log if dead.isEmpty() else log.join(dead, [*key, "version"], "left_anti").select(*log.columns)
