"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) from md5, which SQL engines agree on."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))
