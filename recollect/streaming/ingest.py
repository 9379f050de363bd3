"""Continuous ingestion: a file stream appended to the memory's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.memory import Memory
from recollect.session import Cut
from recollect.sources import convert, files, manifest


def upsert(memory: Memory, project: str):
    """A function for ``foreachBatch``: converts a batch's files and appends what is new; a batch again appends nothing new.

    What is written is in proportion to the batch: rows of earlier batches stay where they are (see ``Memory.append``).
    """

    def run(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("project", "rel_path").agg(F.max_by(F.struct("hash", "content", "size", "modified"), "modified").alias("f")).select("project", "rel_path", "f.*")
        status = manifest.diff(last, memory.read("manifest", project).select("rel_path", "hash"))
        done = Cut(convert.convert_files(status.where("status <> 'cached'"), memory.converters), "converted")
        if not done.df.isEmpty():
            memory.record(done.df, project)
        done.drop()

    return run


def ingest_stream(memory: Memory, source_dir: str, project: str, checkpoint: str, once: bool = True):
    """Start the stream; with ``once`` it takes what is there and stops."""
    rows = files.stream(memory.spark, source_dir, project)
    writer = rows.writeStream.foreachBatch(upsert(memory, project)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
