"""Incremental memory of documents: a file stream takes what is new, and writes passages with their entities.

    python -m jobs.stream_memory --documents DIR --out DIR --checkpoint DIR [--config FILE]

``--documents`` is a folder (or one file) of Parquet with ``doc_id``, ``text`` and ``source``. The stream takes files that
the checkpoint does not know, and stops. A document that an earlier batch holds with the same text is left alone; one
whose text or source changed replaces its passages. ``out/passages`` is partitioned by batch and project, ``out/manifest``
by batch. A batch that was stopped runs again under its number and overwrites its own partitions, so that runs may
break off at any place; a run without new files changes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobs.common import beside, command_line, settings
from recollect.operators import chunk, extract
from recollect.sources import files, manifest

log = logging.getLogger("jobs.stream_memory")

DEFAULTS = {"chunk_words": 200, "overlap": 20, "files_per_batch": 1000}
PASSAGES = "key string, doc_id long, chunk int, text string, entities array<string>, n_facts int, batch long, project string"
MANIFEST = "key string, doc_id long, project string, hash string, chars long, batch long"


def shaped(rows: DataFrame) -> DataFrame:
    """Documents with a key and a hash of what matters; null ids are known by their content, null sources are ``unknown``."""
    text, project = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("unknown"))
    digest = F.sha2(F.concat_ws("\x1f", project, text), 256)
    # keys of equal length, so that their order is that of the ids and file statistics can rule out what a batch does not touch
    key = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.concat(F.lit("~"), digest))
    return rows.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), project.alias("project"), digest.alias("hash"), text.alias("body"), F.col("_metadata.file_modification_time").alias("modified"))


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if files._exists(spark, path) else spark.createDataFrame([], schema)


def last(entries: DataFrame) -> DataFrame:
    """The manifest's latest entry of each document."""
    best = entries.groupBy("key").agg(F.max_by(F.struct("hash", "batch"), "batch").alias("m"))
    return best.select("key", "m.hash", "m.batch")


def take(out: str, conf: dict, taken: list[int] | None = None):
    """A function for ``foreachBatch``; the same batch again gives the same partitions. ``taken`` gets each batch's row count."""

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        # of several versions in one batch the one of the newest file counts
        newest = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max_by(F.struct("doc_id", "project", "hash", "body"), F.struct("modified", "hash")).alias("d"))
        newest = newest.select("key", "rows", "d.*").persist()
        count, low, high = newest.agg(F.sum("rows"), F.min("key"), F.max("key")).first()
        if count:
            earlier = read(spark, f"{out}/manifest", MANIFEST).where((F.col("batch") < number) & F.col("key").between(low, high))
            fresh = manifest.diff(newest, last(earlier), "key").where("status <> 'cached'")
            docs = fresh.select("project", F.col("key").alias("file"), F.coalesce("doc_id", F.lit(0)).alias("doc_ord"), "doc_id", "body")
            chunks = chunk.chunk_documents(docs, conf["chunk_words"], conf["overlap"], None)
            parsed = extract.parse_responses(extract.run_offline(chunks.withColumn("passage", F.col("text"))), ["doc_id", "passage"])
            passages = parsed.select(
                F.col("file").alias("key"), "doc_id", "chunk", F.col("passage").alias("text"), F.transform("entities", lambda e: e["name"]).alias("entities"),
                F.size("facts").alias("n_facts"), F.lit(number).cast("long").alias("batch"), "project",
            )
            entries = fresh.select("key", "doc_id", "project", "hash", F.length("body").cast("long").alias("chars"), F.lit(number).cast("long").alias("batch"))
            overwrite(passages, f"{out}/passages", "batch", "project")
            # the manifest comes last: a batch that stopped before is done again whole
            overwrite(entries.sort("key"), f"{out}/manifest", "batch")
            n, chars = read(spark, f"{out}/manifest", MANIFEST).where(F.col("batch") == number).agg(F.count(F.lit(1)), F.sum("chars")).first()
            log.info("batch %d: read %d rows, wrote %d new or changed documents of %d characters", number, count, n, chars or 0)
        newest.unpersist()
        if taken is not None:
            taken.append(count or 0)

    return run


def overwrite(rows: DataFrame, path: str, *by: str) -> None:
    """Write partitions in place of those of the same values; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def start(spark: SparkSession, documents: str, out: str, checkpoint: str, config: str | None = None, taken: list[int] | None = None) -> StreamingQuery:
    """Start the stream over the files that are there; it stops when it has taken them."""
    conf = settings(DEFAULTS, config)
    schema = spark.read.parquet(documents).schema
    # files with old times are taken as well, in whichever run they come
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"]).option("maxFileAge", "100000d")
    if files.is_file(spark, documents):  # a stream reads folders
        documents, name = documents.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    rows = reader.parquet(documents)
    writer = shaped(rows).writeStream.foreachBatch(take(out.rstrip("/"), conf, taken)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: str | None = None) -> dict:
    """Take what is new; returns the number of rows read in this run and of documents known after it."""
    taken: list[int] = []
    start(spark, documents, out, checkpoint, config, taken).awaitTermination()
    known = last(read(spark, f"{out.rstrip('/')}/manifest", MANIFEST)).count()
    log.info("read %d rows of %s in %d batches; %s knows %d documents", sum(taken), documents, len(taken), out, known)
    return {"rows_read": sum(taken), "documents": known}


def memory(spark: SparkSession, out: str) -> DataFrame:
    """The passages as they stand: those of each document's latest version."""
    out = out.rstrip("/")
    entries = read(spark, f"{out}/manifest", MANIFEST)
    gone = entries.join(last(entries).select("key", F.col("batch").alias("_last")), "key").where("batch < _last").select("key", "batch")
    return read(spark, f"{out}/passages", PASSAGES).join(gone, ["key", "batch"], "left_anti")


if __name__ == "__main__":
    raise SystemExit(command_line("incremental memory of documents", ["documents", "out", "checkpoint"], beside(__file__), run))
