"""Index of the entities of all projects: how often, where and how connected each is, and which projects share it.

    python -m jobs.entity_index --documents PATH --out DIR [--config FILE]

``--documents`` is Parquet with ``doc_id``, ``text`` and ``source``; a source is a project. Copies within a project count
once. ``out`` is partitioned by project. Every run computes the index from the documents and replaces what it wrote
before, so runs may be repeated; ``projects`` in the config file names those to compute, and leaves the others' partitions.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import beside, command_line, settings
from recollect.operators import chunk, dedup, extract, graph, resolve
from recollect.session import Cut, scratch

log = logging.getLogger("jobs.entity_index")

DEFAULTS = {"chunk_words": 200, "overlap": 20, "projects": []}
INDEX = "entity string, name string, mentions long, documents long, degree long, score long, first_doc long, shared_with long, project string"


def index(docs: DataFrame, chunk_words: int, overlap: int) -> DataFrame:
    """``docs(project, file, doc_ord, doc_id, body)`` -> one row for each project and entity.

    ``mentions`` counts passages, ``degree`` distinct relations; the score is that of the digest. ``shared_with`` is how many
    other projects know the entity. Everything is aggregated by map-side partials before it is joined, so an entity or
    project with a third of all mentions is a few rows a task.
    """
    # a copy counts where it came first; hashes decide, texts stay where they are
    copies = dedup.exact_duplicates(docs.select("project", "file", "doc_ord", "body")).where("duplicate").select("project", "file")
    kept = docs.join(copies, ["project", "file"], "left_anti")
    parsed = extract.parse_responses(extract.run_offline(chunk.chunk_documents(kept.drop("doc_id"), chunk_words, overlap, None)))
    # mentions and relations come from one extraction
    parsed = Cut(parsed.select(*extract.CHUNK, "entities", "relations", "facts"), "index-parsed").df
    raw, relations, _ = extract.raw_tables(parsed)
    named = resolve.mentions_of(raw)
    doc = F.shiftright("seq", 24).alias("doc")
    per_doc = named.groupBy("project", F.col("nm").alias("entity"), doc).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    per = per_doc.groupBy("project", "entity").agg(F.min_by("name", "seq").alias("name"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("documents"), F.min("doc").alias("first_doc"))
    per = Cut(per, "index-entities").df
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    edges = graph.dedup_edges(relations.where("grounded").select("project", "seq", key("source").alias("src"), key("target").alias("dst"), "relation", "file").where("src <> dst"))
    degree = graph.degrees(edges).withColumnRenamed("id", "entity")
    known = per.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("shared_with"))
    rows = per.join(degree, ["project", "entity"], "left").join(known, "entity")
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    return rows.select("entity", "name", "mentions", "documents", degree.alias("degree"), (2 * degree + F.col("mentions")).alias("score"), "first_doc", "shared_with", "project")


def shaped(docs: DataFrame) -> DataFrame:
    project = F.coalesce("source", F.lit("unknown"))
    # rows without an id are told apart by their content
    file = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(project.alias("project"), file.alias("file"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_ord"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body")).dropDuplicates(["project", "file"])


def run(spark: SparkSession, documents: str, out: str, config: str | None = None) -> dict:
    """Write the index; returns how many projects and entities it holds."""
    conf = settings(DEFAULTS, config)
    # full runs replace everything, runs of some projects only their partitions
    mode = "dynamic" if conf["projects"] else "static"
    with scratch(spark):
        found = index(shaped(spark.read.parquet(documents)), conf["chunk_words"], conf["overlap"])
        if conf["projects"]:
            # what projects share is known from all of them; only the rows of some are written
            found = found.where(F.col("project").isin(conf["projects"]))
        found.repartition("project", F.pmod(F.xxhash64("entity"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("project").parquet(out)
    projects, entities = read_index(spark, out).agg(F.count_distinct("project"), F.count(F.lit(1))).first()
    log.info("read %s; %s holds %d entities of %d projects", documents, out, entities, projects)
    return {"projects": projects, "entities": entities}


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(out)


if __name__ == "__main__":
    raise SystemExit(command_line("index of entities", ["documents", "out"], beside(__file__), run))
