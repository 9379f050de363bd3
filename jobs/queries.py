"""The jobs as registered queries: each runs its job twice into a new folder and returns what then stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import entity_index, stream_memory
from jobs.common import beside
from recollect.plans import oracle
from recollect.session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents with their entities, taken by the stream; the second run finds nothing new."""
    at, docs = folder(spark, "stream-memory"), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        stream_memory.run(spark, docs, f"{at}/memory", f"{at}/checkpoint", beside(stream_memory.__file__))
    rows = stream_memory.memory(spark, f"{at}/memory")
    return rows.select("project", "doc_id", "chunk", "text", F.array_join("entities", "|").alias("entities"), "n_facts")


def job2_entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity index of all sources, computed twice into one folder."""
    at = folder(spark, "entity-index")
    for _ in range(2):
        entity_index.run(spark, f"{sf_dir}/documents.parquet", at, beside(entity_index.__file__))
    return entity_index.read_index(spark, at)


QUERIES = {"job1_stream_memory": job1_stream_memory, "job2_entity_index": job2_entity_index}

ORACLE = {
    "job1_stream_memory": rf"""with named as (select doc_id, coalesce(source, 'unknown') as source, coalesce(text, '') as text from documents), {oracle.raw_facts(200, 20, "named")}
        select d.source as project, f.doc_id, f.chunk, f.text, array_to_string(f.once, '|') as entities, len(f.facts)::int as n_facts from f join named d using (doc_id)""",
    "job2_entity_index": rf"""with named as (select doc_id, coalesce(source, 'unknown') as source, coalesce(text, '') as text from documents),
        normal as (select *, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) as norm from named),
        kept as (select doc_id, source, text from (select *, row_number() over (partition by source, md5(norm) order by doc_id) as r from normal) where not (length(norm) > 200 and r > 1)),
        {oracle.raw_facts(200, 20, "kept")},
        m as (select k.source as project, f.doc_id, f.base + i - 1 as seq, once[i] as name, lower(once[i]) as entity from f join kept k using (doc_id), range(1, 11) t(i) where i <= len(once)),
        per as (select project, entity, min_by(name, seq) as name, count(*) as mentions, count(distinct doc_id) as documents, min(doc_id) as first_doc from m where entity not in ('image', 'source', 'method', 'chunk') group by project, entity),
        e as (select distinct k.source as project, lower(pairs[i].s) as s, lower(pairs[i].t) as t from f join kept k using (doc_id), range(1, 11) t(i) where i <= len(pairs)),
        dg as (select project, entity, count(*) as degree from (select project, s as entity from e union all select project, t from e) group by project, entity),
        shared as (select entity, count(*) - 1 as shared_with from per group by entity)
        select entity, name, mentions, documents, coalesce(degree, 0)::bigint as degree, (2 * coalesce(degree, 0) + mentions)::bigint as score, first_doc, shared_with::bigint as shared_with, project
        from per left join dg using (project, entity) join shared using (entity)""",
}
