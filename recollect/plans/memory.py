"""A memory of projects in one folder of tables: build, update, query, expand, link, export."""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import dot
from recollect.operators import chunk, dedup, digest, expand, extract, graph, link, similar, vectors
from recollect.operators.graph import Graph
from recollect.session import Cut, scratch
from recollect.sources import convert, files, manifest, sinks

TABLES = {
    "manifest": "project string, rel_path string, size long, modified timestamp, hash string, chars long, method string, extracted_hash string, version long, gone boolean",
    "documents": "project string, rel_path string, hash string, method string, chars long, body string, version long, gone boolean",
    "parsed": "version long, gone boolean, project string, file string, doc_ord long, chunk int, error string, parse_ok boolean, entities array<struct<name:string,type:string,description:string,aliases:array<string>>>, relations array<struct<source:string,relation:string,target:string,grounded:boolean>>, facts array<struct<text:string,entities:array<string>>>",
    "nodes": "project string, ord long, id string, name string, type string, description string, aliases array<string>, sources array<string>, mentions long, degree long, facts array<string>, from_project string",
    "edges": "project string, ord long, source string, relation string, target string, count long, files array<string>, from_project string",
    "facts": "project string, ord long, text string, nodes array<string>, file string, from_project string",
    "vectors": "project string, pos long, kind string, id string, name string, type string, description string, text string, nodes array<string>, facts array<string>, sources array<string>, file string, vec array<float>, dim int, model string, away double, cell int",
    "cells": "project string, cell int, pivot array<double>, least double, most double, n long, dim int, model string",
    "labels": "project string, text string, vec array<float>, model string",
    "extracted": "project string, state string",
    "derived": "project string, state string, model string",
    "projects": "project string, name string, source_dir string, model string, files long, updated string",
}

#: Columns by which a project's partition is parted further.
PARTED = {"vectors": ["cell"]}
#: Tables that only grow: a row stands until one of its key has a higher version.
LOGS = {"manifest": ["project", "rel_path"], "documents": ["project", "rel_path"], "parsed": ["project", "file"]}
#: Characters that Spark's writers escape in the names of partitions.
ESCAPED = {chr(c) for c in range(1, 32)} | set("\"#%'*/:=?\\{[]^\x7f")


def folder_of(project: str) -> str:
    """The name of a project's partition, as Spark's writers name it and its readers read it."""
    if not project:
        raise ValueError("a project needs a name")
    return "project=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in project)


class Memory:
    """Tables under ``root``, each partitioned by project.

    What is derived (graph, index) is replaced by a build; files, documents and answers are appended (see ``append``), so that
    what an update writes is in proportion to what changed.

    ``extractor`` makes a provider for chunks (None: the offline rules); ``embed_with`` is an embedding provider; ``converters``
    makes the conversion providers; ``summarise`` may write overviews. ``most_chunks`` bounds what is read of a document (None: all);
    entities whose vectors reach ``merge_cosine`` may merge (None: by names and aliases only).
    """

    def __init__(self, spark: SparkSession, root: str, extractor: Callable | None = None, embed_with=None, converters: Callable = convert.installed, summarise: Callable | None = None, most_chunks: int | None = config.MAX_CHUNKS, merge_cosine: float | None = config.MERGE_COSINE):
        self.spark, self.root = spark, root.rstrip("/")
        self.extractor, self.converters, self.summarise = extractor, converters, summarise
        self.most_chunks, self.merge_cosine = most_chunks, merge_cosine
        self.provider = embed_with or vectors.HashedWords()
        self.embed = vectors.embedder(self.provider)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, project: str | None = None) -> DataFrame:
        """A table, or the partition of one project; an absent one has no rows."""
        schema = TABLES[name]
        if not files._exists(self.spark, self.path(name)):
            return self.spark.createDataFrame([], schema)
        self._recover(name)
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        rows = rows.select(*[c.split()[0] for c in _columns(schema)])
        rows = rows if project is None else rows.where(F.col("project") == project)
        return manifest.current(rows, LOGS[name]) if name in LOGS else rows

    def write(self, name: str, rows: DataFrame, project: str) -> None:
        """Replace a project's partition; the rows may come from it.

        The new rows are written beside the old ones, in a folder that readers don't see, and the folders then change
        places by renaming: what stops in between loses nothing (see ``_recover``).
        """
        cols = [c.split()[0] for c in _columns(TABLES[name])]
        out, new, old = (f"{self.path(name)}/{mark}{folder_of(project)}" for mark in ("", "_new-", "_old-"))
        rows.select(*cols).drop("project").write.mode("overwrite").partitionBy(*PARTED.get(name, [])).parquet(new)
        fs, path = self._files(out)
        fs.delete(path(old), True)
        if fs.exists(path(out)):
            fs.rename(path(out), path(old))
        fs.rename(path(new), path(out))
        fs.delete(path(old), True)

    def append(self, name: str, rows: DataFrame, project: str) -> int:
        """Add rows to a project's part of a log: they stand in place of older rows of their keys. Their version comes back.

        Without a ``gone`` column they are there. Rows that a stopped run appended are superseded when it runs again.
        """
        cols = [c.split()[0] for c in _columns(TABLES[name])]
        rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
        version = time.time_ns()
        rows = rows.withColumn("version", F.lit(version))
        rows.select(*cols).drop("project").write.mode("append").parquet(f"{self.path(name)}/{folder_of(project)}")
        return version

    def compact(self, project: str) -> dict:
        """Rewrite a project's logs without rows that are superseded; counts of the rows left."""
        for name in LOGS:
            self.write(name, self.read(name, project), project)
        return {name: self.read(name, project).count() for name in LOGS}

    def record(self, converted: DataFrame, project: str) -> None:
        """Append converted files to documents and manifest; files without text are known, but are no documents."""
        self.append("documents", converted.withColumn("gone", F.col("chars") == 0), project)
        self.append("manifest", converted.withColumn("extracted_hash", F.lit(None).cast("string")), project)

    def _files(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _recover(self, name: str) -> None:
        """Put partitions back that a stopped ``write`` had moved away and not replaced."""
        fs, path = self._files(self.path(name))
        for found in fs.globStatus(path(f"{self.path(name)}/_old-project=*")) or []:
            out = path(f"{self.path(name)}/{found.getPath().getName().removeprefix('_old-')}")
            if not fs.exists(out):
                fs.rename(found.getPath(), out)

    def graph(self, project: str | None = None) -> Graph:
        return Graph(*(self.read(t, project) for t in ("nodes", "edges", "facts")))

    # --- build -------------------------------------------------------------------------------

    def ingest(self, source_dir: str, project: str, incremental: bool = True, max_files: int | None = None, prune: bool = False, verify: bool = False) -> dict:
        """Convert new and changed files; counts of what was done.

        Files are listed first. Those of the size and time that the manifest knows are not opened; of the others the
        content's hash decides, and ``verify`` has all of them opened. Nothing but converted files is written.
        """
        found = Cut(files.listing(self.spark, source_dir, project, max_files), "files")
        known = self.read("manifest", project) if incremental else self.read("manifest", project).limit(0)
        todo = found.df
        if incremental and not verify:
            todo = todo.join(manifest.untouched(found.df, known), "rel_path", "left_anti")
        todo = Cut(todo, "candidates")
        hashed = manifest.diff(files.contents(self.spark, source_dir, project, todo.df), known.select("rel_path", "hash"))
        done = Cut(convert.convert_files(hashed.where("status <> 'cached'"), self.converters), "converted")
        new, empty = done.df.agg(F.count(F.lit(1)), F.count_if(F.col("chars") == 0)).first()
        if new:
            self.record(done.df, project)
        if not todo.df.isEmpty():
            # touched, but of the same content: the manifest takes their new times
            same = todo.df.join(done.df.select("rel_path"), "rel_path", "left_anti").withColumnsRenamed({"size": "_size", "modified": "_modified"})
            seen = known.join(same.drop("project"), "rel_path").withColumns({"size": F.col("_size"), "modified": F.col("_modified")})
            self.append("manifest", seen, project)
        if prune:
            for name in ("documents", "manifest"):
                gone = self.read(name, project).join(found.df.select("rel_path"), "rel_path", "left_anti")
                self.append(name, gone.withColumn("gone", F.lit(True)), project)
        total = found.df.count()
        for held in (found, todo, done):
            held.drop()
        return {"total": total, "converted": new - empty, "cached": total - new, "empty_or_failed": empty}

    def extract(self, project: str, batch: int = 1000) -> dict:
        """Extract from documents whose content has not been extracted; documents with a failed chunk wait for the next run whole.

        A provider gets about ``batch`` documents at a time; what was answered in batches before it failed is kept. An outage ends
        the batch's job for all its tasks (see ``extract.Breaker``). Nothing is read where documents and what is extracted of them are
        as a run without failures left them.
        """
        held = self.read("extracted", project).first()
        if held is not None and held["state"] == self._extracted(project):
            return {"chunks": 0, "failed_chunks": 0, "documents": self._answered(project).select("file").distinct().count()}
        with scratch(self.spark):
            docs = self.read("documents", project).select("project", F.col("rel_path").alias("file"), "hash", "body")
            # keys, not texts, are ranked, compared and joined
            keys = Cut(dedup.document_keys(docs), "content-keys").df
            ranked = _ranked(keys, "file")
            keep = dedup.dedup_keys(ranked).where("skipped is null").select("file")
            state = self.read("manifest", project).select(F.col("rel_path").alias("file"), "extracted_hash")
            todo = ranked.join(keep, "file", "left_semi").join(state, "file", "left").where("extracted_hash is null or extracted_hash <> hash")
            todo = Cut(todo.select("file", "doc_ord"), "todo").df
            pending = docs.join(todo, "file").select("project", "file", "doc_ord", "body")
            if self.extractor is not None:
                pending = Cut(pending, "pending").df
            # older answers of documents that are read anew go first
            stale = self.read("parsed", project).join(todo, "file", "left_semi").select("project", "file").distinct()
            if not stale.isEmpty():
                empty = self.spark.createDataFrame([], TABLES["parsed"])
                self.append("parsed", empty.unionByName(stale.withColumn("gone", F.lit(True)), allowMissingColumns=True), project)
            # each batch's answers are kept as soon as they are there
            batches = 1 if self.extractor is None else max(1, -(-todo.count() // batch))
            counts, streak = {"chunks": 0, "failed_chunks": 0}, 0
            for b in range(batches):
                own = F.pmod(F.xxhash64("file"), F.lit(batches)) == b
                part, answered = pending.where(own), todo.where(own)
                chunks = chunk.chunk_documents(part, most=self.most_chunks)
                if self.extractor is None:
                    # the rules never fail, so their answers are kept as they come
                    version = self.append("parsed", extract.parse_responses(extract.run_offline(chunks)), project)
                    asked, failed = self.read("parsed", project).where(F.col("version") == version).count(), 0
                else:
                    # small tasks, which report soon and of which few run before the job ends
                    chunks = Cut(chunks, "chunks").df
                    chunks = chunks.repartition(max(1, -(-chunks.count() // config.FAILED_LEAST)))
                    breaker = extract.Breaker(self.spark)
                    answers = extract.run_extractor(chunks, breaker.watched(self.extractor))
                    parsed = breaker.cut(extract.parse_responses(answers), "parsed").df
                    asked, failed = extract.check_provider(parsed)
                    self.append("parsed", extract.clean_documents(parsed), project)
                    answered = answered.join(parsed.where("error is not null").select("file").distinct(), "file", "left_anti")
                marked = self.read("manifest", project).join(answered.select(F.col("file").alias("rel_path")), "rel_path", "left_semi")
                self.append("manifest", marked.withColumn("extracted_hash", F.col("hash")), project)
                counts = {"chunks": counts["chunks"] + asked, "failed_chunks": counts["failed_chunks"] + failed}
                streak = streak + failed if failed == asked else 0
                if streak >= config.FAILED_LEAST:
                    raise RuntimeError(f"{streak} chunks in a row failed; the extractor seems to be down")
        if not counts["failed_chunks"]:
            self.write("extracted", self.spark.createDataFrame([(project, self._extracted(project))], TABLES["extracted"]), project)
        return {**counts, "documents": self._answered(project).select("file").distinct().count()}

    def _extracted(self, project: str) -> str:
        """A digest of the documents that stand and of what the manifest says is extracted of them."""
        docs, known = self.read("documents", project), self.read("manifest", project)
        return f"{_digest(docs, 'rel_path', 'version', 'hash')} {_digest(known, 'rel_path', 'extracted_hash')}"

    def _answered(self, project: str) -> DataFrame:
        """The answers for documents that are there."""
        docs = self.read("documents", project).select("project", F.col("rel_path").alias("file"))
        return self.read("parsed", project).join(docs, ["project", "file"], "left_semi")

    def answers(self, project: str) -> DataFrame:
        """The answers for documents that are there, in today's document order, which is path order."""
        docs = self.read("documents", project).select("project", F.col("rel_path").alias("file"))
        return self.read("parsed", project).drop("doc_ord").join(_ranked(docs, "file"), ["project", "file"])

    def state(self, project: str) -> str:
        """What a project's graph is derived from: a digest of the answers that stand, which changes with any of them."""
        return _digest(self._answered(project).select("file", "version").distinct(), "file", "version")

    def derive(self, project: str, anew: bool = False) -> dict:
        """Graph and index of a project from its answers; imported rows stay.

        Nothing is derived where no answer changed since the last time (``anew`` insists). Otherwise entities are resolved and
        counted anew, as a change of one document can merge others' entities; but only texts that are new are embedded, and the index
        takes the vectors of the others from the one before. The state is recorded last, so a stopped derivation runs again.
        """
        state = self.state(project)
        done = self.read("derived", project).where((F.col("state") == state) & (F.col("model") == self.provider.model))
        if not anew and not done.isEmpty():
            return self._counts(project)
        with scratch(self.spark):
            known = self.read("labels", project).where(F.col("model") == self.provider.model)
            keep = lambda labels: self.write("labels", labels.distinct().withColumn("model", F.lit(self.provider.model)), project)
            merge = {} if self.merge_cosine is None else {"embed": self.embed, "cosine": self.merge_cosine, "known": known, "keep": keep}
            answers = Cut(self.answers(project), "answers").df  # read for entities, relations and facts
            built = graph.build_graph(*extract.raw_tables(answers), **merge)
            for name, rows in zip(("nodes", "edges", "facts"), built):
                kept = self.read(name, project).where("from_project is not null")
                self.write(name, rows.unionByName(kept), project)
        out = self.index(project)
        self.write("derived", self.spark.createDataFrame([(project, state, self.provider.model)], TABLES["derived"]), project)
        return out

    def _counts(self, project: str) -> dict:
        return {name: self.read(name, project).count() for name in ("nodes", "edges", "facts", "vectors")}

    def index(self, project: str) -> dict:
        """The index of a project's graph; texts that the index before holds by the same model are not embedded again,
        unless the provider is cheap (see ``vectors.is_cheap``).
        """
        g = self.graph(project)
        rows = None
        if vectors.is_cheap(self.provider):
            placed, points = vectors.placed_index(vectors.index_items(g.nodes, g.facts), self.provider)
        else:
            known = self.read("vectors", project).where(F.col("model") == self.provider.model).select("text", "vec")
            rows = Cut(vectors.build_index(g.nodes, g.facts, self.embed, self.provider.model, known), "index")
            points = similar.pivots(rows.df, "pos", "vec")
            placed = similar.assigned(rows.df, "vec", points)
        self.write("vectors", placed, project)
        cells = similar.cell_table(self.read("vectors", project), points)
        self.write("cells", cells.withColumns({"dim": F.lit(points.shape[1]), "model": F.lit(self.provider.model)}), project)
        if rows is not None:
            rows.drop()
        return self._counts(project)

    def build(self, source_dir: str, project: str, name: str | None = None, incremental: bool = True, reset: bool = False, max_files: int | None = None, prune: bool = False, verify: bool = False) -> dict:
        if not files._exists(self.spark, source_dir):
            raise FileNotFoundError(source_dir)
        if reset:
            self.reset(project)
        out = {"project": project, "ingest": self.ingest(source_dir, project, incremental, max_files, prune, verify), "extract": self.extract(project), "graph": self.derive(project)}
        row = [(project, name or project, source_dir, self.provider.model, out["ingest"]["total"], time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))]
        self.write("projects", self.spark.createDataFrame(row, TABLES["projects"]), project)
        return out

    def update(self, project: str, source_dir: str | None = None) -> dict:
        """Build again from the folder of the last build."""
        known = self.read("projects", project).first()
        if known is None and source_dir is None:
            raise KeyError(f"no project {project}")
        return self.build(source_dir or known["source_dir"], project, known["name"] if known else None)

    def reset(self, project: str) -> None:
        for name in TABLES:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{folder_of(project)}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # --- use ---------------------------------------------------------------------------------

    def sole(self, project: str | None) -> str:
        """The project named, or the only one there is."""
        if project:
            return project
        found = [r["project"] for r in self.read("projects").select("project").orderBy("project").limit(2).collect()]
        if len(found) != 1:
            raise ValueError("name a project: there is none" if not found else "name a project: there are several")
        return found[0]

    def overview(self, project: str | None = None) -> str:
        project = self.sole(project)
        meta = self.read("projects", project).first()
        return digest.digest_text(self.graph(project), project, meta and meta["name"], meta and meta["source_dir"], (meta and meta["updated"]) or "", self.summarise)

    def query(self, text: str, project: str | None = None, k: int | None = None, scope: str = "project") -> list:
        """The nodes and facts nearest to a text; only cells of the index that can hold one of them are read."""
        within = None if scope == "all" else self.sole(project)
        vec, k = [float(x) for x in self.provider.vectors([text])[0]], k or config.QUERY_K
        norm = math.sqrt(sum(x * x for x in vec)) or 1.0
        fits = (F.col("dim") == len(vec)) & (F.col("model") == self.provider.model)
        rows, cells = (self.read(t, within).where(fits) for t in ("vectors", "cells"))
        score = dot(F.col("vec"), F.array(*[F.lit(x / norm) for x in vec]))
        found, _ = similar.search_cells(rows, cells, [x / norm for x in vec], vectors.pool_size(k), score)
        return vectors.search(found, vec, k, model=self.provider.model).collect()

    def query_markdown(self, text: str, project: str | None = None, k: int | None = None, scope: str = "project") -> str:
        return sinks.search_markdown(text, self.query(text, project, k, scope), scope == "all")

    def expand(self, entity: str, project: str | None = None, depth: int = 1) -> dict | None:
        g = self.graph(self.sole(project))
        centre = Cut(expand.find_entity(g.nodes, entity), "centre").df
        row = centre.first()
        if row is None:
            return None
        reached = expand.hops(g.edges, centre.select("project", "id"), depth)
        return {
            "center": row.asDict(),
            "relations": [r.asDict() for r in expand.ego_relations(g.edges, g.nodes, centre).collect()],
            "neighbors": [r.asDict() for r in expand.neighbours(g.nodes, reached).collect()],
        }

    def stats(self, project: str | None = None) -> dict:
        project = self.sole(project)
        g = self.graph(project)
        counts = graph.graph_stats(g).first()
        meta = self.read("projects", project).first()
        return {
            "project": project, **(meta.asDict() if meta else {}), **({k: counts[k] for k in ("nodes", "edges", "facts")} if counts else {"nodes": 0, "edges": 0, "facts": 0}),
            "entities_by_type": {r["type"]: r["n"] for r in graph.entities_by_type(g.nodes).orderBy(F.desc("n"), "type").collect()},
            "top_entities": [r.asDict() for r in graph.top_nodes(g.nodes, 12).select("name", "type", "degree", "mentions").collect()],
        }

    def projects(self) -> DataFrame:
        """One row per project with its counts."""
        return graph.catalog(*(self.read(t) for t in ("projects", "nodes", "edges"))).orderBy("project")

    def link(self, into: str, origin: str, query: str | None = None, k: int = config.LINK_K) -> dict:
        """Import the nodes of ``origin`` that match a query, or its most central ones."""
        both = Graph(*(self.read(t).where(F.col("project").isin(into, origin)) for t in ("nodes", "edges", "facts")))
        hits = None
        if query:
            hits = self.spark.createDataFrame([(r["id"], r["rank"]) for r in self.query(query, origin, k) if r["kind"] == "node"], "id string, rank int")
        new = link.imported(both, into, origin, k, hits)
        linked = new.nodes.count()
        held = [Cut(d, "linked").df for d in new]
        for name, rows in zip(("nodes", "edges", "facts"), held):
            self.write(name, self.read(name, into).unionByName(rows), into)
        return {"linked": linked, **self.index(into)}

    def mindmap(self, project: str | None = None) -> str:
        project = self.sole(project)
        meta = self.read("projects", project).first()
        return sinks.mindmap_html(self.graph(project), project, meta and meta["name"], (meta and meta["updated"]) or "")

    def export(self, dest: str, project: str | None = None, graph: bool = False, mindmap: bool = False, as_context: str | None = None) -> list[str]:
        """Digest, and on request graph and mind map, as files for other tools; ``as_context`` names the digest's file."""
        project = self.sole(project)
        if self.read("projects", project).first() is None:
            raise KeyError(f"no memory of {project}: build it first")
        out = [sinks.write_text(os.path.join(dest, as_context or f"{project}-memory.md"), self.overview(project))]
        if graph:
            path = os.path.join(dest, f"{project}-graph.json")
            out.append(sinks.write_graph(path, self.graph(project)))
        if mindmap:
            out.append(sinks.write_text(os.path.join(dest, f"{project}-mindmap.html"), self.mindmap(project)))
        return out

    def health(self) -> dict:
        """Whether the providers answer: ok, or what they fail with. Each is asked once, for a short text."""

        def asked(ask: Callable) -> str:
            try:
                ask()
                return "ok"
            except Exception as e:  # what is wrong with a provider is the answer
                return f"{type(e).__name__}: {e}"

        return {"embedding": asked(lambda: self.provider.vectors(["ready?"])[0]), "extractor": asked(lambda: (self.extractor or (lambda: str))()("ready?"))}

    def status(self, ask: bool = False) -> dict:
        """Settings and counts; ``ask`` also asks the providers (see ``health``)."""
        conf = self.spark.conf
        have = self.converters()
        work = {n: "yes" if getattr(have, n) else "no" for n in ("ocr_image", "pages", "caption", "transcribe")}
        return {"converters": work, "spark": self.spark.version, "root": self.root, "model": self.provider.model, "extractor": "offline" if self.extractor is None else "provider", "adaptive": conf.get("spark.sql.adaptive.enabled"), "projects": self.read("projects").count(), **({"health": self.health()} if ask else {})}


def _columns(schema: str) -> list[str]:
    """Top-level columns of a DDL string."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


def _digest(rows: DataFrame, *cols: str) -> str:
    """How many rows there are, and a hash of some columns that depends on no order; rows differ in these columns."""
    n, mixed = rows.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0).cast("long"))).first()
    return f"{n} {mixed & (1 << 64) - 1:016x}"


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``doc_ord``, their place in the order of ``by``: counts of ranges, then places within them."""
    dealt = Cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranked").df
    sizes = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return rows.withColumn("doc_ord", F.lit(0).cast("long"))
    base = rows.sparkSession.createDataFrame(sorted(starts.items()), "_p int, _start long")
    # a partition's rows are numbered from _p * 2**33 on
    place = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return dealt.join(F.broadcast(base), "_p").select(*rows.columns, (F.col("_start") + place).alias("doc_ord"))
