"""The property graph: edges, degree, facts, scores and statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import norm_key, strip
from recollect.operators.resolve import resolve
from recollect.session import Cut


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame


def edges_of(raw_relations: DataFrame, resolution: DataFrame) -> DataFrame:
    """Distinct labelled edges between resolved nodes with ``count``; the first label seen is shown."""
    s = resolution.select("project", F.col("norm_key").alias("_s"), F.col("node_id").alias("src"))
    t = resolution.select("project", F.col("norm_key").alias("_t"), F.col("node_id").alias("dst"))
    label = F.substring(strip(F.coalesce("relation", F.lit("related to"))), 1, 40)
    rows = raw_relations.select("project", "seq", norm_key(F.col("source")).alias("_s"), norm_key(F.col("target")).alias("_t"), F.when(label == "", F.lit("related to")).otherwise(label).alias("relation"), F.col("file") if "file" in raw_relations.columns else F.lit(None).cast("string").alias("file"))
    found = rows.join(s, ["project", "_s"]).join(t, ["project", "_t"]).where("src <> dst")
    return dedup_edges(found.select("project", "seq", "src", "dst", "relation", "file"))


def dedup_edges(rows: DataFrame) -> DataFrame:
    """Rows ``(project, seq, src, dst, relation, file)`` grouped by ends and normalised label."""
    key = F.substring(norm_key(F.col("relation")), 1, 40).alias("label")
    grouped = rows.groupBy("project", "src", key, "dst").agg(
        F.min("seq").alias("ord"), F.min_by("relation", "seq").alias("relation"), F.count(F.lit(1)).alias("count"), F.slice(F.array_sort(F.collect_set("file")), 1, config.NODE_SOURCES).alias("files")
    )
    return grouped.select("project", "ord", F.col("src").alias("source"), "relation", F.col("dst").alias("target"), "count", "files")


def degrees(edges: DataFrame) -> DataFrame:
    """Number of distinct labelled edges at each node."""
    ends = edges.select("project", F.col("source").alias("id")).unionAll(edges.select("project", F.col("target").alias("id")))
    return ends.groupBy("project", "id").agg(F.count(F.lit(1)).alias("degree"))


def facts_of(raw_facts: DataFrame, resolution: DataFrame) -> DataFrame:
    """Facts with the distinct nodes that their entities name, in order."""
    names = raw_facts.select("project", "seq", F.posexplode("entities").alias("at", "name")).withColumn("norm_key", norm_key(F.col("name")))
    found = names.join(resolution, ["project", "norm_key"])
    first = found.groupBy("project", "seq", "node_id").agg(F.min("at").alias("at"))
    nodes = first.groupBy("project", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    rows = raw_facts.join(nodes, ["project", "seq"], "left")
    return rows.select("project", F.col("seq").alias("ord"), "text", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), "file")


def node_facts(facts: DataFrame) -> DataFrame:
    """Each node's first distinct facts, of those that name it among their first four."""
    held = facts.select("project", "ord", "text", F.explode(F.slice("nodes", 1, config.FACT_NODES)).alias("id"))
    once = held.groupBy("project", "id", "text").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("project", "id").orderBy("ord", "text")
    best = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= config.NODE_FACTS)
    return best.groupBy("project", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]).alias("facts"))


def build_graph(raw_entities: DataFrame, raw_relations: DataFrame, raw_facts: DataFrame, embed=None, **merge) -> Graph:
    """Resolve entities and attach edges, degree and facts to the nodes."""
    nodes, resolution = resolve(raw_entities, embed, **merge)
    edges = Cut(edges_of(raw_relations, resolution), "edges").df
    facts = Cut(facts_of(raw_facts, resolution), "facts").df
    on = ["project", "id"]
    full = nodes.join(degrees(edges), on, "left").join(node_facts(facts), on, "left")
    full = full.select("project", "ord", "id", "name", "type", "description", "aliases", "sources", "mentions", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), F.lit(None).cast("string").alias("from_project"))
    return Graph(Cut(full, "graph-nodes").df, edges.withColumn("from_project", F.lit(None).cast("string")), facts.withColumn("from_project", F.lit(None).cast("string")))


def score() -> Column:
    """Centrality of a node."""
    return F.col("degree") * 2 + F.col("mentions")


def top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.desc(score()), "ord", "id").limit(n)


def entities_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"))


def catalog(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``projects`` with their numbers of nodes and edges, 0 where they have none."""
    count = lambda d, name: d.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    rows = projects.join(count(nodes, "nodes"), "project", "left").join(count(edges, "edges"), "project", "left")
    return rows.fillna(0, ["nodes", "edges"])


def graph_stats(graph: Graph) -> DataFrame:
    """Counts of nodes, edges and facts by project."""
    parts = [d.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(k).alias("k"), "n") for k, d in zip(("nodes", "edges", "facts"), graph)]
    rows = parts[0].union(parts[1]).union(parts[2])
    count = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(k)
    return rows.groupBy("project").agg(count("nodes"), count("edges"), count("facts"))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are among ``ids(project, id)``."""
    s = ids.select("project", F.col("id").alias("source"))
    t = ids.select("project", F.col("id").alias("target"))
    return edges.join(s, ["project", "source"], "left_semi").join(t, ["project", "target"], "left_semi")
