"""Import of one project's best nodes into another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect import config
from recollect.operators.graph import Graph, induced_edges, score


def select_nodes(nodes: DataFrame, k: int = config.LINK_K, hits: DataFrame | None = None) -> DataFrame:
    """k nodes: those of ``hits(id, rank)`` first, then the most central."""
    rows = nodes.withColumn("_h", F.lit(None).cast("int")) if hits is None else nodes.join(hits.select("id", F.col("rank").alias("_h")), "id", "left")
    return rows.orderBy(F.col("_h").asc_nulls_last(), F.desc(score()), "ord", "id").limit(k).drop("_h")


def imported(graph: Graph, into: str, origin: str, k: int = config.LINK_K, hits: DataFrame | None = None) -> Graph:
    """The rows that linking ``origin`` adds to ``into``: chosen nodes, edges among them, facts that name them.

    Ids get the origin as prefix and rows its name; rows that were imported before are not repeated.
    """
    if into == origin:
        raise ValueError("a project cannot be linked into itself")
    nodes, edges, facts = (d.where(F.col("project") == origin) for d in graph)
    old_nodes, old_edges, old_facts = (d.where((F.col("project") == into) & (F.col("from_project") == origin)) for d in graph)
    chosen = select_nodes(nodes, k, hits)
    prefix = lambda c: F.concat(F.lit(f"{origin}:"), c)
    tag = {"project": F.lit(into), "from_project": F.lit(origin)}
    n = chosen.withColumns(tag | {"id": prefix(F.col("id"))}).join(old_nodes.select("id"), "id", "left_anti")
    e = induced_edges(edges, chosen.select("project", "id")).withColumns(tag | {"source": prefix(F.col("source")), "target": prefix(F.col("target"))})
    e = e.join(old_edges.select("source", "target", "relation"), ["source", "target", "relation"], "left_anti")
    held = facts.select("ord", F.posexplode("nodes").alias("at", "id")).join(chosen.select("id"), "id")
    ids = held.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: prefix(x["id"])).alias("nodes"))
    f = facts.drop("nodes").join(ids, "ord").withColumns(tag).join(old_facts.select("text", "nodes"), ["text", "nodes"], "left_anti")
    return Graph(n.select(*graph.nodes.columns), e.select(*graph.edges.columns), f.select(*graph.facts.columns))


def link(graph: Graph, into: str, origin: str, k: int = config.LINK_K, hits: DataFrame | None = None) -> Graph:
    return Graph(*(a.unionByName(b) for a, b in zip(graph, imported(graph, into, origin, k, hits))))
