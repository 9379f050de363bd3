"""Entity lookup and neighbourhood expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.fuzzy import most_ratio, most_shared, ratio
from recollect.session import Cut


def find_entity(nodes: DataFrame, entity: str, fuzzy: bool = True, cutoff: float = 0.6) -> DataFrame:
    """At most one node per project: by id, then by name or alias, then by part of the name, then by likeness.

    Of several names that contain the text the one of largest degree is taken; of
    several that resemble it the most similar, then the last by name. Other ties go to the first node.
    """
    e = entity.strip().lower()
    if not e:
        raise ValueError("an entity must be named")
    low = F.lower("name")
    rank = (
        F.when(F.col("id") == entity, 1)
        .when((low == e) | F.exists("aliases", lambda a: F.lower(a) == e), 2)
        .when(F.contains(low, F.lit(e)), 3)
    )
    found = nodes.withColumn("_p", rank).withColumn("_s", F.lit(None).cast("double")).where("_p is not null")
    if fuzzy:
        # likeness only for projects in which the cheap rules find nothing
        sure = Cut(found, "found").df
        rest = nodes.join(sure.select("project").distinct(), "project", "left_anti")
        found = sure.unionByName(_alike(rest, e, cutoff).withColumn("_p", F.lit(4)))
    less_name = F.when(F.col("_p") == 4, low)
    order = F.struct(
        (-F.col("_p")).alias("p"), F.when(F.col("_p") == 3, F.col("degree")).alias("d"), F.col("_s").alias("s"), less_name.alias("n"), (-F.col("ord")).alias("o")
    )
    return found.groupBy("project").agg(F.max_by(F.struct(*[F.col(c) for c in nodes.columns]), order).alias("n"), F.max_by("_p", order).alias("matched_by")).select("n.*", "matched_by")


def _alike(nodes: DataFrame, e: str, cutoff: float) -> DataFrame:
    """``nodes`` whose likeness ``_s`` to a text may be the best of their project.

    Bounds that Spark computes come first: those below the cutoff go, then those below the likeness of their project's
    most promising name. Only the rest, and no node that could win is not in it, are compared in Python.
    """
    low = F.lower("name")
    bounded = nodes.where(most_shared(low, e) >= cutoff).withColumn("_most", most_ratio(low, F.lit(e))).where(F.col("_most") >= cutoff)
    bounded = Cut(bounded, "alike").df
    first = bounded.groupBy("project").agg(F.max_by(low, F.struct("_most", low)).alias("_n"))
    reached = first.select("project", ratio(F.col("_n"), F.lit(e)).alias("_least"))
    near = bounded.join(reached, "project").where(F.col("_most") >= F.col("_least"))
    return near.withColumn("_s", ratio(low, F.lit(e))).where(F.col("_s") >= cutoff).drop("_most", "_least")


def hops(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """``(project, id, hop)`` of all nodes within ``depth`` undirected steps of ``start(project, id)``."""
    links = edges.select("project", F.col("source").alias("id"), F.col("target").alias("to")).unionAll(edges.select("project", F.col("target").alias("id"), F.col("source").alias("to")))
    seen = Cut(start.select("project", "id", F.lit(0).alias("hop")).distinct(), "hops")
    frontier = seen.df
    for hop in range(1, max(1, depth) + 1):
        new = links.join(frontier.select("project", "id"), ["project", "id"], "left_semi").select("project", F.col("to").alias("id")).distinct()
        new = new.join(seen.df.select("project", "id"), ["project", "id"], "left_anti").withColumn("hop", F.lit(hop))
        step = Cut(new, "hops")
        if step.df.isEmpty():
            break
        both = Cut(seen.df.union(step.df), "hops")
        seen.drop()
        seen, frontier = both, step.df
    return seen.df


def ego_relations(edges: DataFrame, nodes: DataFrame, centre: DataFrame, most: int = 25) -> DataFrame:
    """Edges at the centre, with node names where nodes are known; however deep the expansion, no others."""
    c = centre.select("project", F.col("id").alias("_c"))
    # few centres, one a project, so that the edges need no exchange
    at = edges.join(F.broadcast(c), "project").where((F.col("source") == F.col("_c")) | (F.col("target") == F.col("_c")))
    s = nodes.select("project", F.col("id").alias("source"), F.col("name").alias("source_name"))
    t = nodes.select("project", F.col("id").alias("target"), F.col("name").alias("target_name"))
    named = at.join(s, ["project", "source"], "left").join(t, ["project", "target"], "left")
    return named.select("project", "ord", F.coalesce("source_name", "source").alias("source"), "relation", F.coalesce("target_name", "target").alias("target")).orderBy("ord", "source", "target").limit(most)


def neighbours(nodes: DataFrame, reached: DataFrame, most: int = 30) -> DataFrame:
    """Known nodes reached, without the centre: nearest first, then by degree."""
    rows = reached.where("hop > 0").join(nodes.select("project", "id", "name", "type", "degree", "ord"), ["project", "id"])
    return rows.orderBy("hop", F.desc("degree"), "ord").limit(most).select("project", "id", "name", "type", "hop")
