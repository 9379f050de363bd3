"""Ranked tables behind the digest, and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import config
from recollect.operators.graph import Graph, score, top_nodes


def fact_scores(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts`` with ``score``: one and the scores of their nodes, each as often as it is listed."""
    held = facts.select("project", "ord", F.explode("nodes").alias("id")).join(nodes.select("project", "id", score().alias("_s")), ["project", "id"])
    sums = held.groupBy("project", "ord").agg(F.sum("_s").alias("_s"))
    return facts.join(sums, ["project", "ord"], "left").withColumn("score", (F.coalesce("_s", F.lit(0)) + 1).cast("bigint")).drop("_s")


def top_facts(facts: DataFrame, nodes: DataFrame, n: int = 40) -> DataFrame:
    """The n best facts of each project, equal texts once."""
    scored = fact_scores(facts.where("text is not null and text <> ''"), nodes).withColumn("text", F.trim("text"))
    once = Window.partitionBy("project", F.lower("text")).orderBy(F.desc("score"), "ord")
    best = scored.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    w = Window.partitionBy("project").orderBy(F.desc("score"), "ord")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("project", "rank", "ord", "text", "score")


def top_relations(edges: DataFrame, nodes: DataFrame, n: int = config.DIGEST_RELATIONS, among: int = 40) -> DataFrame:
    """The n best edges of each project: by count, with 2 more where both ends are among the best nodes."""
    w = Window.partitionBy("project").orderBy(F.desc(score()), "ord", "id")
    top = nodes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= among).select("project", "id", F.lit(1).alias("_in"))
    s, t = top.withColumnsRenamed({"id": "source", "_in": "_s"}), top.withColumnsRenamed({"id": "target", "_in": "_t"})
    rows = edges.join(s, ["project", "source"], "left").join(t, ["project", "target"], "left")
    rows = rows.withColumn("score", (F.col("count") + F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull(), 2).otherwise(0)).cast("bigint"))
    order = Window.partitionBy("project").orderBy(F.desc("score"), "ord", "source", "target", "relation")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    sn = nodes.select("project", F.col("id").alias("source"), F.col("name").alias("source_name"))
    tn = nodes.select("project", F.col("id").alias("target"), F.col("name").alias("target_name"))
    named = rows.join(sn, ["project", "source"], "left").join(tn, ["project", "target"], "left")
    return named.select("project", "rank", F.coalesce("source_name", "source").alias("source"), "relation", F.coalesce("target_name", "target").alias("target"), "score")


def sections(nodes: DataFrame, per_type: int = config.DIGEST_PER_TYPE, most: int = config.DIGEST_ENTITIES) -> DataFrame:
    """Entities by type, types by total score: at most ``per_type`` of a type and ``most`` in all."""
    totals = nodes.groupBy("project", "type").agg(F.sum(score()).alias("total"), F.min(F.struct((-score()).alias("s"), "ord", "id")).alias("lead"))
    tw = Window.partitionBy("project").orderBy(F.desc("total"), "lead")
    types = totals.withColumn("type_rank", F.row_number().over(tw)).select("project", "type", "type_rank")
    w = Window.partitionBy("project", "type").orderBy(F.desc(score()), "ord", "id")
    best = nodes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_type).join(types, ["project", "type"])
    run = Window.partitionBy("project").orderBy("type_rank", "place")
    return best.withColumn("line", F.row_number().over(run)).where(F.col("line") <= most).select("project", "type_rank", "type", "place", "line", "id", "name", "description")


def overview_lead(nodes: DataFrame) -> DataFrame:
    """The first two projects or organisations by rank, of those the ones with a description."""
    w = Window.partitionBy("project").orderBy(F.desc(score()), "ord", "id")
    lead = nodes.where(F.col("type").isin("Project", "Organization")).withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    return lead.where("description <> ''").select("project", "rank", "name", "description")


def digest_text(graph: Graph, project: str, name: str | None = None, source_dir: str | None = None, generated: str = "", summarise=None) -> str:
    """The digest of one project as Markdown; about 70 ranked rows reach the driver.

    ``summarise(entities, facts)`` may write the overview; where it returns nothing or fails, leading descriptions do.
    """
    nodes, edges, facts = (d.where(F.col("project") == project) for d in graph)
    n_nodes, n_edges, n_facts = nodes.count(), edges.count(), facts.count()
    best = sorted(top_facts(facts, nodes).collect(), key=lambda r: r["rank"])
    overview = ""
    if summarise is not None:
        ranked = [(r["name"], r["type"]) for r in top_nodes(nodes, 20).collect()]
        try:
            overview = (summarise(ranked, [r["text"] for r in best[:10]]) or "").strip()
        except Exception:  # a summary is optional
            overview = ""
    if not overview:
        lead = sorted(overview_lead(nodes).collect(), key=lambda r: r["rank"])
        overview = " ".join(f"{r['name']} is {r['description']}." for r in lead) or f"{n_nodes} entities are known, with {n_edges} links between them."
    kinds: dict[str, list[str]] = {}
    for r in sorted(sections(nodes).collect(), key=lambda r: r["line"]):
        kinds.setdefault(r["type"], []).append(f"- {r['name']}" + (f": {r['description']}" if r["description"] else ""))
    links = [f"- {r['source']}, {r['relation']}: {r['target']}" for r in sorted(top_relations(edges, nodes).collect(), key=lambda r: r["rank"])]
    said = [f"- {r['text']}" for r in best[: config.DIGEST_FACTS]]
    head = [f"# {name or project}", "", overview, "", f"Known: {n_nodes} entities, {n_edges} links, {n_facts} statements" + (f", read from {source_dir}" if source_dir else "") + (f", {generated}" if generated else "") + "."]
    parts = [(f"{kind} entities", lines) for kind, lines in kinds.items()] + [("Links", links), ("Statements", said)]
    return "\n".join(head + [line for title, lines in parts if lines for line in ("", f"## {title}", "", *lines)])
