"""The driver's Parquet tables as model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.graph import Graph, degrees


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str, project: str = "star") -> Graph:
    """The star schema as a graph: a node for each region, nation, customer, supplier, part and order; foreign keys as edges.

    Mentions of a node are its size or amount where it has one, so that scores differ.
    """
    t = lambda n: table(spark, sf_dir, n)
    kinds = [
        ("region", t("region"), "r_regionkey", F.col("r_name"), "Location", F.lit(""), F.lit(1)),
        ("nation", t("nation"), "n_nationkey", F.col("n_name"), "Location", F.lit(""), F.lit(1)),
        ("supplier", t("supplier"), "s_suppkey", F.col("s_name"), "Organization", F.lit("supplier"), F.lit(2)),
        ("customer", t("customer"), "c_custkey", F.col("c_name"), "Organization", F.col("c_mktsegment"), F.lit(1)),
        ("part", t("part"), "p_partkey", F.col("p_name"), "Product", F.col("p_type"), F.col("p_size")),
        ("orders", t("orders"), "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "Event", F.col("o_orderpriority"), F.lit(1)),
    ]
    none = F.array().cast("array<string>")

    def node(i: int, kind: str, d: DataFrame, key: str, name: Column, type_: str, desc: Column, mentions: Column) -> DataFrame:
        k = F.col(key).cast("bigint")
        return d.select(
            F.lit(project).alias("project"), (F.lit(i * 10_000_000_000) + k).alias("ord"), F.concat(F.lit(f"{kind}:"), k.cast("string")).alias("id"), name.alias("name"), F.lit(type_).alias("type"),
            desc.alias("description"), none.alias("aliases"), F.array(F.lit(kind)).alias("sources"), mentions.cast("bigint").alias("mentions"),
        )

    def edge(i: int, d: DataFrame, key: str, a: Column, label: str, b: Column) -> DataFrame:
        return d.select(F.lit(project).alias("project"), (F.lit(i * 10_000_000_000) + F.col(key).cast("bigint")).alias("ord"), a.alias("source"), F.lit(label).alias("relation"), b.alias("target"), F.lit(1).cast("bigint").alias("count"), none.alias("files"), F.lit(None).cast("string").alias("from_project"))

    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = edge(0, t("nation"), "n_nationkey", ref("nation", "n_nationkey"), "in", ref("region", "n_regionkey"))
    edges = edges.unionAll(edge(1, t("supplier"), "s_suppkey", ref("supplier", "s_suppkey"), "in", ref("nation", "s_nationkey")))
    edges = edges.unionAll(edge(2, t("customer"), "c_custkey", ref("customer", "c_custkey"), "in", ref("nation", "c_nationkey")))
    edges = edges.unionAll(edge(3, t("orders"), "o_orderkey", ref("orders", "o_orderkey"), "placed by", ref("customer", "o_custkey")))
    nodes = node(0, *kinds[0])
    for i, k in enumerate(kinds[1:], 1):
        nodes = nodes.unionAll(node(i, *k))
    facts = t("orders").select(
        F.lit(project).alias("project"), F.col("o_orderkey").cast("bigint").alias("ord"), F.concat_ws(" ", F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string")).alias("text"),
        F.array(ref("orders", "o_orderkey"), ref("customer", "o_custkey")).alias("nodes"), F.lit("orders").alias("file"), F.lit(None).cast("string").alias("from_project"),
    )
    full = nodes.join(degrees(edges), ["project", "id"], "left").select("project", "ord", "id", "name", "type", "description", "aliases", "sources", "mentions", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), none.alias("facts"), F.lit(None).cast("string").alias("from_project"))
    return Graph(full, edges, facts)


def documents(spark: SparkSession, sf_dir: str, project: str = "docs") -> DataFrame:
    """``documents`` as converted documents; ``file`` is source/doc_id."""
    d = table(spark, sf_dir, "documents")
    # a table of fewer files than there are cores is dealt out before dear expressions; larger ones are read as they lie
    cores = spark.sparkContext.defaultParallelism
    if len(d.inputFiles()) < cores:
        d = d.repartition(cores, "doc_id")
    return d.select(F.lit(project).alias("project"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.col("doc_id").alias("doc_ord"), F.col("text").alias("body"))
