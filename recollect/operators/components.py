"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import Cut, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``; component is the least node.

    Every round hooks each node to its neighbour of least (random) priority,
    jumps that pointer once, and contracts the edges to the hooked nodes.
    Priorities change from round to round, so chains shrink by a constant
    factor and stars in two rounds; nothing is collected anywhere. Only
    aggregates (with map-side partials) and equi-joins (which AQE may split)
    are used, so a hub with most of the edges is no bottleneck. Rows with a
    null end and self-loops link nothing; nodes named only by self-loops are
    their own component. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    dtype = edges.schema["src"].dataType
    edges = edges.select(F.col("src").cast(dtype), F.col("dst").cast(dtype)).where(
        "src is not null and dst is not null"
    )
    links = Cut(edges.distinct(), "links")
    nodes = links.df.select(F.col("src").alias("node")).union(links.df.select("dst")).distinct()
    labels = Cut(nodes.select("node", F.col("node").alias("root")), "labels")
    live = Cut(links.df.where("src <> dst"), "links")
    links.drop()
    for turn in range(max_rounds):
        if live.df.isEmpty():
            break
        e = live.df
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("id"))
        both = e.select("src", "dst").union(e.select(F.col("dst"), F.col("src")))
        hook = both.groupBy(F.col("src").alias("n")).agg(F.min(rank(F.col("dst"))).alias("m"))
        hook = hook.select("n", F.least(rank(F.col("n")), F.col("m"))["id"].alias("p"))
        hooked = Cut(hook, "hooks")
        up = hooked.df.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        jump = Cut(hooked.df.join(up, "p").select("n", F.col("pp").alias("p")), "jumps")
        a = jump.df.select(F.col("n").alias("src"), F.col("p").alias("s"))
        b = jump.df.select(F.col("n").alias("dst"), F.col("p").alias("d"))
        new = (
            e.join(a, "src").join(b, "dst").where("s <> d")
            .select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct()
        )
        moved = labels.df.join(jump.df.select(F.col("n").alias("root"), "p"), "root", "left").select(
            "node", F.coalesce("p", "root").alias("root")
        )
        fresh, renamed = Cut(new, "links"), Cut(moved, "labels")
        for old in (live, labels, hooked, jump):
            old.drop()
        live, labels = fresh, renamed
        if turn % 4 == 3:
            release(spark)
    else:
        raise RuntimeError("connected_components did not settle")
    least = labels.df.groupBy("root").agg(F.min("node").alias("component"))
    return labels.df.join(least, "root").select("node", "component")
