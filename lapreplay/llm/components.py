"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapreplay.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``links`` has long ``a, b``. Returns ``node, root`` (the component's smallest node) for every linked node.

    A round maps each node to the lowest of itself and its neighbours by a random rank, and keeps the links between
    different results. Ranks are hashes, so that a path shrinks by a constant share whatever the order of its nodes, and a star
    is done in two rounds. Minima combine before the shuffle, so a node may have any number of links. Links to itself are
    ignored.
    """
    edges = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select("a", F.least("m", ranked("a"))["v"].alias("m"))
        maps.append(written(least, "least"))
        to = lambda end: maps[-1].select(F.col("a").alias(end), F.col("m").alias(f"m_{end}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("m_a <> m_b")
        edges = written(moved.select(F.col("m_a").alias("a"), F.col("m_b").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("m").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("a").alias("root"), "m")
        out = out.join(step, "root", "left").select("node", F.coalesce("m", "root").alias("root"))
    out = written(out, "reached")
    smallest = out.groupBy("root").agg(F.min("node").alias("least"))
    return out.join(smallest, "root").select("node", F.col("least").alias("root"))
