"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest of
    them. Rounds are written to the shared folder, so lineage stays short; only the edge count
    and a checksum reach the driver. No links give an empty result.
    """
    # Written once: every round reads its edges several times.
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)


def merge_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after more ``links`` (a, b): only components that links join are worked on.

    A node that is not in ``parts`` is a component of its own."""
    label = parts.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    named = materialize(links, "more-links")
    for side in ("a", "b"):
        named = named.join(label, F.col(side) == F.col("_node"), "left").withColumn(side, F.coalesce("_component", side)).drop("_node", "_component")
    top = materialize(components(named.filter("a <> b")), "component-tops")
    renamed = top.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    old = parts.join(renamed, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component"))
    fresh = top.join(label, F.col("node") == F.col("_node"), "left_anti").select("node", "component")
    return old.union(fresh)
