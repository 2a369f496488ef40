"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every greater neighbour of u links to u's least; small: u and its lesser neighbours link to that least."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) links to (node, root): root is the least node that links reach; nodes without links are absent.

    Each round is written to the shared folder, so lineage stays short; the number of rounds is logarithmic in a component's size.
    """
    edges = scratch.keep(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-0")
    last = None
    for i in range(1, ROUNDS):
        edges = scratch.keep(_star(_star(edges, True), False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
