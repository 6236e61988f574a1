"""Connected components of a graph of longs, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Hang every neighbour (both: the larger ones of all, else the smaller ones and itself) on the least one."""
    near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = near.join(least, "a")
    if both:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its least node.

    Self-links and repeated links do no harm; a null end is dropped. Each round
    is two aggregates and two equi-joins over the links, written to the shared
    folder; the number of rounds grows with the logarithm of the graph.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = materialize(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before, old = tuple(now), e
        e = materialize(_stars(_stars(e, True).where("a <> b").distinct(), False).distinct())
        drop(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
