"""Connected components of a large link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import shared


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours (the larger, or the smaller ones and itself) are linked to its least neighbour.

    The least neighbour comes from an aggregation that combines on the map side; the join that brings it back
    can be split by key, so a node with very many links is not gathered.
    """
    near = both_ways(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a, b): the least id that it reaches."""
    edges = shared.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        new = shared.stored(star(star(edges, True), False), "edges")
        # Done when the links are stars: every node has one smaller neighbour, which has none.
        heads = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if heads.where("n > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        edges = new
    return new.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
