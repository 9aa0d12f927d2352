"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, join_unique, stored


def _plain(rows: DataFrame, values: DataFrame, on: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    return rows.join(values, on, how)


def _roots(parents: DataFrame, joined: Callable[..., DataFrame]) -> DataFrame:
    """node and label, the end of its chain of parents; chains halve in every round."""
    while True:
        of = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = stored(joined(parents, of, ["label"]).select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "cc-parents")
        parents = nxt.select("node", "label")
        if nxt.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it can reach, of each node in edges (a, b; two columns of one orderable type).

    Every round hangs each node below its least neighbour, follows those chains to their ends, and draws the edges
    anew between the ends; edges within a tree vanish, so what is left shrinks at least by half. Tables are stored
    after each round. Groups of any size are only ever summed by key, never gathered; where a node has very many
    edges, such nodes and those with many children are joined apart from the others.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels = joined = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        joined = joined or (join_unique if (least.agg(F.max("n")).first()[0] or 0) >= LEAST_HOT else _plain)
        roots = _roots(least.select("node", F.least("node", "m").alias("label")), joined)
        if labels is None:
            labels = roots
        else:
            ends = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = stored(joined(labels, ends, ["label"], how="left").select("node", F.coalesce("further", "label").alias("label")), "cc-labels")
        left = edges
        for end, label in (("a", "x"), ("b", "y")):
            left = joined(left, roots.select(F.col("node").alias(end), F.col("label").alias(label)), [end], least.select(F.col("node").alias(end), "n"))
        edges = stored(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels
