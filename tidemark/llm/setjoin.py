"""Pairs of sets that can have a given Jaccard similarity, by prefixes of their rarest elements.

Elements are ordered by how many of the sets hold them, those that nobody shares first. Sets of s and t elements are
similar to p percent only if they share p (s + t) / (100 + p) or more; so their first common element in that order must
have enough elements behind it in both. Only elements that can are joined, and a pair is made only where it holds for
both sizes. In a family of edited copies what they share is common and comes last, and what an edit brought is rare and
comes first, so copies that are edited apart do not meet although they share most of their elements.

Only links between groups are wanted, so a family is worth bringing into one group first: leader_pairs compares each node
with the most central set that it meets, the one whose elements most others hold, counted over whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_apart, stored

#: Holders of an element that are joined in one block.
BLOCK = 4_096


def prefix_elements(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, central (how many sets hold an element of it, on average), x and i (its place) of the elements at which similar sets meet, stored.

    sets: a stored table of node and h (distinct elements); a node may be there once.
    """
    rows = sets.select("node", F.explode("h").alias("x"))
    total = sets.agg(F.sum(F.size("h"))).first()[0] or 0
    shared = stored(rows.groupBy("x").agg(F.count(F.lit(1)).alias("held")).where("held > 1").withColumn("rarity", F.col("held")), "shared-elements")
    met = join_apart(rows, shared, ["x"], total, "held")
    lists = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rarity", "x"))).alias("own"))
    lists = sets.select("node", F.size("h").alias("size")).join(lists, "node")
    # elements that nobody shares come before these
    first = F.col("size") - F.size("own")
    central = (F.aggregate("own.rarity", F.lit(0).cast("long"), lambda n, r: n + r) + first) / F.col("size")
    # behind the first common element there must be this part of the set at least, whatever the other's size
    many = F.floor(F.col("size") - F.col("size") * percent / 100) + 1 - first
    lists = lists.withColumn("central", central).withColumn("first", first).withColumn("own", F.slice("own", F.lit(1), F.greatest(many, F.lit(0)).cast("int")))
    prefix = lists.select("node", "size", "central", "first", F.posexplode("own").alias("i", "x")).select("node", "size", "central", (F.col("first") + F.col("i")).alias("i"), "x.x")
    return stored(prefix, "prefix-elements")


def _enough(c: str, d: str, percent: int) -> Column:
    """Are there enough elements of set c from its place i on, to be similar to set d?"""
    return (F.col(f"size_{c}") - F.col(f"i_{c}")) * (100 + percent) >= percent * (F.col(f"size_{c}") + F.col(f"size_{d}"))


def leader_pairs(prefix: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of different labels, one for each node at most: with the most central of its elements' leaders.

    prefix: of prefix_elements; labels: node and label of each. The leader of an element is its most central holder.
    """
    rows = stored(prefix.join(labels, "node"), "labelled-elements")
    names = ("node", "label", "size", "i")
    to = F.max(F.struct("central", F.xxhash64("node").alias("h"), *names)).alias("to")
    lead = rows.groupBy("x").agg(F.count(F.lit(1)).alias("held"), to).where("held > 1")
    lead = stored(lead.select("x", "held", F.col("to.central").alias("most"), *[F.col(f"to.{n}").alias(f"{n}_b") for n in names]), "element-leaders")
    met = join_apart(rows.select("x", *[F.col(n).alias(f"{n}_a") for n in names]), lead, ["x"], max(1, rows.count()), "held")
    met = met.where((F.col("label_a") != F.col("label_b")) & _enough("a", "b", percent) & _enough("b", "a", percent))
    best = F.max(F.struct("most", F.xxhash64("node_b").alias("h"), "node_b"))["node_b"].alias("node_b")
    return met.groupBy("node_a").agg(best).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def pairs_between(prefix: DataFrame, labels: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a < b of nodes of different labels that can be similar to `percent` %; every similar pair is among them."""
    prefix = stored(prefix.join(labels, "node"), "labelled-elements")
    groups = prefix.groupBy("x", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("x").agg(F.sum("c").alias("held"), F.count(F.lit(1)).alias("groups"))
    sizes = groups.where("groups > 1").select("x", "held", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    own = join_apart(prefix, stored(sizes, "prefix-sizes"), ["x"], max(1, prefix.count()), "held")
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda c, p, q: own.select("x", F.col(p).alias("p"), F.col(q).alias("q"), F.col("node").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("label", "size", "i")])
    can = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _enough("a", "b", percent) & _enough("b", "a", percent)
    return side("a", "own", "at").join(side("b", "at", "own"), ["x", "p", "q"]).where(can).select("a", "b").distinct()


def possible_pairs(sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a < b of nodes of different labels that can be similar to `percent` %.

    sets: a stored table of node, label and h (distinct elements); a node may be there once. Every similar pair is among
    the result. Nodes of empty sets are in no pair.
    """
    return pairs_between(prefix_elements(sets, percent), sets.select("node", "label"), percent, block)
