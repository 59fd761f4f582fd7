"""Connected components of a table of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_dealt, settle, small_or_not

#: Rows that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id reachable.

    In a round every id points at the smallest id among itself and its neighbours; pointers are followed to their ends, and the
    links between different ends are the next round's, at most half as many ids each time. A star or a chain is one round.
    Each round is settled. It is an error if most_rounds do not suffice. Repeated links count once, a link of an id to
    itself makes it a component, links with a null are left out, and no links give no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = settle(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")))
    edges = edges.filter("a <> b")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        least = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        ends = _followed(settle(least.select(F.col("a").alias("id"), F.least("a", "b").alias("end"))), most_rounds)
        labels = settle(moved(labels, "component", ends))
        both = moved(moved(edges, "a", ends), "b", ends).filter("a <> b")
        edges = settle(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    raise RuntimeError(f"links have not come together in {most_rounds} rounds")


def extended(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the links that made `components` (id, component) and of `links` (a, b) together."""
    between = moved(moved(links.select("a", "b"), "a", components, "id", "component"), "b", components, "id", "component")
    joined = connected_components(between)
    known = components.union(
        links.select("a", F.col("a").alias("component")).union(links.select("b", "b")).join(
            components, F.col("a") == F.col("id"), "left_anti"
        ).distinct()
    )
    return moved(known, "component", joined, "id", "component")


def _followed(forest: DataFrame, most_rounds: int) -> DataFrame:
    """forest(id, end) with every pointer followed to its end, doubling its length each time."""
    for _ in range(most_rounds):
        further = forest.alias("f").join(
            forest.select(F.col("end").alias("_to")).distinct(), F.col("f.id") == F.col("_to"), "left_semi"
        ).filter("id <> end")
        if further.isEmpty():
            return forest
        forest = settle(moved(forest, "end", settle(further)))
    raise RuntimeError(f"pointers have not come to their ends in {most_rounds} rounds")


def moved(df: DataFrame, name: str, ends: DataFrame, key: str = "id", value: str = "end") -> DataFrame:
    """df with the values of column `name` that are among ends.key replaced by ends.value.

    Few ends are broadcast, under a size check; with many, a value that very many rows of df have is dealt by a salt.
    """
    moves = settle(ends.select(F.col(key).alias("_id"), F.col(value).alias("_end")).filter("_id <> _end"))
    moves, fits = small_or_not(moves, BROADCAST_ROWS)
    if fits:
        out = df.join(moves, F.col(name) == F.col("_id"), "left")
    else:
        every = df.select(F.col(name).alias("_id")).distinct().join(moves, "_id", "left").select(F.col("_id").alias(name), "_end")
        other = next((c for c in df.columns if c != name), name)
        out = join_dealt(df, every, name, other)
    return out.select(*[F.coalesce("_end", c).alias(c) if c == name else F.col(c) for c in df.columns])
