"""Connected components of an edge table, as joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.tables import store


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the least one."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).where(F.col("a") > F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the edge table (a, b) that is not the least of its
    component, with the least one.

    Alternating large-star and small-star steps; the number of rounds grows
    with the logarithm of the longest chain. A hub is never gathered: its least
    neighbour is an aggregate that combines before the shuffle, and the join
    back can be split. Each round's edges are a table, so a lost executor costs
    one round at most. No edges give no rows; loops and repeats are ignored.
    """
    edges = store(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = store(_small(store(_large(edges))))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges
