"""Connected components of a graph of links, as joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.session import cut

#: Rounds after which the search gives up; a graph needs about the logarithm of its diameter.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each id in links (a, b: of one type that has an order): root is the least id that can be reached. Null ends and links to oneself add nothing.

    Large-star and small-star take turns: each id's larger, then smaller, neighbours are tied to its least neighbour. Least neighbours are partial aggregates, and each round is written to the shared folder, which ends its lineage; Runs an action for each round.
    """
    pairs = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"no end after {ROUNDS} rounds")
