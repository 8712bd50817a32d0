"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node of its component.

    Each step sends every neighbour the smallest node that its centre knows, so a star of any
    size is one aggregate and one join, and chains shorten to stars in a logarithmic number of
    rounds. Rounds end as soon as the links are stars. Every round is checkpointed in the shared folder.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _stars(edges):
        both = _either(edges, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(_either(large.join(least, "a"), ("b", "m"), ("a", "m")).where("a > b").distinct())
    named = _either(edges, ("a", "b"), ("b", "b")).distinct()
    return checkpointed(named.select(F.col("a").alias("node"), F.col("b").alias("root")))


def _either(rows: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """(a, b): of every row one for each of the two ways to read it, in one pass."""
    pairs = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ways])
    return rows.select(F.explode(pairs).alias("e")).select("e.a", "e.b")


def _stars(edges: DataFrame) -> bool:
    """Has every larger end one smaller end only, which is no larger end itself?"""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 OR (ups = 1 AND least = 0)").agg(F.count("*")).first()[0] == 0
