"""Connected components of an edge table, without bringing any part of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, store


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest of a and its b; partial aggregation takes the load off hot nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return edges.join(least, F.col("a") == F.col("k")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    starred = _smallest(down)
    return starred.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` has one root: then each component is a star around its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "b"), F.struct(F.col("b").alias("node"), "b"))).alias("e"))
    roots = ends.groupBy("e.node").agg(F.min("e.b").alias("lo"), F.max("e.b").alias("hi"))
    return not roots.agg(F.count_if(F.col("lo") < F.col("hi"))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b of one orderable type); root is the smallest node of its component.

    Alternates large-star and small-star steps, which end after a logarithmic number of
    rounds on all known inputs; they end as soon as all components are stars, without a round
    that changes nothing. Each round is written to the shared folder. Self-loops and null ends
    are ignored; an empty table gives an empty result.
    """
    now = store(edges.select("a", "b").where("a != b").distinct(), "edges")
    if now.take(1):
        for _ in range(max_rounds):
            after = store(_small_star(_large_star(now)), "edges")
            discard(now)
            now = after
            if _settled(now):
                break
        else:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
