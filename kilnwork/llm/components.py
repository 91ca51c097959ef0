"""Connected components of a graph of links, as Spark jobs, and joins that stand frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A key is frequent if it holds more than one in so many of the rows, so no more than that many are.
SHARE = 1024


def joined(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of keyed (one row a key, `weight` rows of `rows` have it, `total` in all; weight is dropped). The rows of frequent keys, of which there are SHARE at most, aren't shuffled: their side is broadcast."""
    others = [c for c in keyed.columns if c not in (key, weight)]
    frequent = keyed.where(F.col(weight) * SHARE > total).select(key, F.struct(*others).alias("_frequent"))
    marked = rows.join(F.broadcast(frequent), key, "left")
    here = marked.where("_frequent is not null").select(*rows.columns, *[F.col("_frequent")[c].alias(c) for c in others])
    there = marked.where("_frequent is null").drop("_frequent").join(keyed.where(F.col(weight) * SHARE <= total).select(key, *others), key)
    return here.unionByName(there.select(*rows.columns, *others))


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """Link each node's (larger, or no larger) neighbours to the least of its neighbours and itself. There are `total` links, or have been: stars never make more."""
    pairs = links.select("a", "b").union(links.select("b", "a")) if large else links
    least = pairs.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree")).select("a", F.least("a", "least").alias("least"), "degree")
    met = joined(pairs, least, "a", "degree", total * (1 + large))
    moved = met.where(F.col("b") > F.col("a")) if large else met
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _open(links: DataFrame) -> tuple[int, int]:
    """How many links there are, and how many nodes keep them from being stars: those with several links to lesser nodes, or with one and a link from a larger node. Both ends are counted in their tasks before they are shuffled."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    total, open_ = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 0) & (F.col("ups") + F.col("down") > 1))).first()
    return total, open_


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have links (a, b): the component is its least node.

    Alternating large and small stars: each round halves paths, and each star's
    table is written to the shared folder. Ends when all that is left are stars, each
    node linked to the least of its component alone. A hub's links stay where they
    are; only its least neighbour travels.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        total, open_ = _open(links)
        if not open_:
            break
        links = written(_star(written(_star(links, total, True), "stars"), total, False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
