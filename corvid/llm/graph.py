"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, uncut


def _hang(directed: DataFrame, keep_self: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (and of itself)."""
    low = cut(directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    out = lookup(directed, low, ["u"])
    if keep_self:  # small star: the node itself too
        out = out.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    else:  # large star: larger neighbours only
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, and the smallest node of its component.

    ``edges`` has two long columns u, v; loops and nulls are ignored. The
    number of rounds grows with the logarithm of the longest chain. Minima are
    partly aggregated before the shuffle and joined where the edges are, so a
    node with very many edges costs no task more than the others; each round is
    cut into a table.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()

    was = mark(now)
    while was["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, keep_self=False)
        new = cut(_hang(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), keep_self=True), "edges")
        uncut(now)
        now, mine = new, mark(new)
        if mine == was:
            break
        was = mine
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
