"""Connected components of links between longs, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, drop


#: Classes of more than 1 / HEAVY of all rows, of which there are fewer than HEAVY, are joined by broadcast.
HEAVY = 4096
LEAST_HEAVY = 64


def with_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with the row that `classes` has for their key. total: how many rows there are; size: the column of classes with
    how many of them each has. The rows of a large class stay where they are instead of meeting in one task."""
    bound = max(LEAST_HEAVY, total // HEAVY)
    heavy = F.broadcast(classes.where(F.col(size) > bound).drop(size))
    light = classes.where(F.col(size) <= bound).drop(size)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key, how))


#: Bits of the filter of known ids; as words of 64 bits it is a table of a quarter of a million rows at most, whatever the corpus.
FILTER_BITS = 1 << 24


def perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (with an id) and whether the id may be one of ids, as `perhaps`: true for all that are, and for few others while ids are
    few beside FILTER_BITS. So rows that surely have no partner needn't move to a join."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    place = lambda b: F.shiftright(b, 6).cast("int")
    known = ids.select(bit.alias("bit")).groupBy(place(F.col("bit")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
    told = rows.withColumn("bit", bit).withColumn("word", place(F.col("bit"))).join(F.broadcast(known), "word", "left")
    return told.withColumn("perhaps", F.coalesce(F.expr("shiftrightunsigned(bits, cast(bit % 64 AS int)) & 1L"), F.lit(0)) == 1).drop("bit", "word", "bits")


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: a, b. Returns node, component (the smallest node reachable) for nodes with a link to another one.

    Each round writes its links as a table, so a lost executor costs one round. A hub's links are summed before they
    move and joined by a join that can split a hub's rows, so no task holds a whole group.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, "links")
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state or not now.n:
            break
        state = (now.n, now.h)
        # Large star: every larger neighbour of a node points to the node's least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the node and its smaller neighbours point to the least of these.
        least = _least(big)
        near = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(edges)
        edges = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
