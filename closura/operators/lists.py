"""RDF collections: cells ``h first x, h rest t`` from a head to ``nil``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as v
from .lineage import cut
from .primitives import pairs


class CyclicList(ValueError):
    """A list never reaches nil."""


def expanded(tbox: DataFrame, longest: int = 10_000) -> DataFrame:
    """head, items: the lists whose head is no other cell's tail.  A list that runs
    into a cycle is an error, not a loop; a tail may be shared."""
    cells = cut(pairs(tbox, v.FIRST, "cell", "item").join(pairs(tbox, v.REST, "cell", "tail"), "cell").distinct())
    heads = cells.join(cells.select(F.col("tail").alias("cell")).distinct(), "cell", "left_anti")
    walk = cut(heads.select(F.col("cell").alias("head"), F.array("item").alias("items"), "tail"))
    done = walk.where(F.col("tail") == v.NIL)
    count = cells.count()
    for _ in range(min(count, longest) + 1):
        open_ = walk.where(F.col("tail") != v.NIL)
        if not open_.limit(1).count():
            return done.select("head", "items").distinct()
        step = open_.join(cells.select(F.col("cell").alias("tail"), "item", F.col("tail").alias("next")), "tail")
        walk = cut(step.select("head", F.concat("items", F.array("item")).alias("items"), F.col("next").alias("tail")))
        done = done.union(walk.where(F.col("tail") == v.NIL))
    raise CyclicList("a list does not end in nil")


def unrolled(lists: DataFrame) -> DataFrame:
    """head, pos (from 0), item."""
    return lists.select("head", F.posexplode("items").alias("pos", "item")).select("head", F.col("pos").cast("long").alias("pos"), "item")


def last_position(lists: DataFrame) -> DataFrame:
    return lists.select("head", (F.size("items") - 1).cast("long").alias("last"))
