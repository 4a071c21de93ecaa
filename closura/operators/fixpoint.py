"""Semi-naive fixpoints over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .lineage import cut, described, discard, unsent
from .primitives import COLS, union


class Diverged(RuntimeError):
    """A fixpoint took more rounds than allowed."""


def fixpoint(start: DataFrame, step: Callable[[DataFrame, DataFrame, int], DataFrame], most: int = 200, cols: tuple[str, ...] = COLS, known: DataFrame | None = None, only_new: bool = False) -> DataFrame:
    """The least set with ``start`` that ``step(new, all, round)`` adds nothing to.
    ``known`` is a set to which it adds nothing already; only what ``start`` has beyond
    it is new, and with ``only_new`` only what was found beyond it is returned.

    ``new`` are last round's rows; ``all`` has them.  Each round writes only its new
    rows, and ``all`` is the union of what the rounds wrote; ``known`` is never written
    again, and files that were put together are deleted."""
    first = start.select(*cols).distinct()
    new = cut(first if known is None else first.join(unsent(known), list(cols), "left_anti"))
    if known is not None and not new.limit(1).count():
        return new if only_new else known
    fresh = [new]
    for k in range(most):
        parts = fresh if known is None else [known, *fresh]
        whole = _all(parts)
        side = unsent(whole, *parts)
        found = step(unsent(new), side, k).select(*cols).distinct().join(side, list(cols), "left_anti")
        with described(start.sparkSession, f"fixpoint round {k + 1}"):
            new = cut(found)
        if not new.limit(1).count():
            discard(new)
            return _all(fresh) if only_new else whole
        if len(fresh) > 10:  # many small parts: one scan again
            one = cut(_all(fresh))
            discard(*fresh)
            fresh = [one]
        fresh.append(new)
    raise Diverged(f"no fixpoint after {most} rounds")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def closure(edges: DataFrame, by: tuple[str, ...] = (), most: int = 64) -> DataFrame:
    """Transitive closure of (by..., a, b) within equal ``by``: paths double in length,
    so rounds grow with the logarithm of the longest.

    A round puts paths of exactly 2**k edges before all of up to 2**k: a pair at the end of one path
    is made once, not once for each way to cut the path in two.  It ends when no path has
    2**k edges, or nothing is new."""
    cols = (*by, "a", "b")
    whole = new = cut(edges.select(*cols).distinct())
    shorter = None  # of what was found before ``new``
    exact, last, parts = new, new, [new]
    for k in range(most):
        tails = exact.select(*cols).withColumn("exact", F.lit(True))
        tails = tails.unionByName((new if k else new.limit(0)).select(*cols).withColumn("exact", F.lit(False)))
        if shorter is not None:
            tails = tails.unionByName(shorter.select(*cols).withColumn("exact", F.lit(False)))
        heads = unsent(exact.select(*by, "a", F.col("b").alias("m")), last)
        made = heads.join(unsent(tails.withColumnRenamed("a", "m"), *parts), [*by, "m"]).groupBy(*cols).agg(F.max("exact").alias("exact"))
        made = made.join(unsent(whole.select(*cols, F.lit(True).alias("known")), *parts), list(cols), "left")
        with described(edges.sparkSession, f"closure round {k + 1}"):
            made = last = cut(made)
        parts.append(made)
        shorter, new, exact = whole, made.where("known is null and not exact").select(*cols), made.where("exact").select(*cols)
        if not made.where("known is null").limit(1).count():
            return whole
        whole = whole.unionByName(made.where("known is null").select(*cols))
        if not exact.limit(1).count():
            return whole
    raise Diverged(f"no closure after {most} rounds")


def transitive_facts(facts: DataFrame, properties: DataFrame) -> DataFrame:
    """Facts closed under the transitivity of ``properties`` (p)."""
    own = F.broadcast(properties.select("p").distinct())
    edges = facts.join(own, "p", "left_semi").select("p", F.col("s").alias("a"), F.col("o").alias("b"))
    closed = closure(edges, ("p",)).select(F.col("a").alias("s"), "p", F.col("b").alias("o"))
    return union(facts.join(own, "p", "left_anti").distinct(), closed)  # both without repeats, and of different properties


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of (a, b) pairs, the component named by its least node, by
    alternating large-star and small-star steps."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for k in range(most):
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before or not now[0]:
            return nodes.join(unsent(e.select(F.col("u").alias("node"), "v"), e), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = unsent(both.where("v > u"), e).join(unsent(least, e), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = unsent(large, e).join(unsent(low, e), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        with described(edges.sparkSession, f"components round {k + 1}"):
            last, e = e, cut(links.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
    raise Diverged("components did not settle")


def same_as_pairs(edges: DataFrame) -> DataFrame:
    """All (a, b) of one class, symmetric, transitive and reflexive over its members.
    The output is quadratic in a class, as the relation is."""
    return class_pairs(components(edges))


def class_pairs(c: DataFrame) -> DataFrame:
    """All pairs (a, b) of the members of a class, from (node, component)."""
    return c.select(F.col("node").alias("a"), "component").join(c.select(F.col("node").alias("b"), "component"), "component").select("a", "b")
