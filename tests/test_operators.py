import random

import pytest
from pyspark.sql import functions as F

from closura.operators import fixpoint as fx, lists as ls, primitives as pr


def rows(df):
    return {tuple(r) for r in df.collect()}


def reach(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(17)], [(1, 2), (2, 3), (3, 1), (5, 6)], [(random.Random(5).randint(0, 9), k % 10) for k in range(15)]])
def test_closure(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows(fx.closure(df)) == reach(set(edges))


def test_closure_keeps_groups_apart(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 3, 4)], "p long, a long, b long")
    assert rows(fx.closure(df, ("p",))) == {(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 3, 4)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert dict(rows(fx.components(spark.createDataFrame(edges, "a long, b long")))) == low


def test_round_cap(spark):
    with pytest.raises(fx.Diverged):
        fx.fixpoint(spark.createDataFrame([(0, 0, 0)], pr.TRIPLE), lambda new, whole, k: new.withColumn("s", F.col("s") + 1), most=3)


def test_signed_multiset(spark):
    rowset = [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, -1), (2, 2, 2, -1), (2, 2, 2, 1), (3, 3, 3, -1)]
    df = spark.createDataFrame(rowset, pr.SIGNED)
    assert rows(pr.consolidated(df)) == {(1, 1, 1, 1), (3, 3, 3, -1)}
    assert rows(pr.present(df)) == {(1, 1, 1)}
    assert rows(pr.negated(df.where("s = 3"))) == {(3, 3, 3, 1)}


def cells(*lists):
    out, k = [], 400
    for items in lists:
        for i, x in enumerate(items):
            out += [(k, 7, x), (k, 6, k + 1 if i + 1 < len(items) else 9)]
            k += 1
    return out


def test_lists(spark):
    got = ls.expanded(pr.triples(spark, cells([68, 71], [88], [1, 2, 3])))
    assert {(r["head"], tuple(r["items"])) for r in got.collect()} == {(400, (68, 71)), (402, (88,)), (403, (1, 2, 3))}
    assert (403, 2, 3) in rows(ls.unrolled(got))
    assert rows(ls.last_position(got)) == {(400, 1), (402, 0), (403, 2)}


def test_shared_tail_and_cycle(spark):
    shared = [(1, 7, 10), (1, 6, 3), (2, 7, 20), (2, 6, 3), (3, 7, 30), (3, 6, 9)]
    got = {r["head"]: r["items"] for r in ls.expanded(pr.triples(spark, shared)).collect()}
    assert got == {1: [10, 30], 2: [20, 30]}
    with pytest.raises(ls.CyclicList):
        ls.expanded(pr.triples(spark, [(1, 7, 10), (1, 6, 2), (2, 7, 20), (2, 6, 3), (3, 7, 30), (3, 6, 2)]))
    assert ls.expanded(pr.triples(spark, [])).count() == 0


def test_descriptions_of_jobs(spark):
    from closura.operators.lineage import described

    sc, key = spark.sparkContext, "spark.job.description"
    with described(spark, "outer"):
        with pytest.raises(ZeroDivisionError), described(spark, "inner"):
            assert sc.getLocalProperty(key) == "outer: inner"
            1 / 0  # noqa: B018
        assert sc.getLocalProperty(key) == "outer"
    assert sc.getLocalProperty(key) is None
