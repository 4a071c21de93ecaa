"""What functional properties make the same, as edges and not as pairs."""

from closura.functions import vocab as v
from closura.operators.fixpoint import components
from closura.operators.primitives import triples
from closura.plans.profiles import stars


def test_a_large_class_is_as_many_edges(spark):
    rows = [(1, 100, 1000 + k) for k in range(4000)] + [(k, 101, 7) for k in range(20)] + [(2, 102, 1), (2, 102, 3), (5, 100, 6)]
    fp, ifp = spark.createDataFrame([(100,)], "p long"), spark.createDataFrame([(101,), (v.TYPE,)], "p long")
    edges = None
    for x in stars(triples(spark, rows), fp, ifp):
        edges = x if edges is None else edges.union(x)
    assert edges.count() == 3999 + 19
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {1000 + k: 1000 for k in range(4000)} | {k: 0 for k in range(20)}
