"""Replacement by identity (F3)."""

from closura.functions import vocab as v
from closura.operators.primitives import triples
from closura.plans import profiles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replacement_makes_each_fact_once(spark):
    """a class of m members with a fact each gives m * m facts, not m ** 3 before they are made distinct."""
    classes = spark.createDataFrame([(k, 10) for k in range(10, 40)] + [(900, 900), (901, 900)], "node long, component long")
    facts = triples(spark, [(k, 900, k + 4000) for k in range(10, 40)] + [(1, 2, 3), (1, 2, 11)])
    got = rows(profiles.replaced(facts, classes))
    want = {(a, p, k + 4000) for a in range(10, 40) for p in (900, 901) for k in range(10, 40)} | {(1, 2, k) for k in range(10, 40)}
    assert got == sorted(want)


def test_identity_merged_by_what_replacement_made(spark):
    """facts under a replaced subject may make more the same, which replaces more."""
    t = triples(spark, [(100, v.TYPE, v.INVERSE_FUNCTIONAL), (101, v.TYPE, v.FUNCTIONAL), (102, v.SUB_PROPERTY_OF, 103)])
    a = triples(spark, [(1, 100, 7), (2, 100, 7), (1, 101, 50), (2, 101, 51), (51, 102, 60)])
    for limit in (profiles.SCHEMA_ROWS, 0):
        m = profiles.materialize(t, a, "owl2rl", limit=limit)
        got = {r for r in rows(m.abox) if r[1] != v.TYPE}
        want = {(x, 100, 7) for x in (1, 2)} | {(x, 101, y) for x in (1, 2) for y in (50, 51)} | {(y, p, 60) for y in (50, 51) for p in (102, 103)}
        assert got == want
        assert rows(m.same_as) == sorted((x, y) for c in ((1, 2), (50, 51)) for x in c for y in c)
