"""Rounds and rows of the transitive closure (F7)."""

from closura.operators import fixpoint as fx
from closura.operators.primitives import triples


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_of_a_chain_has_no_idle_round(spark, monkeypatch):
    """a chain of 15 edges is closed when no path of 16 is left, one round earlier."""
    written = []
    cut = fx.cut
    monkeypatch.setattr(fx, "cut", lambda df: written.append(1) or cut(df))
    got = rows(fx.closure(spark.createDataFrame([(k, k + 1) for k in range(15)], "a long, b long")))
    assert got == [(a, b) for a in range(16) for b in range(a + 1, 16)]
    assert len(written) == 5  # the edges and four rounds


def test_transitive_facts_without_repeats(spark):
    """facts of other properties are made distinct, too."""
    facts = triples(spark, [(1, 5, 2), (2, 5, 3), (2, 5, 3), (1, 6, 2), (1, 6, 2), (2, 6, 3)])
    got = rows(fx.transitive_facts(facts, spark.createDataFrame([(5,)], "p long")))
    assert got == [(1, 5, 2), (1, 5, 3), (1, 6, 2), (2, 5, 3), (2, 6, 3)]
