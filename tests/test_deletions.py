"""What a deletion leaves behind (F8 to F11)."""

from closura.functions import vocab as v
from closura.operators.primitives import COLS, triples
from closura.streaming.incremental import Incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_closure_after_deletions_sends_nothing_again(spark):
    """F8 to F11: what is left after a deletion is written, so reading it joins nothing."""
    plus = lambda df, d=1: df.selectExpr("*", f"{d} AS diff")
    state = Incremental("rdfspp")
    state.apply(plus(triples(spark, [(100, v.TYPE, v.TRANSITIVE)])), plus(triples(spark, [(k, 100, k + 1) for k in range(6)])))
    got = state.apply(facts=plus(triples(spark, [(2, 100, 3)]), -1))
    assert rows(got.select(*COLS, "diff")) == sorted((a, 100, b, -1) for a in range(3) for b in range(3, 7))
    assert "Join" not in state.abox._jdf.queryExecution().optimizedPlan().toString()
