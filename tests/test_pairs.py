"""Rules that put two facts together (F6, F12, F13)."""

from closura import catalog
from closura.functions import vocab as v
from closura.operators.primitives import triples
from closura.plans import rulesets
from closura.plans.rules import apply


def test_parts_follow_the_facts(spark, monkeypatch):
    """A key of most facts is in no task of its own, and few facts of many go into a task."""
    monkeypatch.setattr(catalog, "FACTS_A_TASK", 20)
    t = triples(spark, [(1, v.TYPE, v.TRANSITIVE), (2, v.TYPE, v.FUNCTIONAL), (3, v.TYPE, v.INVERSE_FUNCTIONAL)])
    a = triples(spark, [(k, p, k % 3) for k in range(100, 300) for p in (1, 2, 3)] + [(k, 1, 7 + j) for k in range(3) for j in range(2)] + [(100 + k % 4, 2, k) for k in range(9)])
    rules = [rulesets.fact_rules()["prp-trp"], *rulesets.identity_rules().values()]
    for r in rules:
        for sent in (catalog.SENT_ROWS, 0):
            monkeypatch.setattr(catalog, "SENT_ROWS", sent)
            sources = {"T": (None, t), "A": (None, a)}
            got = catalog._paired(r, sources, a)
            assert got.rdd.getNumPartitions() > 30
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apply(r, sources, ("T",)).distinct().collect()))
