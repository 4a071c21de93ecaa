"""Rules one by one, in both readings, and profiles on a small university graph."""

import random

import pytest

from closura.functions import vocab as v
from closura.operators.primitives import triples
from closura.plans import local, rulesets
from closura.plans.profiles import close_schema, materialize, property_rewrites
from closura.plans.rules import apply, rule

from . import naive

SCHEMA = [
    (49, 0, 47), (51, 0, 53), (53, 0, 49), (55, 1, 57), (57, 1, 58), (57, 4, 11), (61, 12, 57), (62, 2, 49), (62, 3, 64),
    *[(c, 4, 33) for c in (47, 49, 51, 53)], *[(p, 4, 32) for p in (55, 57, 58, 62)],
]
FACTS = [(65, 55, 66), (65, 4, 51), (65, 62, 67), (65, 57, 68), (68, 57, 69), (69, 57, 70)]


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("profile", "compat", "limit", "count"), [("rdfs", False, 9999, 15), ("rdfspp", False, 9999, 28), ("rdfspp", False, 0, 28), ("owl2rl", False, 9999, 31), ("owl2rl", True, 9999, 23), ("dummy", False, 9999, 6)])
def test_profiles(spark, profile, compat, limit, count):
    m = materialize(triples(spark, SCHEMA), triples(spark, FACTS), profile, compat, limit)
    got = m.abox.collect()
    assert len(got) == len(set(got)) == count


def test_rdfspp_by_predicate(spark):
    got = rows(materialize(triples(spark, SCHEMA), triples(spark, FACTS), "rdfspp").abox)
    count = {p: sum(q == p for _, q, _ in got) for p in (55, 57, 58, 61, 62, 4)}
    assert count == {55: 1, 57: 7, 58: 7, 61: 7, 62: 1, 4: 5}


MICRO = [
    ("trp", [(100, 4, 11)], [(1001, 100, 1002), (1002, 100, 1003), (1001, 4, 200), (200, 4, 201)], {(1001, 100, 1003)}, {(1001, 4, 201)}),
    ("symp", [(100, 4, 39)], [(1001, 100, 1002), (1001, 4, 200)], {(1002, 100, 1001)}, {(200, 4, 1001), (33, 4, 13), (33, 4, 45)}),
    ("int", [(300, 17, 400), (400, 7, 201), (400, 6, 401), (401, 7, 202), (401, 6, 9)], [(1001, 4, 201), (1001, 4, 202), (1002, 4, 201)], {(1001, 4, 300)}, set()),
    ("svf", [(500, 15, 201), (500, 20, 100)], [(1001, 100, 1002), (1002, 101, 201)], set(), {(1001, 4, 500)}),
    ("fp", [(100, 4, 30)], [(1001, 100, 1002), (1001, 100, 1003), (1002, 101, 1009)], {(1003, 101, 1009)}, {(1003, 101, 1009)}),
    ("chain", [(100, 21, 400), (400, 7, 101), (400, 6, 401), (401, 7, 102), (401, 6, 402), (402, 7, 103), (402, 6, 9)], [(1001, 101, 1002), (1002, 102, 1003), (1003, 103, 1004)], {(1001, 100, 1004)}, {(1001, 100, 1004)}),
]


@pytest.mark.parametrize(("name", "schema", "facts", "w3c", "compat"), MICRO, ids=[m[0] for m in MICRO])
def test_micro(spark, name, schema, facts, w3c, compat):
    always = {(13, 4, 33), (45, 4, 33), *facts}
    for mode, want in ((False, w3c), (True, compat)):
        m = materialize(triples(spark, schema), triples(spark, facts), "owl2rl", mode)
        assert rows(m.abox) == always | want, mode
        if name == "fp":
            assert rows(m.same_as) == {(a, b) for a in (1002, 1003) for b in (1002, 1003)}


def test_schema_deviations(spark):
    op = close_schema(triples(spark, [(100, 4, 32)]), "owl2rl")[0]
    assert rows(op) == {(100, 4, 32), (100, 1, 100), (100, 19, 100)}
    svf = [(500, 15, 201), (500, 20, 100), (501, 15, 202), (501, 20, 100), (201, 0, 202)]
    assert (500, 0, 501) in rows(close_schema(triples(spark, svf), "owl2rl")[0])
    assert (500, 0, 501) not in rows(close_schema(triples(spark, svf), "owl2rl", True)[0])


def _random_schema(rng):
    props, classes, out = list(range(100, 105)), list(range(200, 206)), set()
    for _ in range(rng.randint(6, 14)):
        k = rng.choice(["spo", "sco", "dom", "rng", "inv", "eqp", "eqc", "tr", "sy", "fp", "ifp", "svf", "avf", "hv"])
        p, q, c, d = rng.choice(props), rng.choice(props), rng.choice(classes), rng.choice(classes)
        e = 500 + rng.randint(0, 3)
        out |= {
            "spo": {(p, 1, q)}, "sco": {(c, 0, d)}, "dom": {(p, 2, c)}, "rng": {(p, 3, c)}, "inv": {(p, 12, q)}, "eqp": {(p, 19, q)}, "eqc": {(c, 16, d)}, "tr": {(p, 4, 11)}, "sy": {(p, 4, 39)},
            "fp": {(p, 4, 30)}, "ifp": {(p, 4, 42)}, "svf": {(e, 15, rng.choice([c, 13])), (e, 20, p)}, "avf": {(e, 26, c), (e, 20, p)}, "hv": {(e, 44, 1001), (e, 20, p)},
        }[k]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_owl_against_naive(spark, seed):
    rng = random.Random(seed)
    schema = _random_schema(rng)
    people = list(range(1001, 1007))
    facts = sorted({(rng.choice(people), rng.choice(range(100, 105)), rng.choice(people)) for _ in range(6)} | {(rng.choice(people), 4, rng.choice(range(200, 206))) for _ in range(4)})
    want_t = naive.schema_closure(schema, rulesets.schema_rules().values())
    rules = [r for k, r in rulesets.fact_rules().items() if not k.startswith("eq-")]
    replace = [r for k, r in rulesets.fact_rules().items() if k.startswith("eq-")]
    want, same = naive.fact_closure(want_t, {*facts, (13, 4, 33), (45, 4, 33)}, rules, rulesets.identity_rules().values(), replace)
    m = materialize(triples(spark, schema), triples(spark, facts), "owl2rl")
    assert rows(m.tbox) == want_t
    assert rows(m.abox) == want
    assert rows(m.same_as) == same


def test_distributed_schema_is_the_same(spark):
    schema = _random_schema(random.Random(9)) + [(300, 17, 400), (400, 7, 201), (400, 6, 401), (401, 7, 202), (401, 6, 9), (105, 21, 410), (410, 7, 101), (410, 6, 411), (411, 7, 102), (411, 6, 9)]
    facts = [(1001, 101, 1002), (1002, 102, 1003), (1001, 4, 201), (1001, 4, 202)]
    a, b = (materialize(triples(spark, schema), triples(spark, facts), "owl2rl", limit=n) for n in (9999, 0))
    assert rows(a.tbox) == rows(b.tbox)
    assert rows(a.abox) == rows(b.abox)
    assert rows(a.same_as) == rows(b.same_as)


def test_every_rule_once(spark):
    rng = random.Random(4)
    schema, facts = _random_schema(rng), [(rng.randint(1001, 1005), rng.choice([100, 101, 102, 4]), rng.choice([1001, 1002, 200, 201])) for _ in range(12)]
    t, a, e = triples(spark, schema), triples(spark, set(facts)), spark.createDataFrame([(1001, 1002)], "a long, b long")
    for r in [*rulesets.schema_rules().values(), *rulesets.fact_rules().values(), *rulesets.identity_rules().values()]:
        got = rows(apply(r, {"T": (None, t), "A": (None, a), "E": (None, e)}))
        assert got == naive.once(r, {"T": set(schema), "A": set(facts), "E": {(1001, 1002)}}), r.name


def test_schema_comes_before_the_second_fact(spark, monkeypatch):
    """Whatever place is new, facts meet the schema before they meet other facts."""
    from closura.plans import rules

    seen = []
    plain = rules._joined
    monkeypatch.setattr(rules, "_joined", lambda atoms, r: seen.append([set(a.columns) for a in atoms]) or plain(atoms, r))
    t, a = triples(spark, [(100, 4, 42)]), triples(spark, FACTS)
    r = rulesets.identity_rules()["prp-ifp"]
    for new in (None, a):
        apply(r, {"T": (None, t), "A": (new, a)})
    assert len(seen) == 3 and all(x[1] == {"p"} for x in seen)


def test_driver_side_closures_are_bounded():
    chain = [(i, v.SUB_CLASS_OF, i + 1) for i in range(100, 200)]
    rules = [rulesets.schema_rules()["scm-sco"]]
    assert len(local.closed(chain, rules)) == 100 * 101 // 2
    with pytest.raises(local.TooLarge):
        local.closed(chain, rules, most=2_000)
    with pytest.raises(local.TooLarge):
        property_rewrites([(i, v.SUB_PROPERTY_OF, i + 1) for i in range(100, 200)], most=2_000)


def test_semi_naive_places(spark):
    r = rule("x", "A ?a 100 ?b; A ?b 100 ?c -> ?a 100 ?c")
    old, new = [(1, 100, 2), (2, 100, 3)], [(3, 100, 4)]
    whole = triples(spark, old + new)
    assert rows(apply(r, {"A": (triples(spark, new), whole)})) == {(2, 100, 4)}


def test_rewrites_follow_paths():
    got = property_rewrites([(1, v.SUB_PROPERTY_OF, 2), (2, v.INVERSE_OF, 3), (3, v.TYPE, v.SYMMETRIC)])
    assert {(1, 2, False), (1, 3, True), (1, 3, False), (3, 3, True), (3, 2, True), (3, 2, False)} <= got
    assert local.closed([(1, 0, 2), (2, 0, 1)], [rulesets.schema_rules()["scm-sco"]]) == {(1, 0, 2), (2, 0, 1), (1, 0, 1), (2, 0, 2)}
