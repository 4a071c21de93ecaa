import random

import pytest
from pyspark.sql import functions as F

from closura.operators.primitives import SIGNED, triples
from closura.plans.profiles import materialize
from closura.sources.triples import read_feed, signed
from closura.streaming.feed import last_epoch, materialize_stream, restore
from closura.streaming.incremental import Incremental, phases

SCHEMA = [(49, 0, 47), (51, 0, 49), (57, 1, 58), (57, 4, 11), (61, 12, 57), (57, 2, 51), (58, 3, 52)]


def rows(df):
    return {tuple(r) for r in df.collect()}


def signed_rows(spark, xs, d=1):
    return spark.createDataFrame([(*x, d) for x in xs], SIGNED)


@pytest.mark.parametrize(("profile", "rederive"), [("rdfspp", True), ("rdfs", True), ("rdfspp", False), ("owl2rl", True)])
def test_like_from_scratch(spark, profile, rederive):
    rng = random.Random(3)
    t = triples(spark, SCHEMA)
    state = Incremental(profile, rederive=rederive)
    base: list = []
    before: set = set()
    for k in range(3):
        add = [(rng.randint(100, 107), 57, rng.randint(100, 107)) for _ in range(4)]
        gone = rng.sample(base, min(3, len(base)))
        for x in gone:
            base.remove(x)
        base += add
        got = state.apply(signed_rows(spark, SCHEMA) if k == 0 else None, signed_rows(spark, add).union(signed_rows(spark, gone, -1)))
        want = rows(materialize(t, triples(spark, set(base)), profile).abox)
        assert rows(state.abox) == want
        assert rows(got) == {(*x, k, 1) for x in want - before} | {(*x, k, -1) for x in before - want}
        before = want


def test_two_supports_cycles_and_order(spark):
    state = Incremental("rdfspp")
    state.apply(signed_rows(spark, SCHEMA), signed_rows(spark, [(1, 57, 2), (2, 57, 3), (1, 57, 3), (1, 57, 2)]))
    assert state.apply(facts=signed_rows(spark, [(1, 57, 2)], -1)).count() == 0  # added twice
    got = rows(state.apply(facts=signed_rows(spark, [(1, 57, 3)], -1)))
    assert got == set()  # still follows from the other two
    state.apply(facts=signed_rows(spark, [(3, 57, 1)]))  # a cycle
    state.apply(facts=signed_rows(spark, [(3, 57, 1)], -1))
    assert {x for x in rows(state.abox) if x[1] == 57} == {(1, 57, 2), (2, 57, 3), (1, 57, 3)}
    assert state.apply(facts=signed_rows(spark, [(8, 57, 9)], -1)).count() == 0  # taken out before it is added
    assert state.apply(facts=signed_rows(spark, [(8, 57, 9)])).count() == 0


def test_add_then_delete_is_nothing_and_schema_changes(spark):
    facts = triples(spark, [(i, 57, i + 1) for i in range(100, 106)])
    state = Incremental("rdfspp")
    parts = phases(facts, 0.5)
    assert len(parts) == 3 and len(phases(facts, 1.0)) == 1
    state.apply(signed_rows(spark, SCHEMA), parts[0])
    first = rows(state.abox)
    state.apply(facts=parts[1])
    state.apply(facts=parts[2])
    assert rows(state.abox) == first
    state.apply(schema=signed_rows(spark, [(57, 4, 11)], -1))
    assert rows(state.abox) == rows(materialize(triples(spark, [x for x in SCHEMA if x != (57, 4, 11)]), state_base(state), "rdfspp").abox)
    assert rows(state.schema_changes) == {(57, 4, 11, 3, -1)}


def state_base(state):
    return state.base_facts.where("diff > 0").select("s", "p", "o")


def test_idempotent_and_monotone(spark):
    t, a = triples(spark, SCHEMA), [(1, 57, 2), (2, 57, 3)]
    once = materialize(t, triples(spark, a), "rdfspp").abox
    assert rows(materialize(t, once, "rdfspp").abox) == rows(once)
    assert rows(once) <= rows(materialize(t, triples(spark, [*a, (3, 57, 4)]), "rdfspp").abox)


def test_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    seq = lambda df, n: df.withColumn("seq", F.lit(n).cast("long"))
    seq(signed(triples(spark, [(1, 57, 2), (2, 57, 3)])), 0).coalesce(1).write.parquet(feed)
    state = Incremental("rdfspp")
    state.apply(schema=signed_rows(spark, SCHEMA))
    run = lambda: materialize_stream(read_feed(spark, feed), state, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    seq(signed(triples(spark, [(2, 57, 3)]), -1), 1).coalesce(1).write.mode("append").parquet(feed)
    run()
    t = triples(spark, SCHEMA)
    assert rows(state.abox) == rows(materialize(t, triples(spark, [(1, 57, 2)]), "rdfspp").abox)
    # a new process: nothing but the files; a schema update comes with the facts
    state = Incremental("rdfspp")
    more = seq(signed(triples(spark, [(5, 57, 6)])), 2).withColumn("axiom", F.lit(False)).union(seq(signed(triples(spark, [(57, 0, 99), (51, 0, 77)])), 2).withColumn("axiom", F.lit(True)))
    more.coalesce(1).write.mode("append").parquet(feed)
    materialize_stream(read_feed(spark, feed, axioms=True).fillna(False, ["axiom"]), state, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    t = triples(spark, [*SCHEMA, (57, 0, 99), (51, 0, 77)])
    assert rows(state.abox) == rows(materialize(t, triples(spark, [(1, 57, 2), (5, 57, 6)]), "rdfspp").abox)
    assert {(57, 0, 99, 1), (51, 0, 77, 1)} <= rows(spark.read.parquet(str(tmp_path / "out-schema")).select("s", "p", "o", "diff"))
    again = Incremental("rdfspp")  # the last epoch is known to be done
    restore(spark, str(tmp_path / "cp-state"), again, last_epoch(spark, str(tmp_path / "cp-state")))
    assert rows(again.abox) == rows(state.abox) and rows(again.tbox) == rows(state.tbox) and again.epoch == 3
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("diff = -1").count() == out.where("diff = 1").count() - state.abox.count()
    (tmp_path / "cp").rename(tmp_path / "gone")  # Spark would count from 0 again, and those epochs count as done
    with pytest.raises(ValueError, match="is gone"):
        run()
