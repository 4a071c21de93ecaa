"""Closures kept up to date under insertions and deletions.

The base is a signed multiset: a fact is there if its weights sum to more than 0, in
whatever order they came.  Each batch is an epoch; what it changed in the closure comes
out as (s, p, o, epoch, diff) with diff 1 or -1.

* A batch is consolidated, and the base is looked at for its facts only: that tells which
  were gained and which lost.  Base and closure are layers of written tables; a batch adds
  its own, and over ``LAYERS`` they are written as one.
* Insertions go through the fixpoint from the new facts alone.
* Deletions, by default, delete and rederive (Gupta, Mumick & Subrahmanian 1993): what the
  lost facts helped to derive goes; of that, what is still in the base or follows from
  what stayed comes back, to a fixpoint.  Rules that look at fact lists as wholes, and any
  change of the schema, take the whole closure anew.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as v
from ..operators.fixpoint import fixpoint
from ..operators.lineage import cut, unsent
from ..operators.primitives import COLS, consolidated, present, union
from ..plans import rulesets
from ..plans.profiles import SCHEMA_ROWS, _small, close_schema, materialize, profile_of
from ..plans.rules import apply_all, rule
from ..sources.triples import signed

LAYERS = 8
FEW = 100_000  # facts of a batch, or suspects of a deletion, up to which they are broadcast


def changes(old: DataFrame, new: DataFrame, epoch: int) -> DataFrame:
    """What ``new`` gained and lost over ``old``."""
    return _tagged(new.join(_few(old), list(COLS), "left_anti"), old.join(_few(new), list(COLS), "left_anti"), epoch)


def _tagged(added: DataFrame, removed: DataFrame, epoch: int) -> DataFrame:
    tag = lambda df, d: df.select(*COLS, F.lit(epoch).cast("long").alias("epoch"), F.lit(d).cast("int").alias("diff"))
    return tag(added, 1).union(tag(removed, -1))


def _few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is counted to be small, else shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


@dataclass
class Incremental:
    """State of one closure; ``apply`` takes a batch and returns its changes."""

    profile: str = "rdfspp"
    compat: bool = False
    rederive: bool = True
    epoch: int = 0
    base_schema: DataFrame | None = None
    base_layers: list[DataFrame] = field(default_factory=list)
    tbox: DataFrame | None = None
    abox: DataFrame | None = None
    layers: int = 1
    log: list[tuple] = field(default_factory=list)

    @property
    def base_facts(self) -> DataFrame | None:
        """The base's facts with their weights (s, p, o, diff)."""
        return consolidated(self._base()) if self.base_layers else None

    def _base(self) -> DataFrame:
        out = self.base_layers[0]
        for x in self.base_layers[1:]:
            out = out.union(x)
        return out

    def apply(self, schema: DataFrame | None = None, facts: DataFrame | None = None, name: str = "batch") -> DataFrame:
        """Signed updates (s, p, o, diff) of the schema, the facts, or both.  The result
        is the facts' changes; ``schema_changes`` has the schema's."""
        began = time.time()
        self.profile = profile_of(self.profile)
        spark = (schema if schema is not None else facts).sparkSession
        empty = spark.createDataFrame([], "s long, p long, o long, diff int")
        old_t = self.tbox if self.tbox is not None else empty.select(*COLS)
        old_a = self.abox if self.abox is not None else empty.select(*COLS)
        batch = empty if facts is None else cut(consolidated(facts.select(*COLS, "diff")))
        gained, lost = self._netted(batch)
        self._layered(batch)
        if schema is not None:
            self.base_schema = cut(consolidated(union_signed(self.base_schema, schema)))
        elif self.base_schema is None:
            self.base_schema = empty
        if schema is None and self.rederive and self.abox is not None and self.profile in ("rdfs", "rdfspp") and not self._mixes():
            added, removed = self._maintained(gained, lost)
            out = cut(_tagged(added, removed, self.epoch))
        else:
            m = materialize(present(self.base_schema), present(self._base()), self.profile, self.compat)
            self.abox, self.layers, new_t = cut(m.abox), 1, m.tbox
            if schema is not None or self.tbox is None:
                self.tbox = cut(new_t)
            out = cut(changes(old_a, self.abox, self.epoch))
        self.schema_changes = empty.select(*COLS, F.lit(0).cast("long").alias("epoch"), "diff").limit(0) if schema is None else changes(old_t, self.tbox, self.epoch)
        if self.layers > LAYERS:
            self.abox, self.layers = cut(self.abox), 1
        n = {r["diff"]: r["count"] for r in out.groupBy("diff").count().collect()}
        self.log.append((name, int((time.time() - began) * 1000), n.get(1, 0), n.get(-1, 0), 0))
        self.epoch += 1
        return out

    def _netted(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Facts that the batch brings into the base, and those that it takes out."""
        if not self.base_layers:
            return batch.where("diff > 0").select(*COLS), batch.limit(0).select(*COLS)
        mine = self._base().join(_few(batch.select(*COLS)), list(COLS), "left_semi").groupBy(*COLS).agg(F.sum("diff").alias("was"))
        net = cut(batch.join(unsent(mine, batch), list(COLS), "left").select(*COLS, (F.coalesce("was", F.lit(0)) > 0).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("diff") > 0).alias("now")))
        return net.where("now and not was").select(*COLS), net.where("was and not now").select(*COLS)

    def _layered(self, batch: DataFrame) -> None:
        self.base_layers.append(batch)
        if len(self.base_layers) > LAYERS:
            self.base_layers = [cut(consolidated(self._base()))]

    # -- delete and rederive --------------------------------------------------

    def _rules(self) -> list:
        names = rulesets.RDFS_FACTS
        out = [names[k] for k in ("rdfs2", "rdfs3", "rdfs9")]
        if self.profile == "rdfspp":
            more = rulesets.fact_rules()
            trans = rule("trans", "T ?p ?any Transitive; A ?x ?p ?y; A ?y ?p ?z -> ?x ?p ?z")
            return out + [names["rdfs7"], more["prp-inv1"], more["prp-inv2"], trans]
        return out + [names["rdfs7"]]

    def _mixes(self) -> bool:
        """These profiles keep types and properties apart (see ``profiles.rdfs``), so a
        schema that makes one of the other is closed anew."""
        between = F.col("p").isin(v.SUB_PROPERTY_OF, v.INVERSE_OF) & ((F.col("o") == v.TYPE) | (F.col("s") == v.TYPE))
        return self.tbox.where(between | F.col("p").isin(v.DOMAIN, v.RANGE) & (F.col("s") == v.TYPE)).limit(1).count() > 0

    def _maintained(self, gained: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the closure gains and loses; ``abox`` is brought up to it."""
        t, old = self.tbox, self.abox
        # the schema is counted: up to SCHEMA_ROWS it is broadcast, beyond it is shuffled
        sides = ("T",) if _small(t) is not None else ()
        rules = self._rules()
        made = lambda new, whole: apply_all(rules, {"A": (new, whole), "T": (None, t)}, sides)
        none = gained.limit(0)
        over = back = none
        if lost.limit(1).count():
            # all that the lost facts had a part in
            side = unsent(old)
            over = cut(fixpoint(lost, lambda new, _, k: made(new, side).join(side, list(COLS), "left_semi")))
            suspects = _few(over)
            old, self.layers = cut(old.join(suspects, list(COLS), "left_anti")), 1  # else every round sends the suspects again
            still = present(self._base().join(suspects, list(COLS), "left_semi"))
            again = made(None, unsent(old)).join(suspects, list(COLS), "left_semi")
            back = fixpoint(still.union(again), lambda new, whole, k: made(new, whole), known=old, only_new=True)
            old = old.union(back)
        new = fixpoint(gained, lambda new, whole, k: made(new, whole), known=old, only_new=True) if gained.limit(1).count() else none
        self.abox, self.layers = old.union(new), self.layers + 1
        return new.join(_few(over), list(COLS), "left_anti"), over.join(_few(back.union(new)), list(COLS), "left_anti")


def union_signed(old: DataFrame | None, new: DataFrame) -> DataFrame:
    new = new.select(*COLS, "diff")
    return new if old is None else old.select(*COLS, "diff").union(new)


def phases(facts: DataFrame, fraction: float) -> list[DataFrame]:
    """The benchmark's batches: the first ``fraction`` of the facts, the rest, and the
    rest taken out again.  0 or 1 is one batch.  First is by a hash of the fact, so that
    it doesn't need an order of the whole input."""
    if not 0 < fraction < 1:
        return [signed(facts)]
    early = F.pmod(F.xxhash64(*COLS), F.lit(1_000_000)) < int(fraction * 1_000_000)
    rest = facts.where(~early)
    return [signed(facts.where(early)), signed(rest), signed(rest, -1)]


__all__ = ["Incremental", "SCHEMA_ROWS", "changes", "close_schema", "phases", "union"]
