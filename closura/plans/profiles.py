"""Materialisation: the closure of facts under a schema and a profile's rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as v
from ..operators import lists as ls
from ..operators.fixpoint import class_pairs, closure, components, fixpoint
from ..operators.lineage import cut, unsent
from ..operators.primitives import COLS, TRIPLE, distinct, pairs, triples, union
from . import local, rulesets
from .rules import Rule, apply, apply_all

PROFILES = ("rdfs", "rdfspp", "owl2rl", "dummy")
SCHEMA_ROWS = 50_000  # axioms up to which the schema is worked out on the driver
BROADCAST_ROWS = 1_000_000  # closed axioms up to which parts of the schema are broadcast
REPLACED_ROWS = 100_000  # members of identity classes up to which they are broadcast


@dataclass
class Materialized:
    """The closed schema, its lists (head, items), the closed facts, and the pairs that
    were found identical (a, b), symmetric and transitive."""

    tbox: DataFrame
    lists: DataFrame
    abox: DataFrame
    same_as: DataFrame


def profile_of(name: str) -> str:
    """Spellings of the command line; an unknown one echoes its input."""
    key = name.lower().replace("_", "").replace("-", "").replace("++", "pp").replace(" ", "")
    return key if key in PROFILES else "dummy"


def _small(tbox: DataFrame, limit: int = SCHEMA_ROWS) -> list[tuple] | None:
    """The schema's rows, if they are few."""
    rows = tbox.select("s", "p", "o").distinct().limit(limit + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= limit else None


# -- first stage: the schema --------------------------------------------------


def _locally(spark, rows: list[tuple] | None, rules) -> DataFrame | None:
    """The closure of a small schema, if that is small too."""
    if rows is None:
        return None
    try:
        return triples(spark, sorted(local.closed(rows, rules)))
    except local.TooLarge:
        return None


def close_rdfs(tbox: DataFrame, limit: int = SCHEMA_ROWS) -> DataFrame:
    """subClassOf and subPropertyOf, transitively."""
    rules = [r for k, r in rulesets.schema_rules().items() if k in ("scm-sco", "scm-spo")]
    closed = _locally(tbox.sparkSession, _small(tbox, limit), rules)
    if closed is not None:
        return closed
    parts = [tbox]
    for p in (v.SUB_CLASS_OF, v.SUB_PROPERTY_OF):
        parts.append(closure(pairs(tbox, p, "a", "b")).select(F.col("a").alias("s"), F.lit(p).cast("long").alias("p"), F.col("b").alias("o")))
    return union(*parts).distinct()


def list_axioms(tbox: DataFrame, lists: DataFrame) -> DataFrame:
    """scm-int and scm-uni: a class of an intersection is below its members, the members
    of a union are below it."""
    items = ls.unrolled(lists)
    below = pairs(tbox, v.INTERSECTION_OF, "c", "head").join(items, "head")
    above = pairs(tbox, v.UNION_OF, "c", "head").join(items, "head")
    sub = lambda df, s, o: df.select(F.col(s).alias("s"), F.lit(v.SUB_CLASS_OF).cast("long").alias("p"), F.col(o).alias("o"))
    return sub(below, "c", "item").union(sub(above, "item", "c")).distinct()


def close_owl(tbox: DataFrame, compat: bool = False, limit: int = SCHEMA_ROWS) -> tuple[DataFrame, DataFrame]:
    lists = cut(ls.expanded(tbox))
    start = union(tbox, list_axioms(tbox, lists)).distinct()
    rules = rulesets.schema_rules(compat)
    closed = _locally(tbox.sparkSession, _small(start, limit), rules.values())
    if closed is not None:
        return closed, lists
    return fixpoint(start, lambda new, whole, _: apply_all(rules.values(), {"T": (new, whole)})), lists


def close_schema(tbox: DataFrame, profile: str, compat: bool = False, limit: int = SCHEMA_ROWS) -> tuple[DataFrame, DataFrame]:
    empty = tbox.sparkSession.createDataFrame([], "head long, items array<long>")
    if profile == "dummy":
        return distinct(tbox), empty
    if profile == "owl2rl":
        return close_owl(tbox, compat, limit)
    return close_rdfs(tbox, limit), empty


# -- compiled lookup tables -----------------------------------------------------


def property_rewrites(rows: list[tuple], symmetric: bool = True, equivalent: bool = True, most: int = local.MOST) -> set[tuple[int, int, bool]]:
    """(p, q, swap): x p y makes x q y, or y q x.  Paths over subproperty, equivalent,
    inverse and symmetric axioms, so one join takes a fact all the way.  There may be many
    more paths than axioms: beyond ``most`` of them ``TooLarge`` is raised."""
    step: dict[int, set] = {}
    add = lambda a, b, swap: step.setdefault(a, set()).add((b, swap))
    for s, p, o in rows:
        if p == v.SUB_PROPERTY_OF:
            add(s, o, False)
        elif p == v.EQUIVALENT_PROPERTY and equivalent:
            add(s, o, False)
            add(o, s, False)
        elif p == v.INVERSE_OF:
            add(s, o, True)
            add(o, s, True)
        elif symmetric and p == v.TYPE and o == v.SYMMETRIC:
            add(s, s, True)
    out = set()
    for start in step:
        todo, seen = [(start, False)], {(start, False)}
        while todo:
            a, swap = todo.pop()
            for b, t in step.get(a, ()):
                if (x := (b, swap ^ t)) not in seen:
                    seen.add(x)
                    todo.append(x)
            if len(out) + len(seen) > most:
                raise local.TooLarge
        out |= {(start, b, swap) for b, swap in seen if (b, swap) != (start, False)}
    return out


def _table(spark, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(sorted(rows), schema))


def rewritten(facts: DataFrame, table: DataFrame) -> DataFrame:
    swap = F.col("swap")
    out = facts.join(table, facts["p"] == table["p_in"])
    return out.select(F.when(swap, F.col("o")).otherwise(F.col("s")).alias("s"), F.col("p_out").alias("p"), F.when(swap, F.col("s")).otherwise(F.col("o")).alias("o"))


def _typed(facts: DataFrame, table: DataFrame) -> DataFrame:
    """Facts by (p, at_object, c): the subject or object of p is of class c."""
    out = facts.join(table, facts["p"] == table["p_in"])
    return out.select(F.when(F.col("at_object"), F.col("o")).otherwise(F.col("s")).alias("s"), F.lit(v.TYPE).cast("long").alias("p"), F.col("c").alias("o"))


def _classed(facts: DataFrame, table: DataFrame) -> DataFrame:
    own = facts.where(F.col("p") == v.TYPE)
    return own.join(table, own["o"] == table["c_in"]).select("s", "p", F.col("c_out").alias("o"))


# -- second stage: the facts ------------------------------------------------------


def rdfs(tbox: DataFrame, abox: DataFrame, recursive: bool = False, limit: int = SCHEMA_ROWS) -> DataFrame:
    """``tbox`` is closed.  Subproperties (with ``recursive``, also inverse and transitive
    properties, to a fixpoint), then domains and ranges, then superclasses.  Types are not
    taken for properties: what is derived by a subproperty of type is kept as a fact only."""
    spark = abox.sparkSession
    prop, types = abox.where(F.col("p") != v.TYPE), abox.where(F.col("p") == v.TYPE)
    rows = _small(tbox.where(F.col("p").isin(v.SUB_PROPERTY_OF, v.INVERSE_OF, v.TYPE)), limit)
    try:
        inverse = None if rows is None else property_rewrites([r for r in rows if recursive or r[1] != v.INVERSE_OF], symmetric=False, equivalent=False)
    except local.TooLarge:
        rows = inverse = None
    if inverse is not None:
        table = _table(spark, inverse, "p_in long, p_out long, swap boolean")
    else:
        sub = pairs(tbox, v.SUB_PROPERTY_OF, "p_in", "p_out").withColumn("swap", F.lit(False))
        inv = pairs(tbox, v.INVERSE_OF, "p_in", "p_out").withColumn("swap", F.lit(True))
        table = sub.union(inv).union(inv.select("p_out", "p_in", "swap")) if recursive else sub
        table = table.toDF("p_in", "p_out", "swap")
    if recursive:
        transitive = tbox.where(F.col("o") == v.TRANSITIVE).select(F.col("s").alias("p")).distinct()
        some = rows is None or any(o == v.TRANSITIVE for _, _, o in rows) or bool(transitive.limit(1).count())

        def step(new: DataFrame, whole: DataFrame, _: int) -> DataFrame:
            out = rewritten(new, table)
            if some:
                mine = lambda d: d.join(F.broadcast(transitive), "p", "left_semi")
                left = lambda d: mine(d).select("p", F.col("s").alias("a"), F.col("o").alias("m"))
                right = lambda d: mine(d).select("p", F.col("s").alias("m"), F.col("o").alias("b"))
                for a, b in ((new, whole), (whole, new)):
                    out = out.union(left(a).join(right(b), ["p", "m"]).select(F.col("a").alias("s"), "p", F.col("b").alias("o")))
            return out

        props = fixpoint(prop, step)
    else:
        props = union(prop, rewritten(prop, table))
    sides = pairs(tbox, v.DOMAIN, "p_in", "c").withColumn("at_object", F.lit(False)).union(pairs(tbox, v.RANGE, "p_in", "c").withColumn("at_object", F.lit(True)))
    supers = pairs(tbox, v.SUB_CLASS_OF, "c_in", "c_out")
    if tbox.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sides, supers = F.broadcast(sides), F.broadcast(supers)
    typed = union(types, _typed(props, sides)).distinct()
    return union(abox, props, typed, _classed(typed, supers)).distinct()


def _compiled(rules: list[Rule], rows: list[tuple], spark) -> list[tuple[Rule, DataFrame | None]]:
    """Each rule with its schema atoms worked out to one table of their variables; rules
    whose schema part has no match go."""
    out = []
    index = local.indexed(rows)
    for r in rules:
        schema = [t for x, t in r.body if x == "T"]
        if not schema:
            out.append((r, None))
            continue
        outside = [t for x, t in r.body if x != "T"]
        wanted = list(dict.fromkeys(t for a in schema for t in a if isinstance(t, str) and any(t in b for b in [*outside, *r.heads])))
        found = {tuple(b[t] for t in wanted) for b in local.bindings(schema, set(rows), index)}
        if found:
            table = spark.createDataFrame(sorted(found), ", ".join(f"`{t}` long" for t in wanted)) if wanted else None
            out.append((Rule(r.name, (*([("T", tuple(wanted))] if wanted else []), *[(x, t) for x, t in r.body if x != "T"]), r.heads, r.unequal, r.identity), table))
    return out


def owl2rl(tbox: DataFrame, lists: DataFrame, abox: DataFrame, compat: bool = False, limit: int = SCHEMA_ROWS) -> tuple[DataFrame, DataFrame]:
    """Closed facts and identity pairs under a closed schema."""
    spark = abox.sparkSession
    rows = _small(tbox, limit)
    items = {r["head"]: list(r["items"]) for r in lists.limit(limit + 1).collect()}
    if rows is None or len(items) > limit:
        rows = None
    facts = dict(rulesets.fact_rules(compat))
    kinds = (v.FUNCTIONAL, v.INVERSE_FUNCTIONAL)
    if rows is not None:
        heads = lambda p: [(s, items[o]) for s, q, o in rows if q == p and o in items]
        listed = rulesets.list_rules(heads(v.PROPERTY_CHAIN_AXIOM), heads(v.INTERSECTION_OF), compat)
        # rules with one fact in their bodies become lookups in three tables
        single = ("cax-sco", "cax-eqc1", "cax-eqc2", "prp-dom", "prp-rng", "prp-spo1", "prp-eqp1", "prp-eqp2", "prp-inv1", "prp-inv2", "cls-svf2", *(() if compat else ("prp-symp",)))
        try:
            rest = _compiled([r for k, r in (facts | listed).items() if k not in single and not k.startswith("eq-")], rows, spark)
            rewrites = property_rewrites(rows, symmetric=not compat)
        except local.TooLarge:
            rows = None
    constant = triples(spark, [(v.THING, v.TYPE, v.CLASS), (v.NOTHING, v.TYPE, v.CLASS)])
    if rows is not None:
        constant = union(constant, triples(spark, [(x, v.TYPE, c) for c, xs in heads(v.ONE_OF) for x in xs]))
        props = _table(spark, rewrites, "p_in long, p_out long, swap boolean")
        classes = {(s, o) for s, p, o in rows if p in (v.SUB_CLASS_OF, v.EQUIVALENT_CLASS) and s != o} | {(o, s) for s, p, o in rows if p == v.EQUIVALENT_CLASS and s != o}
        sides = {(s, p == v.RANGE, o) for s, p, o in rows if p in (v.DOMAIN, v.RANGE)}
        on = {(s, o) for s, p, o in rows if p == v.ON_PROPERTY}
        things = {s for s, p, o in rows if p == v.SOME_VALUES_FROM and o == v.THING}
        sides |= {(q, False, c) for c, q in on if c in things}
        classes, sides = _table(spark, classes, "c_in long, c_out long"), _table(spark, sides, "p_in long, at_object boolean, c long")

        def made(new: DataFrame, whole: DataFrame) -> DataFrame:
            out = union(rewritten(new, props), _typed(new, sides), _classed(new, classes))
            for r, table in rest:
                more = apply(r, {"A": (new, whole), "T": (None, table)}, "T")
                out = out.unionByName(more)
            return out

        keyed = [_table(spark, {(s,) for s, p, o in rows if o == kind and (compat or p == v.TYPE)}, "p long") for kind in kinds]
        edges = spark.createDataFrame([(s, o) for s, p, o in rows if p == v.SAME_AS], "a long, b long")
    else:
        unrolled = ls.unrolled(lists)
        constant = union(constant, pairs(tbox, v.ONE_OF, "c", "head").join(unrolled, "head").select(F.col("item").alias("s"), F.lit(v.TYPE).cast("long").alias("p"), F.col("c").alias("o")))
        plain = [r for k, r in facts.items() if not k.startswith("eq-")]

        def made(new: DataFrame, whole: DataFrame) -> DataFrame:
            out = apply_all(plain, {"A": (new, whole), "T": (None, tbox)})
            return union(out, _intersections(tbox, lists, whole, compat), _chains(tbox, lists, whole))

        said = tbox if compat else tbox.where(F.col("p") == v.TYPE)
        keyed = [said.where(F.col("o") == kind).select(F.col("s").alias("p")).distinct() for kind in kinds]
        edges = pairs(tbox, v.SAME_AS, "a", "b")
    step = lambda new, all_, _: made(new, all_)
    whole = derived = fixpoint(union(abox, constant), step)
    fresh, same, size = whole.limit(0), None, None
    while True:
        grown = derived.unionByName(fresh)
        merged = False
        # identity is looked for again only where functional properties have new facts
        if same is None or any(grown.join(p, "p", "left_semi").limit(1).count() for p in keyed):
            for x in stars(whole, *keyed):
                edges = edges.union(x.select("a", "b"))
            edges = cut(edges.distinct())
            if not edges.limit(1).count():
                break
            same = cut(components(edges))
            # classes only grow together: as many of them over as many nodes are the same
            now = tuple(same.agg(F.count("*"), F.countDistinct("component")).first())
            merged, size = now != size, now
        # what replacement made is closed under it while the classes stay
        fresh = cut(replaced(whole if merged else derived, same).join(unsent(whole), list(COLS), "left_anti"))
        if not fresh.limit(1).count():
            break
        whole = whole.unionByName(fresh)
        derived = fixpoint(made(fresh, whole), step, known=whole, only_new=True)
        whole = whole.unionByName(derived)
    return whole, spark.createDataFrame([], "a long, b long") if same is None else class_pairs(same)


def replaced(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """The facts that eq-rep-s, eq-rep-p and eq-rep-o make of ``facts`` in the end, those with a
    member of the classes (node, component) somewhere: members are named by their class, and what is then distinct
    is spread over all members once, so that nothing is made twice."""
    held = classes.limit(REPLACED_ROWS + 1).count() <= REPLACED_ROWS
    near = lambda df, few: F.broadcast(df) if few else df.hint("merge")
    used = facts.select(F.col("p").alias("node")).distinct()
    at = {"s": near(classes, held), "o": near(classes, held)}
    p = cut(classes.join(used, "node", "left_semi"))  # few if any properties have a class
    if (n := p.limit(REPLACED_ROWS + 1).count()) > 0:
        at["p"] = near(p, n <= REPLACED_ROWS)
    out = facts.select(*COLS)
    for c, of in at.items():
        out = out.join(of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class")), c, "left")
    named = [F.coalesce(f"{c}_class", c).alias(c) if c in at else F.col(c) for c in COLS]
    out = out.where(" or ".join(f"{c}_class is not null" for c in at)).select(*named).distinct()
    for c in at:
        members = classes.select(F.col("component").alias(c), F.col("node").alias(f"{c}_node"))
        out = out.join(near(members, held), c, "left").withColumn(c, F.coalesce(f"{c}_node", c)).drop(f"{c}_node")
    return out.select(*COLS)


def stars(facts: DataFrame, functional: DataFrame, inverse: DataFrame, salts: int = 64) -> list[DataFrame]:
    """Edges (a, b) that connect what prp-fp and prp-ifp make the same: of a key's members
    each is tied to the least of its salt, and these to the least of all, so a key of m
    members gives at most m - 1 edges, and none of its steps has a key in one task."""
    out = []
    for properties, key, member in ((functional, "s", "o"), (inverse, "o", "s")):
        of = facts.join(properties, "p", "left_semi").select("p", F.col(key).alias("k"), F.col(member).alias("a"))
        of = of.withColumn("salt", F.pmod(F.hash("a"), F.lit(salts)))
        some = of.groupBy("p", "k", "salt").agg(F.min("a").alias("b"))
        out.append(of.join(some, ["p", "k", "salt"]).where("a <> b").select("a", "b"))
        least = some.groupBy("p", "k").agg(F.min("b").alias("c"))
        out.append(some.join(least, ["p", "k"]).where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b")))
    return out


def _intersections(tbox: DataFrame, lists: DataFrame, facts: DataFrame, compat: bool) -> DataFrame:
    """cls-int1 as a division: members of all classes of a list."""
    wanted = pairs(tbox, v.INTERSECTION_OF, "c", "head").join(lists, "head").select("c", F.array_distinct("items").alias("items"))
    if compat:
        wanted = wanted.where(F.size("items") == 1)
    wanted = wanted.select("c", F.size("items").alias("n"), F.explode("items").alias("o"))
    has = facts.where(F.col("p") == v.TYPE).select("s", "o").distinct().join(wanted, "o")
    return has.groupBy("c", "n", "s").agg(F.count("*").alias("k")).where("k = n").select("s", F.lit(v.TYPE).cast("long").alias("p"), F.col("c").alias("o"))


def _chains(tbox: DataFrame, lists: DataFrame, facts: DataFrame) -> DataFrame:
    """prp-spo2, one position after the other for all chains together."""
    steps = pairs(tbox, v.PROPERTY_CHAIN_AXIOM, "q", "head").join(lists, "head").select("q", "head", F.size("items").alias("n"), F.posexplode("items").alias("pos", "p"))
    longest = steps.agg(F.max("n")).first()[0] or 0
    prop = facts.where(F.col("p") != v.TYPE)
    walk = steps.where("pos = 0").join(prop, "p").select("q", "head", "n", F.col("s").alias("a"), F.col("o").alias("m"))
    out = walk.where("n = 1")
    for i in range(1, longest):
        at = steps.where(F.col("pos") == i).select("q", "head", "p")
        walk = walk.join(at, ["q", "head"]).join(prop.select("p", F.col("s").alias("m"), F.col("o").alias("b")), ["p", "m"]).select("q", "head", "n", "a", F.col("b").alias("m"))
        out = out.union(walk.where(F.col("n") == i + 1))
    return out.select(F.col("a").alias("s"), F.col("q").alias("p"), F.col("m").alias("o"))


def materialize(tbox: DataFrame, abox: DataFrame, profile: str = "rdfspp", compat: bool = False, limit: int = SCHEMA_ROWS) -> Materialized:
    """The closure of (tbox, abox) under a profile; rows are distinct facts."""
    profile = profile_of(profile)
    none = abox.sparkSession.createDataFrame([], "a long, b long")
    closed, lists = close_schema(tbox, profile, compat, limit)
    if profile == "dummy":
        return Materialized(closed, lists, distinct(abox), none)
    closed = cut(closed)
    if profile == "owl2rl":
        facts, same = owl2rl(closed, lists, abox, compat, limit)
        return Materialized(closed, lists, facts.distinct(), same)
    return Materialized(closed, lists, rdfs(closed, abox, profile == "rdfspp", limit), none)


__all__ = ["Materialized", "TRIPLE", "close_schema", "materialize", "owl2rl", "profile_of", "property_rewrites", "rdfs", "stars"]
