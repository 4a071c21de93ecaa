"""Every registered query of the rule engine, with its SQL.

Queries take (spark, sf_dir) and return whole results; the SQL gives the same rows from
the same tables.  Rule queries apply one rule once; profile queries go to the fixpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from . import graph as g
from .functions import vocab as v
from .operators import fixpoint as fx, lists as ls, primitives as pr
from .operators.lineage import SENT_ROWS, cut, shared_dir, unsent
from .plans import rulesets
from .plans.profiles import close_schema, materialize
from .plans.rules import Rule, apply
from .sources import triples as src
from .streaming.feed import materialize_stream
from .streaming.incremental import Incremental

TYPE = v.TYPE

#: Schema of the rule queries: every rule has something to do.
SCHEMA = [
    (g.IN_NATION, v.SUB_PROPERTY_OF, g.LOCATED_IN), (g.IN_REGION, v.SUB_PROPERTY_OF, g.LOCATED_IN), (g.LOCATED_IN, TYPE, v.TRANSITIVE), (g.IN_REGION, TYPE, v.TRANSITIVE),
    (g.PLACED, v.INVERSE_OF, g.PLACED_BY), (g.PLACED_BY, v.EQUIVALENT_PROPERTY, g.ORDERED_BY), (g.PLACED_BY, TYPE, v.FUNCTIONAL), (g.CONTENT_KEY, TYPE, v.INVERSE_FUNCTIONAL),
    (g.IN_NATION, TYPE, v.SYMMETRIC), (g.PLACED_BY, v.DOMAIN, g.ORDER), (g.PLACED_BY, v.RANGE, g.CUSTOMER), (g.LOCATED_IN, v.DOMAIN, g.LOCATED), (g.LOCATED_IN, v.RANGE, g.PLACE),
    (g.IN_NATION, v.DOMAIN, g.LOCATED), (g.IN_NATION, v.RANGE, g.PLACE), (g.CUSTOMER, v.SUB_CLASS_OF, g.AGENT), (g.AGENT, v.SUB_CLASS_OF, 2020), (2020, v.SUB_CLASS_OF, 2021), (2021, v.SUB_CLASS_OF, 2020),
    (g.SEGMENT, v.SUB_CLASS_OF, g.CUSTOMER), (g.SEGMENT + 1, v.SUB_CLASS_OF, g.CUSTOMER), (g.SEGMENT + 2, v.EQUIVALENT_CLASS, 2030), (2031, v.EQUIVALENT_CLASS, g.SEGMENT + 3),
    (g.CUSTOMER, TYPE, v.CLASS), (g.AGENT, TYPE, v.CLASS), (g.PLACED_BY, TYPE, v.OBJECT_PROPERTY), (1020, v.SUB_PROPERTY_OF, 1021), (1021, v.SUB_PROPERTY_OF, 1020), (1021, v.SUB_PROPERTY_OF, g.PLACED_BY),
    (2040, v.SOME_VALUES_FROM, g.SEGMENT), (2040, v.ON_PROPERTY, g.PLACED_BY), (2041, v.SOME_VALUES_FROM, g.CUSTOMER), (2041, v.ON_PROPERTY, g.PLACED_BY), (2042, v.SOME_VALUES_FROM, v.THING), (2042, v.ON_PROPERTY, g.IN_REGION),
    (2043, v.SOME_VALUES_FROM, g.SEGMENT), (2043, v.ON_PROPERTY, 1021), (2044, v.ALL_VALUES_FROM, g.SEGMENT), (2044, v.ON_PROPERTY, g.IN_NATION), (2045, v.ALL_VALUES_FROM, g.CUSTOMER), (2045, v.ON_PROPERTY, g.IN_NATION),
    (2046, v.ALL_VALUES_FROM, g.SEGMENT), (2046, v.ON_PROPERTY, g.LOCATED_IN), (2047, v.HAS_VALUE, 2105), (2047, v.ON_PROPERTY, g.HAS_PRIORITY), (2048, v.HAS_VALUE, 2105), (2048, v.ON_PROPERTY, 1022),
    (g.HAS_PRIORITY, v.SUB_PROPERTY_OF, 1022), (g.SEGMENT + 4, v.ALL_VALUES_FROM, 2049), (g.SEGMENT + 4, v.ON_PROPERTY, g.IN_NATION), (g.SEGMENT + 1, v.HAS_VALUE, 2105), (g.SEGMENT + 1, v.ON_PROPERTY, g.HAS_PRIORITY),
    (g.ORDER, v.SUB_CLASS_OF, 2022), (g.PRECEDED_BY, TYPE, v.TRANSITIVE), (1023, v.EQUIVALENT_PROPERTY, g.IN_NATION), (g.IN_REGION, v.INVERSE_OF, 1024), (g.SUPPLIED_BY, TYPE, v.FUNCTIONAL),
]

#: Cells of lists: head 3001 = [PLACED_BY, IN_NATION], 3011 = [SEGMENT + 1, LOCATED], 3021 = three.
LISTS = [
    (3001, v.FIRST, g.PLACED_BY), (3001, v.REST, 3002), (3002, v.FIRST, g.IN_NATION), (3002, v.REST, v.NIL), (3011, v.FIRST, g.SEGMENT + 1), (3011, v.REST, 3012), (3012, v.FIRST, g.LOCATED), (3012, v.REST, v.NIL),
    (3021, v.FIRST, g.BASE["customer"] + 1), (3021, v.REST, 3022), (3022, v.FIRST, g.BASE["customer"] + 2), (3022, v.REST, 3023), (3023, v.FIRST, g.BASE["customer"] + 3), (3023, v.REST, v.NIL),
    (g.BUYS_FROM, v.PROPERTY_CHAIN_AXIOM, 3001), (2050, v.INTERSECTION_OF, 3011), (2051, v.UNION_OF, 3011), (2052, v.ONE_OF, 3021),
]

#: What the deviating readings of the schema rules need to have something to do.
COMPAT = [
    (v.OBJECT_PROPERTY, TYPE, v.CLASS), (2061, v.SUB_CLASS_OF, 2062), (2060, v.SOME_VALUES_FROM, 2061), (2060, v.ON_PROPERTY, 1030), (2062, v.SOME_VALUES_FROM, 2063), (2063, v.ON_PROPERTY, 1030),
    (2064, v.SOME_VALUES_FROM, 2065), (2064, v.ON_PROPERTY, 1020), (2065, v.SOME_VALUES_FROM, 2066), (2066, v.ON_PROPERTY, 1021), (2067, v.ALL_VALUES_FROM, 2061), (2067, v.ON_PROPERTY, 1031), (2062, v.ALL_VALUES_FROM, 2068),
    (2068, v.ON_PROPERTY, 1031), (2069, v.ALL_VALUES_FROM, 2070), (2069, v.ON_PROPERTY, 1020), (2070, v.ALL_VALUES_FROM, 2071), (2071, v.ON_PROPERTY, 1021),
]

ALL_FACTS = ("in_nation", "in_region", "placed_by", "segment", "priority")
E_SQL = f"SELECT x.s AS a, y.s AS b FROM (SELECT s, o FROM ({g.SQL['content_key']})) x JOIN (SELECT s, o FROM ({g.SQL['content_key']})) y ON x.o = y.o WHERE x.o IN (SELECT o FROM ({g.SQL['content_key']}) GROUP BY o HAVING count(*) > 1)"


def rule_sql(r: Rule, schema: str, facts: str, identical: str = "SELECT 0 AS a, 0 AS b") -> str:
    """A rule as a join in SQL over the tables t, a and e."""
    where, at, tables = [], {}, []
    for i, (source, terms) in enumerate(r.body):
        tables.append(f"{source.lower()} AS x{i}")
        for c, t in zip("spo" if len(terms) == 3 else "ab", terms, strict=True):
            if isinstance(t, int):
                where.append(f"x{i}.{c} = {t}")
            elif t in at:
                where.append(f"x{i}.{c} = {at[t]}")
            else:
                at[t] = f"x{i}.{c}"
    where += [f"{at[a]} <> {at[b]}" for a, b in r.unequal]
    cols = "spo" if len(r.heads[0]) == 3 else "ab"
    value = lambda t: str(t) if isinstance(t, int) else at[t]
    heads = [", ".join(f"CAST({value(t)} AS BIGINT) AS {c}" for c, t in zip(cols, h, strict=True)) for h in r.heads]
    body = f"FROM {', '.join(tables)}" + (f" WHERE {' AND '.join(where)}" if where else "")
    return f"WITH t AS ({schema}), a AS ({facts}), e AS ({identical}) " + " UNION ".join(f"SELECT DISTINCT {h} {body}" for h in heads)


_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def rule_query(name: str, r: Rule, names: tuple[str, ...] = ALL_FACTS, schema: list[tuple] = SCHEMA) -> None:
    def run(spark, sf_dir):
        t, a = g.axioms(spark, schema), g.graph(spark, sf_dir, *names)
        sources = {"T": (None, t), "A": (None, a)}
        if any(x == "E" for x, _ in r.body):
            sources["E"] = (None, same_as(spark, sf_dir))
        # the schema of these queries is a constant of some fifty rows
        return _paired(r, sources, a) if r.name in ("prp-fp", "prp-ifp", "prp-trp") else apply(r, sources, ("T",)).distinct()

    run.__name__ = name
    _queries[name] = run
    _sql[name] = rule_sql(r, g.values_sql(schema), g.graph_sql(*names), E_SQL)


FACTS_A_TASK = 50_000


def _paired(r: Rule, sources: dict, facts: DataFrame) -> DataFrame:
    """A rule that puts two facts together, in as many parts as the written facts call for.  In a chain
    the second fact's subject is some fact's object; if those facts are few, they are broadcast, and an
    object that most facts have is in no task of its own."""
    facts = cut(facts)
    parts = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts.cut_rows // FACTS_A_TASK))
    one, two = (t for x, t in r.body if x == "A")
    if one[2] == two[0]:
        seconds = cut(facts.join(unsent(facts.select(F.col("o").alias("s")).distinct(), facts), "s", "left_semi").select("s", "p", "o"))
        few = ("B",) if seconds.cut_rows <= SENT_ROWS else ()
        last = max(i for i, (x, _) in enumerate(r.body) if x == "A")
        r = replace(r, body=tuple(("B" if i == last else x, t) for i, (x, t) in enumerate(r.body)))
        out = apply(r, sources | {"A": (None, facts.repartition(parts) if few else facts), "B": (None, seconds)}, ("T", *few))
    else:
        out = apply(r, sources | {"A": (None, facts.repartition(parts, "p", "s" if one[0] == two[0] else "o"))}, ("T",))
    return out.repartition(parts, *out.columns).distinct()


def same_as(spark, sf_dir: str) -> DataFrame:
    """Documents of equal content, as identity pairs (members of classes of two up)."""
    k = g.edges(spark, sf_dir, "content_key")
    low = k.groupBy("o").agg(F.min("s").alias("a"), F.count("*").alias("n")).where("n > 1")
    return fx.same_as_pairs(k.join(low, "o").select(F.col("s").alias("a"), F.col("a").alias("b")).where("a <> b"))


# -- primitives ---------------------------------------------------------------


@register("scan_triples", g.graph_sql("in_nation", "in_region"))
def scan_triples(spark, sf_dir):
    return g.graph(spark, sf_dir, "in_nation", "in_region")


@register("filter_predicate", f"SELECT * FROM ({g.graph_sql('in_nation', 'in_region')}) WHERE p = {g.IN_REGION}")
def filter_predicate(spark, sf_dir):
    return pr.where_predicate(g.graph(spark, sf_dir, "in_nation", "in_region"), g.IN_REGION)


@register("project_swap", f"SELECT o AS s, CAST({g.PLACED} AS BIGINT) AS p, s AS o FROM ({g.graph_sql('placed_by')})")
def project_swap(spark, sf_dir):
    return pr.swapped(g.edges(spark, sf_dir, "placed_by"), g.PLACED)


@register("union_graphs", g.graph_sql("in_nation", "placed_by", "in_nation"))
def union_graphs(spark, sf_dir):
    return pr.union(*[g.edges(spark, sf_dir, n) for n in ("in_nation", "placed_by", "in_nation")])


@register("distinct_triples", f"SELECT DISTINCT * FROM ({g.graph_sql('in_nation', 'placed_by', 'in_nation')})")
def distinct_triples(spark, sf_dir):
    return pr.distinct(union_graphs(spark, sf_dir))


_SIGNED = f"SELECT *, 1 AS diff FROM ({g.graph_sql('placed_by', 'placed_by')}) UNION ALL SELECT *, -1 FROM ({g.graph_sql('placed_by')}) UNION ALL SELECT *, -1 FROM ({g.graph_sql('placed_by')}) WHERE s % 2 = 0 UNION ALL SELECT *, -1 FROM ({g.graph_sql('in_region')}) UNION ALL SELECT *, 1 FROM ({g.graph_sql('in_region')})"


@register("consolidate_signed", f"SELECT s, p, o, CAST(sum(diff) AS INTEGER) AS diff FROM ({_SIGNED}) GROUP BY s, p, o HAVING sum(diff) <> 0")
def consolidate_signed(spark, sf_dir):
    """Added twice, taken out once (twice for even subjects); taken out before added."""
    a, r = g.edges(spark, sf_dir, "placed_by"), g.edges(spark, sf_dir, "in_region")
    plus = lambda df, d=1: df.withColumn("diff", F.lit(d))
    return pr.consolidated(plus(a).union(plus(a)).union(pr.negated(plus(a))).union(plus(a.where("s % 2 = 0"), -1)).union(plus(r, -1)).union(plus(r)))


@register("semi_join", f"WITH a AS ({g.graph_sql('placed_by')}), b AS ({g.graph_sql('segment')}) SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.s = a.o AND b.o = {g.SEGMENT})")
def semi_join(spark, sf_dir):
    b = g.edges(spark, sf_dir, "segment").where(F.col("o") == g.SEGMENT).select(F.col("s").alias("o"))
    return pr.semi(g.edges(spark, sf_dir, "placed_by"), b, ["o"]).select("s", "p", "o")


@register("anti_join", f"WITH a AS ({g.graph_sql('in_nation')}), b AS ({g.graph_sql('placed_by')}) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o = a.s)")
def anti_join(spark, sf_dir):
    b = g.edges(spark, sf_dir, "placed_by").select(F.col("o").alias("s"))
    return pr.anti(g.edges(spark, sf_dir, "in_nation"), b, ["s"]).select("s", "p", "o")


@register("composite_join", f"WITH a AS ({g.graph_sql('supplied_by')}), b AS ({g.graph_sql('in_nation')}), c AS ({g.graph_sql('placed_by')}) SELECT DISTINCT a.s, CAST(1030 AS BIGINT) AS p, x.o FROM a JOIN b x ON a.o = x.s JOIN c ON a.s = c.s JOIN b y ON c.o = y.s AND y.o = x.o")
def composite_join(spark, sf_dir):
    """Orders that are supplied from the customer's own nation: joined on (order, nation)."""
    nation = g.edges(spark, sf_dir, "in_nation").select(F.col("s").alias("who"), F.col("o").alias("nation"))
    of = lambda n: g.edges(spark, sf_dir, n).select(F.col("s").alias("order"), F.col("o").alias("who")).join(nation, "who").select("order", "nation")
    return of("supplied_by").join(of("placed_by"), ["order", "nation"]).select(F.col("order").alias("s"), F.lit(1030).cast("long").alias("p"), F.col("nation").alias("o")).distinct()


# -- one rule each --------------------------------------------------------------

for _name, _rule in rulesets.schema_rules().items():
    rule_query(_name.replace("-", "_"), _rule, ("in_region",))
for _name, _rule in rulesets.fact_rules().items():
    if not _name.startswith("eq-"):
        rule_query(_name.replace("-", "_"), _rule, ("preceded_by",) if _name == "prp-trp" else ALL_FACTS)
for _name, _rule in rulesets.fact_rules(True).items():
    if _rule != rulesets.fact_rules()[_name]:
        rule_query(_name.replace("-", "_") + "_compat", _rule, ("segment", "segment_kind") if _name == "prp-trp" else ALL_FACTS)
for _name, _rule in rulesets.schema_rules(True).items():
    if _rule != rulesets.schema_rules()[_name]:
        rule_query(_name.replace("-", "_") + "_compat", _rule, ("in_region",), SCHEMA + COMPAT)
rule_query("prp_fp", rulesets.identity_rules()["prp-fp"], ("supplied_by",))
rule_query("prp_fp_compat", rulesets.identity_rules(True)["prp-fp"], ("supplied_by",))
rule_query("prp_ifp_compat", rulesets.identity_rules(True)["prp-ifp"], ("content_key",))
rule_query("prp_ifp", rulesets.identity_rules()["prp-ifp"], ("content_key",))
for _name, _from in (("eq-rep-s", "content_key"), ("eq-rep-o", "content_of"), ("eq-rep-p", "by_document")):
    rule_query(_name.replace("-", "_"), rulesets.fact_rules()[_name], (_from,))
rule_query("rdfs7_subproperty", rulesets.RDFS_FACTS["rdfs7"])
rule_query("rdfs_domain", rulesets.RDFS_FACTS["rdfs2"])
rule_query("rdfs_range", rulesets.RDFS_FACTS["rdfs3"])
rule_query("rdfs9_type", rulesets.RDFS_FACTS["rdfs9"])


@register("eq_trans", f"SELECT a, b FROM ({E_SQL})")
def eq_trans(spark, sf_dir):
    return same_as(spark, sf_dir)


@register("eq_sym", f"SELECT b AS a, a AS b FROM ({E_SQL})")
def eq_sym(spark, sf_dir):
    e = same_as(spark, sf_dir)
    return e.select(F.col("b").alias("a"), F.col("a").alias("b"))


@register("same_as_classes", f"SELECT b AS node, min(a) AS component FROM ({E_SQL}) GROUP BY b")
def same_as_classes(spark, sf_dir):
    k = g.edges(spark, sf_dir, "content_key")
    low = k.groupBy("o").agg(F.min("s").alias("a"), F.count("*").alias("n")).where("n > 1")
    return fx.components(k.join(low, "o").select(F.col("s").alias("a"), F.col("a").alias("b")).where("a <> b"))


@register("cls_thing_nothing", g.values_sql([(v.THING, TYPE, v.CLASS), (v.NOTHING, TYPE, v.CLASS)]))
def cls_thing_nothing(spark, sf_dir):
    return pr.triples(spark, [(v.THING, TYPE, v.CLASS), (v.NOTHING, TYPE, v.CLASS)])


# -- lists ------------------------------------------------------------------------

_CELLS = f"WITH RECURSIVE t AS ({g.values_sql(LISTS)}), c AS (SELECT f.s AS cell, f.o AS item, r.o AS tail FROM t f JOIN t r ON f.s = r.s WHERE f.p = {v.FIRST} AND r.p = {v.REST}), w AS (SELECT cell AS head, CAST(0 AS BIGINT) AS pos, item, tail FROM c WHERE cell NOT IN (SELECT tail FROM c) UNION ALL SELECT w.head, w.pos + 1, c.item, c.tail FROM w JOIN c ON w.tail = c.cell)"


@register("list_unroll", f"{_CELLS} SELECT head, pos, item FROM w")
def list_unroll(spark, sf_dir):
    return ls.unrolled(ls.expanded(g.axioms(spark, LISTS)))


@register("list_expand", f"{_CELLS} SELECT head, CAST(count(*) AS BIGINT) AS length, string_agg(CAST(item AS VARCHAR), ',' ORDER BY pos) AS items FROM w GROUP BY head")
def list_expand(spark, sf_dir):
    return ls.expanded(g.axioms(spark, LISTS)).select("head", F.size("items").cast("long").alias("length"), F.array_join("items", ",").alias("items"))


@register("list_last_position", f"{_CELLS} SELECT head, max(pos) AS last FROM w GROUP BY head")
def list_last_position(spark, sf_dir):
    return ls.last_position(ls.expanded(g.axioms(spark, LISTS)))


@register("scm_int", f"{_CELLS} SELECT t.s AS s, CAST(0 AS BIGINT) AS p, w.item AS o FROM t JOIN w ON t.o = w.head WHERE t.p = {v.INTERSECTION_OF}")
def scm_int(spark, sf_dir):
    from .plans.profiles import list_axioms

    t = g.axioms(spark, [r for r in LISTS if r[1] != v.UNION_OF])
    return list_axioms(t, ls.expanded(t))


@register("scm_uni", f"{_CELLS} SELECT w.item AS s, CAST(0 AS BIGINT) AS p, t.s AS o FROM t JOIN w ON t.o = w.head WHERE t.p = {v.UNION_OF}")
def scm_uni(spark, sf_dir):
    from .plans.profiles import list_axioms

    t = g.axioms(spark, [r for r in LISTS if r[1] != v.INTERSECTION_OF])
    return list_axioms(t, ls.expanded(t))


def _list_rule(spark, sf_dir, key: str, names) -> DataFrame:
    made = rulesets.list_rules([(g.BUYS_FROM, [g.PLACED_BY, g.IN_NATION])], [(2050, [g.SEGMENT + 1, g.LOCATED])])
    facts = g.graph(spark, sf_dir, *names)
    typed = pr.union(facts, facts.where(F.col("p") == g.IN_NATION).select("s", F.lit(TYPE).cast("long").alias("p"), F.lit(g.LOCATED).cast("long").alias("o")))
    return apply(made[key], {"A": (None, typed)}).distinct()


@register("prp_spo2_chain", f"WITH a AS ({g.graph_sql('placed_by')}), b AS ({g.graph_sql('in_nation')}) SELECT DISTINCT a.s, CAST({g.BUYS_FROM} AS BIGINT) AS p, b.o FROM a JOIN b ON a.o = b.s")
def prp_spo2_chain(spark, sf_dir):
    return _list_rule(spark, sf_dir, "prp-spo2-0", ("placed_by", "in_nation"))


@register("cls_int1", f"SELECT s, CAST({TYPE} AS BIGINT) AS p, CAST(2050 AS BIGINT) AS o FROM (SELECT s FROM ({g.graph_sql('segment')}) WHERE o = {g.SEGMENT + 1} INTERSECT SELECT s FROM ({g.graph_sql('in_nation')}))")
def cls_int1(spark, sf_dir):
    return _list_rule(spark, sf_dir, "cls-int1-0", ("segment", "in_nation"))


@register("cls_oo", g.values_sql([(g.BASE["customer"] + i, TYPE, 2052) for i in (1, 2, 3)]))
def cls_oo(spark, sf_dir):
    t = g.axioms(spark, LISTS)
    items = ls.unrolled(ls.expanded(t))
    return pr.pairs(t, v.ONE_OF, "c", "head").join(items, "head").select(F.col("item").alias("s"), F.lit(TYPE).cast("long").alias("p"), F.col("c").alias("o")).distinct()


# -- closures -----------------------------------------------------------------------


def _closed_sql(p: int) -> str:
    return f"WITH RECURSIVE t AS ({g.values_sql(SCHEMA)}), e AS (SELECT s, o FROM t WHERE p = {p}), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT DISTINCT s, CAST({p} AS BIGINT) AS p, o FROM c"


@register("rdfs_sco_closure", _closed_sql(v.SUB_CLASS_OF))
def rdfs_sco_closure(spark, sf_dir):
    return close_schema(g.axioms(spark, SCHEMA), "rdfs")[0].where(F.col("p") == v.SUB_CLASS_OF)


@register("rdfs_spo_closure", _closed_sql(v.SUB_PROPERTY_OF))
def rdfs_spo_closure(spark, sf_dir):
    """By the distributed doubling closure."""
    c = fx.closure(pr.pairs(g.axioms(spark, SCHEMA), v.SUB_PROPERTY_OF, "a", "b"))
    return c.select(F.col("a").alias("s"), F.lit(v.SUB_PROPERTY_OF).cast("long").alias("p"), F.col("b").alias("o"))


_RANKED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders"


@register("order_history_closure", f"WITH r AS ({_RANKED}) SELECT CAST({g.BASE['order']} + x.o_orderkey AS BIGINT) AS s, CAST({g.PRECEDED_BY} AS BIGINT) AS p, CAST({g.BASE['order']} + y.o_orderkey AS BIGINT) AS o FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.i > y.i")
def order_history_closure(spark, sf_dir):
    """All earlier orders of the same customer: a transitive property over chains."""
    props = spark.createDataFrame([(g.PRECEDED_BY,)], "p long")
    return fx.transitive_facts(g.edges(spark, sf_dir, "preceded_by"), props)


#: The schema of the profile queries.
PROFILE_SCHEMA = [
    (g.IN_NATION, v.SUB_PROPERTY_OF, g.LOCATED_IN), (g.IN_REGION, v.SUB_PROPERTY_OF, g.LOCATED_IN), (g.LOCATED_IN, TYPE, v.TRANSITIVE), (g.PLACED, v.INVERSE_OF, g.PLACED_BY),
    (g.PLACED_BY, v.DOMAIN, g.ORDER), (g.PLACED_BY, v.RANGE, g.CUSTOMER), (g.LOCATED_IN, v.RANGE, g.PLACE), (g.CUSTOMER, v.SUB_CLASS_OF, g.AGENT), (g.AGENT, v.SUB_CLASS_OF, 2020),
]
_FACTS = ("in_nation", "in_region", "placed_by", "segment")
_LOCATED = f"SELECT s, CAST({g.LOCATED_IN} AS BIGINT) AS p, o FROM ({g.graph_sql('in_nation', 'in_region')})"
_TWO = f"SELECT x.s, CAST({g.LOCATED_IN} AS BIGINT) AS p, y.o FROM ({g.graph_sql('in_nation')}) x JOIN ({g.graph_sql('in_region')}) y ON x.o = y.s"
_PLACED = f"SELECT o AS s, CAST({g.PLACED} AS BIGINT) AS p, s AS o FROM ({g.graph_sql('placed_by')})"
_TYPED = lambda sql, col, *cs: " UNION ".join(f"SELECT {col} AS s, CAST({TYPE} AS BIGINT) AS p, CAST({c} AS BIGINT) AS o FROM ({sql})" for c in cs)
_BASE_TYPES = _TYPED(g.graph_sql("placed_by"), "s", g.ORDER) + " UNION " + _TYPED(g.graph_sql("placed_by"), "o", g.CUSTOMER, g.AGENT, 2020)
_RDFS_FULL = f"SELECT * FROM ({g.graph_sql(*_FACTS)}) UNION {_LOCATED} UNION {_BASE_TYPES} UNION {_TYPED(_LOCATED, 'o', g.PLACE)}"
_PP_FULL = f"{_RDFS_FULL} UNION {_TWO} UNION {_PLACED}"


@register("rdfs_full", _RDFS_FULL)
def rdfs_full(spark, sf_dir):
    return materialize(g.axioms(spark, PROFILE_SCHEMA), g.graph(spark, sf_dir, *_FACTS), "rdfs").abox


@register("rdfspp_full", _PP_FULL)
def rdfspp_full(spark, sf_dir):
    return materialize(g.axioms(spark, PROFILE_SCHEMA), g.graph(spark, sf_dir, *_FACTS), "rdfspp").abox


@register("rdfspp_inverse", _PLACED)
def rdfspp_inverse(spark, sf_dir):
    t = g.axioms(spark, [(g.PLACED, v.INVERSE_OF, g.PLACED_BY)])
    return pr.where_predicate(materialize(t, g.edges(spark, sf_dir, "placed_by"), "rdfspp").abox, g.PLACED)


@register("rdfspp_transitive_located_in", f"{_LOCATED} UNION {_TWO}")
def rdfspp_transitive_located_in(spark, sf_dir):
    return pr.where_predicate(materialize(g.axioms(spark, PROFILE_SCHEMA), g.graph(spark, sf_dir, "in_nation", "in_region"), "rdfspp").abox, g.LOCATED_IN)


@register("dummy_echo", f"SELECT DISTINCT * FROM ({g.graph_sql('in_nation', 'in_nation')})")
def dummy_echo(spark, sf_dir):
    return materialize(g.axioms(spark, PROFILE_SCHEMA), g.graph(spark, sf_dir, "in_nation", "in_nation"), "none such").abox


_OWL_SCHEMA = [*PROFILE_SCHEMA, *[r for r in LISTS if r[1] != v.UNION_OF], (g.IN_NATION, v.DOMAIN, g.LOCATED), (2047, v.HAS_VALUE, 2105), (2047, v.ON_PROPERTY, g.HAS_PRIORITY), (g.CONTENT_KEY, TYPE, v.INVERSE_FUNCTIONAL)]
_OWL_FACTS = (*_FACTS, "priority", "content_key")
_CHAIN = _sql["prp_spo2_chain"]
_INT = _sql["cls_int1"]
_OWL_FULL = (
    f"SELECT * FROM ({_PP_FULL}) UNION SELECT * FROM ({g.graph_sql('priority')}) UNION SELECT * FROM ({_CHAIN}) UNION SELECT * FROM ({_INT}) UNION {_TYPED(g.graph_sql('in_nation'), 's', g.LOCATED)}"
    f" UNION SELECT s, CAST({TYPE} AS BIGINT) AS p, CAST(2047 AS BIGINT) AS o FROM ({g.graph_sql('priority')}) WHERE o = 2105"
    f" UNION {g.values_sql([(v.THING, TYPE, v.CLASS), (v.NOTHING, TYPE, v.CLASS)])} UNION {g.values_sql([(g.BASE['customer'] + i, TYPE, 2052) for i in (1, 2, 3)])}"
    f" UNION SELECT * FROM ({g.graph_sql('content_key')})"
)


@register("owl2rl_full", _OWL_FULL)
def owl2rl_full(spark, sf_dir):
    """Chains, intersections, enumerations, values and identity beside the RDFS++ rules.
    Documents of equal content are found identical; their facts already agree."""
    return materialize(g.axioms(spark, _OWL_SCHEMA), g.graph(spark, sf_dir, *_OWL_FACTS), "owl2rl").abox


@register("owl2rl_same_as", E_SQL)
def owl2rl_same_as(spark, sf_dir):
    return materialize(g.axioms(spark, [(g.CONTENT_KEY, TYPE, v.INVERSE_FUNCTIONAL)]), g.edges(spark, sf_dir, "content_key"), "owl2rl").same_as


# -- incremental ------------------------------------------------------------------


def _half(spark, sf_dir: str, odd: int) -> DataFrame:
    return g.edges(spark, sf_dir, "in_nation").where(F.col("s") % 2 == odd)


def _state(spark, sf_dir: str) -> Incremental:
    state = Incremental("rdfspp")
    plus = lambda df, d=1: df.withColumn("diff", F.lit(d))
    state.apply(plus(g.axioms(spark, PROFILE_SCHEMA)), plus(_half(spark, sf_dir, 0).union(g.edges(spark, sf_dir, "in_region"))))
    return state


def _closure_sql(where: str) -> str:
    n = f"SELECT * FROM ({g.graph_sql('in_nation')}) WHERE {where}"
    r = g.graph_sql("in_region")
    loc = f"SELECT s, CAST({g.LOCATED_IN} AS BIGINT) AS p, o FROM ({n} UNION ALL {r})"
    two = f"SELECT x.s, CAST({g.LOCATED_IN} AS BIGINT) AS p, y.o FROM ({n}) x JOIN ({r}) y ON x.o = y.s"
    return f"SELECT * FROM ({n}) UNION SELECT * FROM ({r}) UNION {loc} UNION {two} UNION {_TYPED(loc, 'o', g.PLACE)}"


def _diff_sql(old: str, new: str, epoch: int) -> str:
    part = lambda a, b, d: f"SELECT *, CAST({epoch} AS BIGINT) AS epoch, CAST({d} AS INTEGER) AS diff FROM (({a}) EXCEPT ({b}))"
    return f"{part(new, old, 1)} UNION ALL {part(old, new, -1)}"


@register("inc_insert", _diff_sql(_closure_sql("s % 2 = 0"), _closure_sql("true"), 1))
def inc_insert(spark, sf_dir):
    return _state(spark, sf_dir).apply(facts=_half(spark, sf_dir, 1).withColumn("diff", F.lit(1)))


@register("inc_delete", _diff_sql(_closure_sql("s % 2 = 0"), _closure_sql("s % 4 = 0"), 1))
def inc_delete(spark, sf_dir):
    gone = _half(spark, sf_dir, 0).where("s % 4 <> 0")
    return _state(spark, sf_dir).apply(facts=gone.withColumn("diff", F.lit(-1)))


@register("inc_changes", _diff_sql(_closure_sql("s % 2 = 0"), _closure_sql("s % 4 <> 2"), 1))
def inc_changes(spark, sf_dir):
    gone = _half(spark, sf_dir, 0).where("s % 4 = 2").withColumn("diff", F.lit(-1))
    return _state(spark, sf_dir).apply(facts=gone.union(_half(spark, sf_dir, 1).withColumn("diff", F.lit(1))))


_n = lambda sql: f"(SELECT count(*) FROM ({sql}))"


@register("batch_log", f"SELECT CAST(0 AS BIGINT) AS batch, CAST({_n(_closure_sql('s % 2 = 0'))} AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed UNION ALL SELECT CAST(1 AS BIGINT), CAST({_n(_closure_sql('true'))} - {_n(_closure_sql('s % 2 = 0'))} AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT), CAST(0 AS BIGINT), CAST({_n(_closure_sql('true'))} - {_n(_closure_sql('s % 2 = 0'))} AS BIGINT)")
def batch_log(spark, sf_dir):
    """Changes counted when half is loaded, the rest added, and the rest taken out."""
    state = _state(spark, sf_dir)
    rest = _half(spark, sf_dir, 1)
    state.apply(facts=rest.withColumn("diff", F.lit(1)))
    state.apply(facts=rest.withColumn("diff", F.lit(-1)))
    return spark.createDataFrame([(i, r[2], r[3]) for i, r in enumerate(state.log)], "batch long, added long, removed long")


# -- sources and streams -------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@register("encoded_round_trip", g.graph_sql(*ALL_FACTS))
def encoded_round_trip(spark, sf_dir):
    """Facts written as encoded lines and read again."""
    path = _folder(spark)
    src.write_encoded(g.graph(spark, sf_dir, *ALL_FACTS), path)
    return src.read_encoded(spark, path)


@register("table_by_predicate", g.graph_sql("placed_by"))
def table_by_predicate(spark, sf_dir):
    """Facts kept in folders by predicate, of which one is read."""
    path = _folder(spark)
    src.write_table(g.graph(spark, sf_dir, *ALL_FACTS), path, by_predicate=True)
    return pr.where_predicate(src.read_table(spark, path), g.PLACED_BY)


@register("ntriples_round_trip", f"SELECT '<urn:n' || s || '>' AS s, '<urn:p' || p || '>' AS p, '\"' || o || '\"' AS o FROM ({g.graph_sql('in_nation', 'in_region')})")
def ntriples_round_trip(spark, sf_dir):
    """Facts written as N-Triples, read, encoded by a dictionary of their terms, and decoded."""
    path = _folder(spark)
    line = F.format_string('<urn:n%d> <urn:p%d> "%d" .', "s", "p", "o")
    g.graph(spark, sf_dir, "in_nation", "in_region").select(line).write.text(path)
    texts = src.read_ntriples(spark, path)
    ids = src.dictionary(texts)
    return src.decode(src.encode(texts, ids), ids)


def _streamed(spark, sf_dir: str) -> str:
    """A stream that takes the schema and half of the facts, ends, and is started again with
    an empty state for the other half and for what is taken out; gives the folder of changes."""
    place = _folder(spark)
    row = lambda df, diff, axiom: df.select("s", "p", "o", F.lit(diff).alias("diff"), F.lit(0).cast("long").alias("seq"), F.lit(axiom).alias("axiom"))
    first = row(g.axioms(spark, PROFILE_SCHEMA), 1, True).union(row(_half(spark, sf_dir, 0).union(g.edges(spark, sf_dir, "in_region")), 1, False))
    second = row(_half(spark, sf_dir, 1), 1, False).union(row(_half(spark, sf_dir, 0).where("s % 4 = 2"), -1, False))
    for part in (first, second):
        part.write.mode("append").parquet(f"{place}/feed")
        feed = src.read_feed(spark, f"{place}/feed", axioms=True)
        materialize_stream(feed, Incremental("rdfspp"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return f"{place}/out"


def _epochs(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("s", "p", "o", F.col("epoch").cast("long").alias("epoch"), F.col("diff").cast("int").alias("diff"))


_START = f"SELECT *, CAST(0 AS BIGINT) AS epoch, CAST(1 AS INTEGER) AS diff FROM ({_closure_sql('s % 2 = 0')})"


@register("stream_changes", f"{_START} UNION ALL {_diff_sql(_closure_sql('s % 2 = 0'), _closure_sql('s % 4 <> 2'), 1)}")
def stream_changes(spark, sf_dir):
    """The closure's changes by epoch, over a restart."""
    return _epochs(spark, _streamed(spark, sf_dir))


@register("stream_schema", f"SELECT *, CAST(0 AS BIGINT) AS epoch, CAST(1 AS INTEGER) AS diff FROM ({g.values_sql([(g.CUSTOMER, v.SUB_CLASS_OF, g.AGENT), (g.AGENT, v.SUB_CLASS_OF, 2020), (g.CUSTOMER, v.SUB_CLASS_OF, 2020)])})")
def stream_schema(spark, sf_dir):
    """The schema's changes by epoch: classes and those above them."""
    return pr.where_predicate(_epochs(spark, f"{_streamed(spark, sf_dir)}-schema"), v.SUB_CLASS_OF)


# -- identity that facts follow --------------------------------------------------------

NOTE = 1040
_NOTE = f"SELECT s, CAST({NOTE} AS BIGINT) AS p, s + 4000000000 AS o FROM ({g.graph_sql('content_key')})"


@register(
    "owl2rl_identity",
    f"SELECT * FROM ({g.graph_sql('content_key')}) UNION {_NOTE} UNION SELECT e.a AS s, n.p, n.o FROM ({E_SQL}) e JOIN ({_NOTE}) n ON n.s = e.b UNION {g.values_sql([(v.THING, TYPE, v.CLASS), (v.NOTHING, TYPE, v.CLASS)])}",
)
def owl2rl_identity(spark, sf_dir):
    """Each document has a note of its own; those of equal content have each other's, too."""
    keys = g.edges(spark, sf_dir, "content_key")
    notes = keys.select("s", F.lit(NOTE).cast("long").alias("p"), (F.col("s") + 4000000000).alias("o"))
    return materialize(g.axioms(spark, [(g.CONTENT_KEY, TYPE, v.INVERSE_FUNCTIONAL)]), keys.union(notes), "owl2rl").abox


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
