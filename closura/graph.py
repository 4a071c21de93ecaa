"""A graph from relational tables: facts for the registered queries.

Entities are numbered by kind, ``BASE[kind] + key``; contents of documents by the least
doc_id that has the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import vocab as v
from .operators.primitives import triples

BASE = {"region": 100_000_000, "nation": 200_000_000, "supplier": 300_000_000, "customer": 400_000_000, "part": 500_000_000, "order": 600_000_000, "document": 700_000_000, "content": 900_000_000}

IN_NATION, IN_REGION, LOCATED_IN, PLACED_BY, PLACED, SUPPLIED_BY, HAS_PART, PRECEDED_BY, ADJACENT, CONTENT_KEY, BUYS_FROM, ORDERED_BY, HAS_PRIORITY, CONTENT_OF = range(1001, 1015)
AGENT, CUSTOMER, ORDER, PLACE, THING_SOLD, LOCATED, URGENT, BUILDER_URGENT, NATION_BUYER, SEGMENT = range(2001, 2011)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # classes SEGMENT + position


def node(kind: str, column: str) -> Column:
    return F.lit(BASE[kind]).cast("long") + F.col(column).cast("long")


def facts(s: Column, p: int, o: Column) -> list[Column]:
    return [s.cast("long").alias("s"), F.lit(p).cast("long").alias("p"), o.cast("long").alias("o")]


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The facts called ``name`` as (s, p, o)."""
    t = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet")
    if name == "in_nation":
        c = t("customer").select(*facts(node("customer", "c_custkey"), IN_NATION, node("nation", "c_nationkey")))
        return c.union(t("supplier").select(*facts(node("supplier", "s_suppkey"), IN_NATION, node("nation", "s_nationkey"))))
    if name == "in_region":
        return t("nation").select(*facts(node("nation", "n_nationkey"), IN_REGION, node("region", "n_regionkey")))
    if name == "placed_by":
        return t("orders").select(*facts(node("order", "o_orderkey"), PLACED_BY, node("customer", "o_custkey")))
    if name == "supplied_by":
        return t("lineitem").select(*facts(node("order", "l_orderkey"), SUPPLIED_BY, node("supplier", "l_suppkey"))).distinct()
    if name == "has_part":
        return t("lineitem").select(*facts(node("order", "l_orderkey"), HAS_PART, node("part", "l_partkey"))).distinct()
    if name == "preceded_by":
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        lagged = t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before")).where("before is not null")
        return lagged.select(*facts(node("order", "o_orderkey"), PRECEDED_BY, node("order", "before")))
    if name == "content_key":
        docs = t("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
        least = docs.groupBy("h").agg(F.min("doc_id").alias("m"))
        return docs.join(least, "h").select(*facts(node("document", "doc_id"), CONTENT_KEY, node("content", "m")))
    if name == "content_of":
        return edges(spark, sf_dir, "content_key").select(*facts(F.col("o"), CONTENT_OF, F.col("s")))
    if name == "by_document":  # a document in the place of a property
        return edges(spark, sf_dir, "content_key").select(F.col("o").alias("s"), F.col("s").alias("p"), "o")
    if name == "segment":
        k = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
        return t("customer").where(k > 0).select(*facts(node("customer", "c_custkey"), v.TYPE, k - 1 + SEGMENT))
    if name == "segment_kind":  # segments are themselves of a type: facts of type that chain
        k = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
        return t("customer").where(k > 0).select(*facts(k - 1 + SEGMENT, v.TYPE, node("nation", "c_nationkey"))).distinct()
    if name == "priority":
        return t("orders").select(*facts(node("order", "o_orderkey"), HAS_PRIORITY, F.substring("o_orderpriority", 1, 1).cast("long") + 2100))
    raise KeyError(name)


_B = BASE
#: The same facts in SQL.
SQL = {
    "in_nation": f"SELECT {_B['customer']}+c_custkey AS s, {IN_NATION} AS p, {_B['nation']}+c_nationkey AS o FROM customer UNION ALL SELECT {_B['supplier']}+s_suppkey, {IN_NATION}, {_B['nation']}+s_nationkey FROM supplier",
    "in_region": f"SELECT {_B['nation']}+n_nationkey AS s, {IN_REGION} AS p, {_B['region']}+n_regionkey AS o FROM nation",
    "placed_by": f"SELECT {_B['order']}+o_orderkey AS s, {PLACED_BY} AS p, {_B['customer']}+o_custkey AS o FROM orders",
    "supplied_by": f"SELECT DISTINCT {_B['order']}+l_orderkey AS s, {SUPPLIED_BY} AS p, {_B['supplier']}+l_suppkey AS o FROM lineitem",
    "has_part": f"SELECT DISTINCT {_B['order']}+l_orderkey AS s, {HAS_PART} AS p, {_B['part']}+l_partkey AS o FROM lineitem",
    "preceded_by": f"SELECT {_B['order']}+o_orderkey AS s, {PRECEDED_BY} AS p, {_B['order']}+before AS o FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NOT NULL",
    "content_key": f"SELECT {_B['document']}+doc_id AS s, {CONTENT_KEY} AS p, {_B['content']}+min(doc_id) OVER (PARTITION BY text) AS o FROM documents WHERE text IS NOT NULL",
    "segment": f"SELECT {_B['customer']}+c_custkey AS s, {v.TYPE} AS p, CASE c_mktsegment " + " ".join(f"WHEN '{x}' THEN {SEGMENT + i}" for i, x in enumerate(SEGMENTS)) + " END AS o FROM customer",
    "priority": f"SELECT {_B['order']}+o_orderkey AS s, {HAS_PRIORITY} AS p, 2100+CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS o FROM orders",
}
SQL["segment_kind"] = f"SELECT DISTINCT s.o AS s, {v.TYPE} AS p, {_B['nation']}+c_nationkey AS o FROM ({SQL['segment']}) s JOIN customer ON s.s = {_B['customer']}+c_custkey"
SQL["content_of"] = f"SELECT o AS s, {CONTENT_OF} AS p, s AS o FROM ({SQL['content_key']})"
SQL["by_document"] = f"SELECT o AS s, s AS p, o FROM ({SQL['content_key']})"


def graph(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = edges(spark, sf_dir, names[0])
    for n in names[1:]:
        out = out.union(edges(spark, sf_dir, n))
    return out


def graph_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST(s AS BIGINT) AS s, CAST(p AS BIGINT) AS p, CAST(o AS BIGINT) AS o FROM ({SQL[n]})" for n in names)


def axioms(spark: SparkSession, rows) -> DataFrame:
    return triples(spark, rows)


def values_sql(rows) -> str:
    return "SELECT CAST(s AS BIGINT) AS s, CAST(p AS BIGINT) AS p, CAST(o AS BIGINT) AS o FROM (VALUES " + ", ".join(str(tuple(r)) for r in rows) + ") AS x(s, p, o)"
