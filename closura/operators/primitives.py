"""The primitive operators over triples (s, p, o: long)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

TRIPLE = StructType([StructField(c, LongType(), False) for c in "spo"])
SIGNED = StructType([*TRIPLE.fields, StructField("diff", IntegerType(), False)])
COLS = ("s", "p", "o")


def triples(spark: SparkSession, rows) -> DataFrame:
    """A constant source."""
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], TRIPLE)


def where_predicate(t: DataFrame, p: int) -> DataFrame:
    return t.where(F.col("p") == p)


def pairs(t: DataFrame, p: int, s: str = "s", o: str = "o") -> DataFrame:
    """The (subject, object) pairs of one predicate, under new names."""
    return t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def swapped(t: DataFrame, p: int | Column | None = None) -> DataFrame:
    p = F.col("p") if p is None else F.lit(p).cast("long") if isinstance(p, int) else p
    return t.select(F.col("o").alias("s"), p.alias("p"), F.col("s").alias("o"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(*COLS) for x in parts])


def distinct(t: DataFrame) -> DataFrame:
    return t.select(*COLS).distinct()


def consolidated(t: DataFrame, by: tuple[str, ...] = COLS) -> DataFrame:
    """Equal rows with their weights added; those that cancel out go."""
    return t.groupBy(*by).agg(F.sum("diff").cast("int").alias("diff")).where("diff <> 0")


def present(signed: DataFrame) -> DataFrame:
    """The facts of a signed multiset: net weight above 0, whatever the order."""
    return signed.groupBy(*COLS).agg(F.sum("diff").alias("n")).where("n > 0").select(*COLS)


def negated(t: DataFrame) -> DataFrame:
    return t.withColumn("diff", (-F.col("diff")).cast("int"))


def semi(t: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return t.join(other, on, "left_semi")


def anti(t: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return t.join(other, on, "left_anti")
