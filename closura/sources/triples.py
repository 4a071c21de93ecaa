"""Readers and writers of encoded triples, signed feeds, text triples and batch logs."""

from __future__ import annotations

import csv
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.vocab import FIRST_USER_ID, IRIS
from ..operators.primitives import COLS, SIGNED

MOST_ID = 2**32 - 1


class MalformedTriple(ValueError):
    """A line that is no encoded triple."""


def read_encoded(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """``s p o`` of unsigned 32-bit numbers, one blank between; blank lines are passed
    over, further columns ignored.  With ``check``, a malformed line is an error that
    shows it; otherwise it fails when it is reached."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", " ")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    rows = lines.select("value", *[at(i).alias(c) for i, c in enumerate(COLS)])
    fine = F.lit(True)
    for c in COLS:
        fine = fine & F.coalesce(F.col(c).between(0, MOST_ID), F.lit(False))
    if check:
        wrong = rows.where(~fine).select("value").limit(1).collect()
        if wrong:
            raise MalformedTriple(f"not three unsigned 32-bit numbers: {wrong[0]['value']!r}")
    else:
        rows = rows.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("malformed triple: "), "value"))))
    # a default that no row takes makes the columns non-null for the planner
    return rows.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in COLS])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Triples kept as Parquet."""
    return spark.read.parquet(path).select(*[F.col(c).cast("long").alias(c) for c in COLS])


def write_table(facts: DataFrame, path: str, by_predicate: bool = False) -> None:
    """Facts as Parquet, if asked for in folders by predicate, which scans then prune."""
    w = facts.select(*COLS).write.mode("overwrite")
    (w.partitionBy("p") if by_predicate else w).parquet(path)


def write_encoded(facts: DataFrame, path: str) -> None:
    facts.select(F.concat_ws(" ", *COLS)).write.mode("overwrite").text(path)


def signed(facts: DataFrame, diff: int = 1) -> DataFrame:
    return facts.select(*COLS, F.lit(diff).cast("int").alias("diff"))


def read_feed(spark: SparkSession, path: str, per_trigger: int | None = None, axioms: bool = False) -> DataFrame:
    """A stream of signed updates from Parquet files (s, p, o, diff, seq), with ``axioms`` also
    of the schema (and axiom, true for these)."""
    schema = StructType([*SIGNED.fields, StructField("seq", LongType(), False), *[StructField("axiom", BooleanType(), False)] * axioms])
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


# -- text triples ---------------------------------------------------------------

_NODE = r"(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples as (s, p, o: string); comments and blank lines are passed over."""
    line = rf"^\s*{_NODE}\s+(<[^>]*>)\s+{_NODE}\s*\.\s*$"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", line, i)
    rows = lines.select("value", part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    return rows.where(F.when(F.col("p") != "", True).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "value")))).select("s", "p", "o")


def dictionary(texts: DataFrame, *more: DataFrame) -> DataFrame:
    """(term, id) of all terms: reserved ones have their ids, others follow in the order
    of the terms."""
    spark = texts.sparkSession
    known = spark.createDataFrame([(f"<{iri}>", i) for iri, i in IRIS.items()], "term string, id long")
    terms = None
    for t in (texts, *more):
        part = t.select(F.explode(F.array(*COLS)).alias("term"))
        terms = part if terms is None else terms.union(part)
    new = terms.distinct().join(F.broadcast(known), "term", "left_anti")
    # ranges of terms are numbered apart, then shifted by what comes before them
    from pyspark.sql import Window

    ranged = new.repartitionByRange("term").sortWithinPartitions("term").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id() % (1 << 33))
    sizes = ranged.groupBy("part").count()
    base = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = ranged.join(F.broadcast(base), "part").select("term", (F.col("base") + F.col("row") + FIRST_USER_ID).alias("id"))
    return known.union(numbered)


def encode(texts: DataFrame, ids: DataFrame) -> DataFrame:
    out = texts
    for c in COLS:
        out = out.join(ids.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id")), c)
    return out.select(*[F.col(f"{c}_id").alias(c) for c in COLS])


def decode(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Terms of the facts; an id without a term stays as a number."""
    out = facts
    for c in COLS:
        out = out.join(ids.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term")), c, "left")
    return out.select(*[F.coalesce(f"{c}_term", F.col(c).cast("string")).alias(c) for c in COLS])


# -- batch log --------------------------------------------------------------------

HEADER = ("file", "latency", "added", "removed", "worker")


def write_log(folder: str, facts_path: str, profile: str, batch_size: float, workers: int, rows: list[tuple]) -> str:
    """``{stem}_{profile}_{batch size}_{workers}_{ms}.csv`` with a row for each batch."""
    name = f"{Path(facts_path).stem}_{profile}_{batch_size:g}_{workers}_{int(time.time() * 1000)}.csv"
    path = Path(folder) / name
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerows(rows)
    return str(path)
