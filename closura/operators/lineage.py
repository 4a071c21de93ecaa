"""Cutting lineage between rounds of a fixpoint."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

SENT_ROWS = 100_000  # rows up to which a written table may be broadcast in a join


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see.  Where none is set, a
    local master gets a temporary one, as in tests; on a cluster that is an error, for each
    machine would write to its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="closura-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the plan starts
    anew, statistics are known, and a lost executor costs no earlier round."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path, out.cut_rows = path, seen.get["rows"]
    return out


def unsent(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """``df``, made of the written ``parts``, as a side of joins: with over ``SENT_ROWS`` rows it is
    shuffled.  Spark goes by the size of files, and sends millions of ids that Parquet
    packs into a few MB to the driver."""
    return df.hint("merge") if sum(getattr(x, "cut_rows", SENT_ROWS + 1) for x in parts or (df,)) > SENT_ROWS else df


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``cut`` that nothing reads any more."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Jobs started inside show ``text`` as their description, after what they had before."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.job.description")
    sc.setLocalProperty("spark.job.description", f"{before}: {text}" if before else text)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.job.description", before)
