"""Structured Streaming around ``Incremental``: a feed of signed updates in, changes out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import cut
from ..operators.primitives import COLS, consolidated, present
from ..plans.profiles import close_schema, profile_of
from .incremental import Incremental

KEPT = ("facts", "schema", "closure")


def _written(df: DataFrame, folder: str, kind: str, epoch: int) -> None:
    df.select(*COLS, F.col("diff").cast("int").alias("diff")).write.mode("overwrite").parquet(f"{folder}/{kind}/epoch={epoch}")


def save(folder: str, epoch: int, **kept: DataFrame) -> None:
    """What an epoch brought: signed rows of each of ``KEPT``.  The epoch counts once it is
    among those ``done``, which is written last."""
    for kind, df in kept.items():
        _written(df, folder, kind, epoch)
    spark = df.sparkSession
    spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("append").parquet(f"{folder}/done")


def last_epoch(spark: SparkSession, folder: str) -> int | None:
    try:
        return spark.read.parquet(f"{folder}/done").agg(F.max("epoch")).first()[0]
    except AnalysisException:  # nothing is saved there
        return None


def known_to_spark(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a query has run with this checkpoint: Spark keeps the query's id there."""
    try:
        return not spark.read.text(f"{checkpoint}/metadata").isEmpty()
    except AnalysisException:
        return False


def restore(spark: SparkSession, folder: str, state: Incremental, last: int) -> None:
    """``state`` as it was after the epoch ``last``: the sums of what the epochs brought."""
    sums = {k: consolidated(spark.read.parquet(f"{folder}/{k}").where(F.col("epoch") <= last).select(*COLS, "diff")) for k in KEPT}
    state.base_layers, state.base_schema = [cut(sums["facts"])], cut(sums["schema"])
    state.abox, state.layers = cut(sums["closure"].where("diff > 0").select(*COLS)), 1
    state.tbox = cut(close_schema(present(state.base_schema), profile_of(state.profile), state.compat)[0])
    state.epoch = last + 1


def materialize_stream(feed: DataFrame, state: Incremental, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``feed`` (s, p, o, diff, seq, perhaps axiom) is one epoch; weights add
    up, so the order within it doesn't matter.  Rows whose ``axiom`` is true update the schema.

    The facts' changes go to the folder ``out`` as Parquet, under ``epoch=N``, the schema's to
    ``out`` with ``-schema`` after it.  What each epoch brought is kept beside ``checkpoint``: a
    query that is started again takes the state up from there, whatever ``state`` held,
    and an epoch that Spark repeats is not applied twice.  A state whose checkpoint is gone is an
    error."""
    spark, folder = feed.sparkSession, f"{checkpoint}-state"
    done = last_epoch(spark, folder)
    if done is not None:
        if done >= 0 and not known_to_spark(spark, checkpoint):
            raise ValueError(f"{folder} holds epochs up to {done}, but {checkpoint} is gone: epochs would be counted anew and skipped")
        restore(spark, folder, state, done)
    else:
        empty = spark.createDataFrame([], "s long, p long, o long, diff int")
        one = F.lit(1).alias("diff")
        save(folder, -1, facts=state.base_facts if state.base_layers else empty, schema=empty if state.base_schema is None else state.base_schema, closure=empty if state.abox is None else state.abox.select(*COLS, one))
        done = -1
    seen = [done]

    def batch(df: DataFrame, epoch: int) -> None:
        if epoch <= seen[0] or df.isEmpty():
            return
        rows = df.select(*COLS, "diff", (F.col("axiom") if "axiom" in df.columns else F.lit(False)).alias("axiom"))
        facts, axioms = rows.where("not axiom").drop("axiom"), rows.where("axiom").drop("axiom")
        some = not axioms.isEmpty()
        state.epoch = epoch
        got = state.apply(schema=axioms if some else None, facts=facts, name=f"epoch-{epoch}")
        got.drop("epoch").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if some:
            state.schema_changes.drop("epoch").write.mode("overwrite").parquet(f"{out}-schema/epoch={epoch}")
        save(folder, epoch, facts=facts, schema=axioms, closure=got)
        seen[0] = epoch

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
