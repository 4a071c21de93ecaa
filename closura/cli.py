"""``python -m closura.cli TBOX ABOX PROFILE WORKERS BATCH [--compat] [--out FOLDER]``

Loads both encoded files, takes the facts in the batches that BATCH asks for (a fraction:
that part first, then the rest, then the rest out again), prints the changes counted, and
writes the batch log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.profiles import profile_of
from .sources.triples import read_encoded, signed, write_log, write_table
from .streaming.incremental import Incremental, phases


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="closura")
    p.add_argument("tbox")
    p.add_argument("abox")
    p.add_argument("profile")
    p.add_argument("workers", type=int)
    p.add_argument("batch", type=float)
    p.add_argument("--compat", action="store_true")
    p.add_argument("--out", help="folder for the closure (Parquet)")
    p.add_argument("--log-dir", default=".")
    a = p.parse_args(argv)
    if not 0 <= a.batch <= 1:
        p.error("BATCH is a fraction from 0 to 1")
    spark = SparkSession.builder.master(f"local[{a.workers}]").appName("closura").config("spark.ui.enabled", "false").getOrCreate()
    tbox, abox = read_encoded(spark, a.tbox), read_encoded(spark, a.abox)
    state = Incremental(profile_of(a.profile), a.compat)
    counts = [0, 0]
    for i, facts in enumerate(phases(abox, a.batch)):
        got = state.apply(schema=signed(tbox) if i == 0 else None, facts=facts, name=str(i))
        counts[1] += got.count()
        counts[0] += state.schema_changes.count() if i == 0 else 0
    print(f"materialized tbox triples: {counts[0]}")
    print(f"materialized abox triples: {counts[1]}")
    print(write_log(a.log_dir, a.abox, state.profile, a.batch, a.workers, state.log))
    if a.out:
        write_table(state.abox, f"{a.out}/abox")
        write_table(state.tbox, f"{a.out}/tbox")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
