"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VIRTUAL`` points on a ring of ``RING`` positions; a document's id has a
position, too, and its home is the shard of the first point at or after it.  Shards hold
an even share of the rows and no more.  Where a home is full, a row goes on clockwise to
the next point of another shard, until one has room: first all rows try their homes, then
those left over try the second shard on their way, and so on, at most as many times as
there are shards.  Rows of one arc (those that meet the same point first) share their way
round, so these steps are taken on the counts of arcs, a table of ``shards * VIRTUAL``
rows whatever the number of documents; what an arc gives to a shard is a run of ranks.

Rows find their rank in two levels: an arc's ids are dealt by hash to buckets of about
``BUCKET`` rows, whose counts are added up, and are ranked within.  So no task has an
arc as a whole.  Rows alike in id, size and checksum are counted before they are
moved, and laid out again at the end in runs of ``BUCKET``.

The text is read once, for its size and checksum, and is not moved.  Everything is
DataFrame operations; no executor runs Python.

Cases: a null text is an empty one (size 1, checksum 0).  A null id counts as the empty
string and is kept as null.  Repeated rows each get a slot of their own.  An empty table
gives no rows, and a table with fewer rows than shards leaves shards empty.  Columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut

VIRTUAL = 128  # points of a shard on the ring
RING = 1 << 16  # positions
BUCKET = 50_000  # rows that are ranked together


def position(text: Column) -> Column:
    """A place on the ring: the first four hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> tuple[DataFrame, DataFrame]:
    """(position, arc) of all positions, and (arc, way) of all points: the shards in the
    order in which they come clockwise from it.  A constant of its parameters."""
    n = shards * virtual
    points = spark.range(0, n, 1, 1).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    points = points.withColumn("position", position(F.concat_ws(":", "shard", "copy")))
    points = points.withColumn("arc", (F.row_number().over(Window.orderBy("position", "shard", "copy")) - 1).cast("int"))
    # two turns, so that each point sees all shards after it
    turns = points.union(points.withColumn("arc", F.col("arc") + n))
    # backwards, as frames that only grow cost one step a row
    after = Window.orderBy(F.desc("arc")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = [F.struct(F.min(F.when(F.col("shard") == s, F.col("arc"))).over(after).alias("at"), F.lit(s).alias("shard")) for s in range(shards)]
    ways = turns.select("arc", F.transform(F.array_sort(F.array(*nearest)), lambda x: x["shard"]).alias("way")).where(F.col("arc") < n)
    # the first point at or after each position; past the last one the ring begins anew
    at = points.groupBy("position").agg(F.min("arc").alias("arc"))
    every = spark.range(0, RING, 1, 1).select(F.col("id").cast("int").alias("position")).join(F.broadcast(at), "position", "left")
    on = Window.orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    return cut(every.select("position", F.coalesce(F.min("arc").over(on), F.lit(0)).alias("arc"))), cut(ways)


def placed(arcs: DataFrame, shards: int) -> DataFrame:
    """(arc, shard, first, taken, slot): the ranks ``first`` to ``first + taken`` of an
    arc go to a shard, from ``slot`` on.  ``arcs`` is (arc, way, n)."""
    spark = arcs.sparkSession
    total = F.broadcast(arcs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")))
    k = F.col("shard")
    room = spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard")).crossJoin(total)
    room = room.select("shard", (F.floor(F.col("all") / shards) + F.when(k < F.col("all") % shards, 1).otherwise(0)).alias("room"))
    room = cut(room.select("shard", F.col("room").cast("long").alias("room"), F.lit(0).cast("long").alias("used")))
    waiting = cut(arcs.select("arc", "way", "n", F.lit(0).cast("long").alias("first")))
    out = []
    before = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(shards):
        offers = waiting.select("arc", "way", "n", "first", F.element_at("way", k + 1).alias("shard"), (F.col("n") - F.col("first")).alias("left"))
        offers = offers.join(F.broadcast(room), "shard").withColumn("ahead", F.coalesce(F.sum("left").over(before), F.lit(0)))
        offers = cut(offers.withColumn("taken", F.greatest(F.lit(0), F.least("left", F.col("room") - F.col("used") - F.col("ahead")))))
        # offers are served in the order of their arcs, so what is ahead of one that gets
        # something was served in full
        out.append(offers.where("taken > 0").select("arc", "shard", "first", "taken", (F.col("used") + F.col("ahead")).alias("slot")))
        waiting = offers.select("arc", "way", "n", (F.col("first") + F.col("taken")).alias("first")).where("first < n")
        if k + 1 == shards or not waiting.limit(1).count():
            break
        more = offers.groupBy("shard").agg(F.sum("taken").alias("more"))
        room = cut(room.join(F.broadcast(more), "shard", "left").select("shard", "room", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def sharded(docs: DataFrame, shards: int = 8, virtual: int = VIRTUAL, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, shard, home (the shard whose point the id meets first)
    and slot of every row; shards' rows differ by one at most."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    positions, ways = ring(spark, shards, virtual)
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("position", position(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).join(F.broadcast(positions), "position").drop("position")
    rows = cut(rows)
    several = rows.where(F.col("copies") > bucket).limit(1).count() > 0
    arcs = cut(ways.join(F.broadcast(rows.groupBy("arc").agg(F.sum("copies").alias("n"))), "arc"))
    # an arc's rows by buckets, counted, then ranked within each
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "size", "text_crc32")), 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(arcs.select("arc", "n")), "arc").withColumn("bucket", F.pmod(hashed, F.ceil(F.col("n") / bucket))).drop("n")
    counts = rows.groupBy("arc", "bucket").agg(F.sum("copies").alias("k"))
    earlier = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("arc", "bucket", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("arc", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(counts, ["arc", "bucket"])
    rows = rows.select("doc_id", "size", "text_crc32", "arc", "copies", (F.col("base") + F.col("ahead")).alias("rank"))
    runs = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(bucket).cast("long"))))
    if several:  # a row with very many copies is laid out by several tasks
        runs = runs.repartition("doc_id", "text_crc32", "from")
    last = F.least(F.col("from") + bucket, "copies") - 1
    runs = runs.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("rank") + F.col("from"), F.col("rank") + last)).alias("rank"))
    takes = placed(arcs, shards).groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("first", "taken", "shard", "slot"))).alias("takes"))
    homes = arcs.select("arc", F.element_at("way", 1).alias("home")).join(F.broadcast(takes), "arc")
    out = runs.join(F.broadcast(homes), "arc").withColumn("t", F.element_at(F.filter("takes", lambda t: t["first"] <= F.col("rank")), -1))
    return out.select("doc_id", "size", "text_crc32", F.col("t.shard").alias("shard"), "home", (F.col("t.slot") + F.col("rank") - F.col("t.first")).alias("slot"))
