"""What the corpus operators share: tables cut from their lineage, joins behind
a size check, and vectorised word work on Arrow's UTF-8 buffers.

Words are ``[^\\x20\\x09-\\x0D]+``.  Those bytes never occur inside a UTF-8
sequence, so words are found on bytes and equal those found on characters.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lineage import shared_dir

SLICE_BYTES = 1 << 18  # bytes of text that one vectorised step holds: its arrays stay in a cache
BATCH_ROWS = 1000  # rows that go to a Python worker at once
BROADCAST_ROWS = 2_000_000  # rows of at most two longs that may be broadcast

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20  # A-Z only

_rng = np.random.default_rng(20240607)
BYTE_KEYS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POSITION_KEYS = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Documents are large rows: the default of 10,000 in a batch costs JVM and worker
    some hundred MB a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  A lost executor costs
    no recomputation beyond this point, and the plan starts anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``cut`` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.cut_path
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: they stay until the driver
    happens to collect its garbage, which a long loop shouldn't wait for.  What the driver's
    JVM has freed beside its heap goes back too."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """``trim`` for the driver's JVM.  Many small jobs leave some hundred MB there that the C
    library keeps in its arenas.  By the management command of Java 17.0.9 and later on
    Linux; others do without."""
    sc = spark.sparkContext
    jvm = sc._jvm
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = sc._gateway.new_array(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given = sc._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        # by the interface: the server's own class is not open to callers
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def keep_ids(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``ids``.  The ids are counted: up to
    ``limit`` they are broadcast and ``df`` stays where it is; beyond, both sides
    are shuffled."""
    ids = ids.select(on).distinct()
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), on, "left_semi")


def with_rows(docs: DataFrame, *columns) -> tuple[DataFrame, bool]:
    """``row`` (long), ``doc_id`` and ``columns``, and whether rows had to be numbered.

    Where every row has an id of its own, that is its ``row``, and nothing is written.  Else
    (repeated or missing ids) the rows are numbered and written, so that each keeps its
    number and its text, whatever other rows have its id."""
    clashes = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    if not clashes:
        return docs.select(F.col("doc_id").cast("long").alias("row"), "doc_id", *columns), False
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns)), True


def lean(run):
    """``run`` of ``mapInArrow``, after which the worker gives back what it held: workers
    stay, idle, beside the next stages."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            for drop in LEAVING:
                drop()
            gc.collect()
            trim()

    return inner


def forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


LEAVING = [forget_powers]  # called in a worker at the end of a partition


def texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of up to ``most`` bytes (one row at least): first and last row,
    the bytes, and each row's offset in them.  Nulls are empty."""
    column = texts(column)
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    trim()


def trim() -> None:
    """Give freed memory back: workers stay, idle, beside the next stages' JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of keyed bytes; ``span_hash`` gives any span's hash from them."""
    out = np.zeros(len(raw) + 1, np.uint64)
    up, _ = powers(len(raw) + 1)
    np.cumsum(BYTE_KEYS[raw] * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """Words of a run of rows: start, end (bytes), row, hash; first[r]:first[r+1]
    are the words of row r."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, fold: bool = False):
        inside = ~WHITE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        before = np.empty(len(raw), bool)
        before[:1], before[1:] = True, ~inside[:-1]
        before |= edge[:-1]
        after = np.empty(len(raw), bool)
        after[-1:], after[:-1] = True, ~inside[1:]
        after |= edge[1:]
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.hash = span_hash(prefix_sums(FOLD[raw] if fold else raw), self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of n words inside a row."""
        if len(self.row) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])
        return at, self.joined(at, n)

    def joined(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += self.hash[at + k] * POSITION_KEYS[k]
        return mix(h)


def ragged(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one array of ``parts`` in each row."""
    parts = list(parts)
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind))
