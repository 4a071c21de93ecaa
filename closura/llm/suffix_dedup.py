"""Exact substring deduplication by suffix arrays (operator 3).

Every byte is removed that lies in a string of ``length`` bytes which starts anywhere
else too, in the same document or another; strings never cross documents, and are
judged on the input.

Suffixes that can be equal are first brought together.  Of each string of ``length``
bytes, the least hash of its ``gram``-byte substrings (the leftmost of equals) is its
key: equal strings have equal keys.  A run of starts with one such substring, and the
text that they span, is a segment; each start is in exactly one.  Per key:

* one segment, once: nothing there is repeated;
* a segment whose text comes more than once: all its starts are repeated;
* different segments: starts are told apart by their distance to the key's substring,
  in blocks of ``BLOCKS``; all strings of a block share a core of ``length + 1 - block``
  bytes, so only segments with equal cores go on, and equal parts are settled again;
* what is left, around the ends of repeated text, is concatenated to shards, for
  which a suffix array is made by induced sorting (Nong, Zhang & Chan 2009): suffixes
  are classified, the leftmost-smaller substrings sorted and named, recursively where
  names repeat, and the array is induced from them in two linear passes.  Permuted
  common prefixes (Karkkainen, Manzini & Puglisi 2009) then part the suffixes into
  classes that share ``length`` bytes; a class with two owned starts is repeated.

A group of over ``block`` segments is salted over several shards; each sends one hash
for a class, with which classes are then joined across the shards.

Cases: null text is empty; texts shorter than ``length`` keep all; repeated rows are
copies of each other; rows are told apart whatever their ids (see ``common.with_rows``), so
rows of one id, or of none, are compared and cut each by its own text; an empty table gives
no rows; ties (equal hashes) are settled on the bytes' suffixes; other columns are not read.
A task holds one text of any length, in about 40 times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, lean, mix, prefix_sums, slices, span_hash, tidy, with_rows

LENGTH = 400  # bytes of a repeated string
GRAM = 128  # bytes hashed for a key
BLOCKS = (68, 8)  # starts told apart by their cores, coarse then fine
BLOCK = 512  # segments of a group in one shard
SHARD_BYTES = 1 << 20
STARTS = 1 << 21  # starts that one vectorised step looks at


# -- suffix arrays -----------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next one (type S)."""
    n = len(s)
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)  # the sentinel is S
    out[:-1] = step[np.minimum(after, n - 2)] > 0
    return out


def _induced(s: list, larger: list, sizes: np.ndarray, seeds: np.ndarray) -> list:
    """The order that sorted leftmost-smaller suffixes ``seeds`` induce."""
    n = len(s)
    sa = [-1] * n
    ends = np.cumsum(sizes)
    tail = ends.tolist()
    for j in seeds[::-1].tolist():
        c = s[j]
        tail[c] -= 1
        sa[tail[c]] = j
    head = (ends - sizes).tolist()
    for j in sa:
        # the list grows ahead of this position while it is read
        if j > 0 and larger[j - 1]:
            j -= 1
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i]
        if j > 0 and not larger[j - 1]:
            j -= 1
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of integers whose last one is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    values, larger = s.tolist(), (~small).tolist()
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = np.array(_induced(values, larger, sizes, lms), np.int64)
    sorted_lms = rough[is_lms[rough]]
    # names: equal substrings between leftmost-smaller positions get one name
    m = len(lms)
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(m)
    length = np.ones(m, np.int64)
    length[:-1] = np.diff(lms) + 1
    sums = prefix_sums_of(s)
    key = span_hash(sums, lms, lms + length)
    order = place[sorted_lms]
    fresh = np.ones(m, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (length[order][1:] != length[order][:-1])
    names = np.empty(m, np.int64)
    names[order] = np.cumsum(fresh) - 1
    if not fresh.all():
        sorted_lms = lms[suffix_array(names)]
    return np.array(_induced(values, larger, sizes, sorted_lms), np.int64)


def prefix_sums_of(s: np.ndarray) -> np.ndarray:
    """As ``prefix_sums``, of integers of any size."""
    from .common import powers

    out = np.zeros(len(s) + 1, np.uint64)
    up, _ = powers(len(s) + 1)
    np.cumsum(mix(s.astype(np.uint64) + np.uint64(0x51ED270B)) * up[:-1], out=out[1:])
    return out


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, how much it shares with the one before it in ``sa``, up to
    ``most``: in text order each shares at least one less than the last did."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    text = (s - 1).astype(np.uint8)[:-1].tobytes()
    out = [0] * n
    l = 0
    end = n - 1
    for i, p in enumerate(before.tolist()):
        if p < 0:
            l = 0
            continue
        # whole steps while they agree, then byte by byte
        while l < most:
            if text[i + l : i + l + 32] == text[p + l : p + l + 32] and max(i, p) + l + 32 <= end:
                l += 32
                continue
            top = end - max(i, p)
            while l < top and text[i + l] == text[p + l]:
                l += 1
            break
        if l > most:
            l = most
        out[i] = l
        if l:
            l -= 1
    return np.array(out, np.int64)


def repeated_classes(segments: list[bytes], owned: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, start and class of every owned start (the first ``owned[k]`` of
    segment k); starts of one class have the same ``length`` bytes."""
    text = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    s = np.concatenate([text, [0]])
    base = np.concatenate([[0], np.cumsum([len(x) for x in segments])])
    sa = suffix_array(s)
    shared = permuted_common_prefixes(s, sa, length)[sa]
    group = np.empty(len(s), np.int64)
    group[sa] = np.cumsum(shared < length)
    which = np.repeat(np.arange(len(segments)), owned)
    first = np.repeat(np.cumsum([0, *owned[:-1]]), owned)
    rel = np.arange(len(which)) - first
    return which, rel, group[base[which] + rel]


# -- segments ----------------------------------------------------------------


def segments_of(raw: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Row, first start in the row, number of starts, place of the key's substring, key
    and text hash of each segment."""
    got = []
    width = length - gram + 1
    sums = prefix_sums(raw) if len(raw) >= length else None
    for lo in range(0, max(0, len(raw) - length + 1), STARTS):
        n = min(STARTS, len(raw) - length + 1 - lo)
        at = lo + np.arange(n + width - 1)
        h = span_hash(sums, at, at + gram)
        packed = ((h >> np.uint64(26)) << np.uint64(26)) | np.arange(len(h), dtype=np.uint64)
        pad = -len(packed) % width
        table = np.concatenate([packed, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << 26) - 1)).astype(np.int64)
        start = lo + np.arange(n)
        row = np.searchsorted(offs, start, "right") - 1
        valid = np.flatnonzero(start + length <= offs[row + 1])
        if not len(valid):
            continue
        a, r = anchor[valid], row[valid]
        edge = np.ones(len(valid), bool)
        edge[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(valid)))
        begin = start[valid[first]]
        rows = r[first]
        got.append((rows, begin - offs[rows], count, lo + a[first] - begin, h[a[first]].view(np.int64), span_hash(sums, begin, begin + count - 1 + length).view(np.int64)))
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else None


def segment_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, raw, offs in slices(batch.column("text")):
                got = segments_of(raw, offs, length, gram)
                if got is None:
                    continue
                rows, begin, count, at, key, seg = got
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(rows)), pa.array(begin, pa.int64()), pa.array(count, pa.int32()), pa.array(at, pa.int32()), pa.array(key), pa.array(seg)],
                    names=["doc_id", "begin", "count", "at", "key", "seg"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, begin long, count int, at int, key long, seg long")


def _intervals(rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(rel) != 1)
    return rel[np.concatenate([[0], gap + 1])], rel[np.concatenate([gap, [len(rel) - 1]])]


def shard_results(texts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """For each shard of (grp, salt, split, key, seg, base, copies, count, body): repeated
    starts as (key, seg, first, last); for salted groups also (grp, window) for one start
    of each class, ``last`` null, ``first`` that of a start that only it has or -1."""

    kinds = {"grp": pa.int64(), "key": pa.int64(), "seg": pa.int64(), "first": pa.int32(), "last": pa.int32(), "window": pa.int64()}
    fields = ("grp", "salt", "split", "key", "seg", "base", "copies", "count", "body")

    def shard(rows: list) -> pa.RecordBatch:
        which, rel, group = repeated_classes([r["body"] for r in rows], [r["count"] for r in rows], length)
        copies = np.array([r["copies"] for r in rows])
        weight = np.bincount(group, copies[which])
        out: dict[str, list] = {k: [] for k in kinds}

        def put(r: dict, first: int, last: int | None, window: int | None) -> None:
            for name, v in zip(out, (r["grp"], r["key"], r["seg"], first, last, window), strict=True):
                out[name].append(v)

        twice = np.flatnonzero(weight[group] >= 2)
        for k in np.unique(which[twice]):
            if copies[k] == 1:
                for x, y in zip(*_intervals(rel[twice[which[twice] == k]]), strict=True):
                    put(rows[k], rows[k]["base"] + int(x), rows[k]["base"] + int(y), None)
        split = np.array([r["split"] for r in rows])
        if split.any():
            _, one = np.unique(group, return_index=True)
            one = one[split[which[one]]]
            for k in np.unique(which[one]):
                mine = one[which[one] == k]
                sums = prefix_sums(np.frombuffer(rows[k]["body"], np.uint8))
                window = span_hash(sums, rel[mine], rel[mine] + length).view(np.int64)
                alone = weight[group[mine]] < 2
                for x, w, solo in zip(rel[mine].tolist(), window.tolist(), alone.tolist(), strict=True):
                    put(rows[k], rows[k]["base"] + x if solo else -1, None, w)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    def run(batches):
        held: list = []
        size, last = 0, None
        for batch in batches:
            for r in batch.select(fields).to_pylist():
                now = (r["grp"], r["salt"])
                if held and now != last and size + len(r["body"]) > shard_bytes:
                    yield shard(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r["body"]), now
        if held:
            yield shard(held)

    # as many tasks as there are shards: by bytes alone, a few tasks would get all the sorting
    size = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    ordered = texts.select(*fields).repartition(max(1, -(-size // shard_bytes)), "grp", "salt").sortWithinPartitions("grp", "salt", "seg", "base")
    return ordered.mapInArrow(lean(run), "grp long, key long, seg long, first int, last int, window long")


def _told_apart(rows: DataFrame, block: int, length: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (grp, key, seg, base, at, count, copies, body) by blocks of starts.

    Marks (key, seg, first, last) of starts whose whole block of text comes again, and
    the rows of groups in which different texts have the same core."""
    most = (length - 1) // block + 1
    lo = F.greatest(F.lit(0), F.col("at") - (F.col("j") + 1) * block + 1)
    hi = F.least(F.col("count") - 1, F.col("at") - F.col("j") * block)
    cut_to = lambda start, size: F.xxhash64(F.expr(f"substring(body, {start} + 1, {size})"))
    blocks = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    parts = blocks.select(
        "grp", "key", "seg", "base", "j", "lo", "hi", "copies",
        cut_to(f"(at - j * {block})", length + 1 - block).alias("core"),
        F.xxhash64(cut_to("lo", f"(hi - lo + {length})"), F.col("at") - F.col("lo"), F.col("hi") - F.col("lo")).alias("part"),
    )
    parts = cut(parts)
    own = parts.groupBy("grp", "j", "core", "part").agg(F.sum("copies").alias("total"), F.min(F.struct("key", "seg", "base")).alias("one"))
    own = cut(own)
    groups = own.groupBy("grp", "j", "core").agg(F.count("*").alias("kinds"), F.min("total").alias("least")).where("kinds > 1 and least = 1").select("grp", "j", "core")
    again = own.where("total > 1").select("grp", "j", "core", "part")
    marks = parts.where("copies = 1").join(again, ["grp", "j", "core", "part"]).select("key", "seg", (F.col("base") + F.col("lo")).cast("int").alias("first"), (F.col("base") + F.col("hi")).cast("int").alias("last"))
    left = own.join(groups, ["grp", "j", "core"]).select(F.col("grp"), "one.*", "j", "core", "total")
    body = left.join(rows.select("grp", "key", "seg", "base", "at", "count", "body"), ["grp", "key", "seg", "base"]).withColumn("lo", lo).withColumn("hi", hi)
    body = body.select(
        F.xxhash64("grp", "j", "core").alias("grp"), "key", "seg", (F.col("base") + F.col("lo")).cast("int").alias("base"), (F.col("at") - F.col("lo")).alias("at"), (F.col("hi") - F.col("lo") + 1).alias("count"),
        F.col("total").alias("copies"), F.expr(f"substring(body, lo + 1, hi - lo + {length})").alias("body"),
    )
    return cut(marks), cut(body)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, blocks: tuple = BLOCKS, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, spans: array of (start, end) of repeated bytes, overlapping or not, for
    the documents that have any; each row has an id of its own."""
    spark = docs.sparkSession
    segments = cut(segment_table(docs, length, gram))
    kinds = segments.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "begin", "count", "at")).alias("one"))
    kinds = cut(kinds.select("key", "seg", "copies", "one.*"))
    tidy(spark)
    keys = kinds.groupBy("key").agg(F.count("*").alias("segs"), F.min("copies").alias("least")).where("segs > 1 and least = 1").select("key")
    mixed = kinds.join(keys, "key")
    body = docs.select("doc_id", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    rows = mixed.join(body, "doc_id").select(
        F.col("key").alias("grp"), "key", "seg", F.lit(0).alias("base"), "at", "count", "copies", F.expr(f"substring(raw, cast(begin as int) + 1, count + {length - 1})").alias("body")
    )
    rows = cut(rows)
    marks = kinds.where("copies > 1").select("key", "seg", F.lit(0).alias("first"), (F.col("count") - 1).alias("last"))
    for b in blocks:
        more, rows = _told_apart(rows, b, length)
        marks = marks.union(more)
        tidy(spark)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("segs"))
    shards = F.ceil(F.col("segs") / F.lit(block)).cast("int")
    texts = rows.join(sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("seg", "base"), shards).cast("int")).withColumn("split", shards > 1)
    found = cut(shard_results(texts, length, shard_bytes))
    across = found.where("window is not null").groupBy("grp", "window").agg(F.count("*").alias("n")).where("n > 1").select("grp", "window")
    joined = found.where("window is not null and first >= 0").join(across, ["grp", "window"]).select("key", "seg", "first", F.col("first").alias("last"))
    marks = marks.union(found.where("last is not null").select("key", "seg", "first", "last")).union(joined)
    hit = segments.join(marks, ["key", "seg"]).select("doc_id", (F.col("begin") + F.col("first")).alias("start"), (F.col("begin") + F.col("last") + length).alias("end"))
    return hit.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def cleaned(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each row."""
    docs, _ = with_rows(docs, F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs.select(F.col("row").alias("doc_id"), "text"), length, **options).withColumnRenamed("doc_id", "row")
    rows = docs.select("row", "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    joined = rows.join(spans, "row", "left").select("doc_id", "raw", F.array_sort("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for raw, spans in zip(batch.column("raw"), batch.column("spans"), strict=True):
                text = raw.as_py()
                parts, at, removed, runs, stop = [], 0, 0, 0, -1
                if spans.is_valid:
                    s = spans.values.flatten()
                    for x, y in zip(s[0].to_pylist(), s[1].to_pylist(), strict=True):
                        if x > stop:
                            runs += 1
                        if y > at:
                            x = max(x, at)
                            parts.append(text[at:x])
                            removed += y - x
                            at = y
                        stop = max(stop, y)
                parts.append(text[at:])
                for k, v in zip(cols, (len(text), removed, runs, b"".join(parts)), strict=True):
                    cols[k].append(v)
            arrays = [pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *cols])

    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

