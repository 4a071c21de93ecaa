"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted
text (operator 1; Kneser & Ney 1995, Chen & Goodman 1999).

Trusted documents are those labelled of quality and not toxic.  They are dealt to ``FOLDS``
folds by their text, so that copies stay together; for each language and fold there is a
model of order ``ORDER`` of all trusted documents outside the fold.  A trusted document is
scored by its fold's model, which has not seen it, any other by the mean of all models.
Characters are the units: n-gram types are then shared by many documents, so each task
counts and asks for every type once, whatever the corpus.

* Every task sends one row for each language and n-gram it met, with its trusted counts;
  summed, they are both the training counts and the questions.
* Lower orders count distinct left extensions, discounts come from the counts of counts,
  and the probabilities of all n-grams met are found order by order by joins of sharded
  tables: n-gram counts, context sums, and the order below.
* A document's perplexity sums those over its n-grams.  The finished table is counted:
  up to ``TABLE_ROWS`` rows it is broadcast, and no text is shuffled; beyond, documents'
  n-gram counts are joined with it by shards, with the same result.
* ``perplexity`` is drawn to the language's mean by ``PRIOR`` characters, for a few
  words say little; a document is rejected above its language's threshold, the ``QUANTILE``
  of the language's trusted documents, each scored by the model that has not seen it.

Cases: null or empty text has no n-grams and is kept; a language without trusted text
has no model, and its documents are kept with a null perplexity; one whose trusted
documents are all in one fold has no threshold, and its documents are kept; a null language
is one of its own; without labels nothing is rejected; rows are judged one by one, so
repeated ids may have different verdicts, and equal rows (ties) have equal ones; a text at
the threshold is kept; extra columns of ``documents`` or ``labels`` are not read.  A
task holds one text of any length, in about 60 times its size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, POSITION_KEYS, cut, lean, mix, slices, tidy

ORDER = 5
FOLDS = 2
PRIOR = 60.0  # characters of the language's mean added to each document
QUANTILE = 0.99  # of trusted documents
TABLE_ROWS = 4_000_000
START = "\x02"
MET_BYTES = 1 << 21  # bytes of text whose n-grams are put together before they are sent
MODELS = range(FOLDS)


def lang_key(lang: str | None) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b((lang or "").encode(), digest_size=8).digest(), "little"))


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the rows, ``ORDER - 1`` starts before each; the first position of
    every n-gram; n-grams of each row.  Digits are one character."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = chars[offs]
    n = np.diff(at)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
    pad = ORDER - 1
    out = np.full(len(codes) + pad * len(n), ord(START), np.uint32)
    kind = np.int32 if len(out) < 1 << 31 else np.int64
    place = np.arange(len(codes), dtype=kind) + np.repeat(np.arange(1, len(n) + 1, dtype=kind) * kind(pad), n)
    out[place] = codes
    return out, place - kind(pad), n


def gram_hash(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    h = np.zeros(len(first), np.uint64)
    for k in range(ORDER):
        h += (codes[first + k].astype(np.uint64) + np.uint64(7)) * POSITION_KEYS[k]
    return mix(h)


def strings(codes: np.ndarray, first: np.ndarray) -> pa.Array:
    """The n-grams as an Arrow column, straight from their UTF-8 bytes."""
    chars = np.stack([codes[first + k] for k in range(ORDER)], axis=1)
    data = chars.astype("<u4", copy=False).tobytes().decode("utf-32-le", "replace").encode()
    size = ORDER + ((chars >= 0x80).sum(axis=1) + (chars >= 0x800).sum(axis=1) + (chars >= 0x10000).sum(axis=1))
    offs = np.zeros(len(first) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offs), pa.py_buffer(data))


def met(docs: DataFrame) -> DataFrame:
    """lang, g, c0, c1...: every n-gram, and its count for each model: in the rows that
    have a ``fold`` which isn't the model's."""

    def counted(langs, fold, raw, offs):
        codes, first, n = grams(raw, offs)
        own, names = pd.factorize(langs)
        lang, trains = np.repeat(own.astype(np.int32), n), np.repeat(fold, n)
        h = gram_hash(codes, first)
        for k, name in enumerate(names):
            mine = np.flatnonzero(lang == k) if len(names) > 1 else np.arange(len(h))
            code, types = pd.factorize(h[mine])
            one = np.empty(len(types), np.int64)
            one[code[::-1]] = mine[::-1]
            use = trains[mine]
            c = [np.bincount(code[(use >= 0) & (use != m)], minlength=len(types)) for m in MODELS]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(types), pa.string()), strings(codes, first[one]), *[pa.array(x, pa.int64()) for x in c]], names=["lang", "g", *[f"c{m}" for m in MODELS]])

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, raw, offs in slices(batch.column("text"), MET_BYTES):
                yield from counted(langs[a:b], fold[a:b], raw, offs)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.col("fold").cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(lean(run), "lang string, g string, " + ", ".join(f"c{m} long" for m in MODELS))
    return made.groupBy("lang", "g").agg(*[F.sum(f"c{m}").alias(f"c{m}") for m in MODELS])


def discounts(types: DataFrame) -> dict[str, list[float]]:
    """Of one order, for each language: what each model takes from counts of 1, 2 and more."""
    out = {}
    for r in types.groupBy("lang").agg(*[F.count(F.when(F.col(f"c{m}") == i, 1)).alias(f"n{i}_{m}") for m in MODELS for i in (1, 2, 3, 4)]).collect():
        out[r["lang"]] = []
        for m in MODELS:
            n = [None, *[r[f"n{i}_{m}"] for i in (1, 2, 3, 4)]]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            out[r["lang"]] += [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]
    return out


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, g, logp0, logp1... (natural, for each model) of every n-gram in ``counts`` (lang, g,
    c0, c1...) whose language has trusted text; null where the model has none."""
    have = lambda m: F.count(F.when(F.col(f"c{m}") > 0, 1))
    types = {ORDER: counts.where(" or ".join(f"c{m} > 0" for m in MODELS))}
    for k in range(ORDER - 1, 0, -1):
        types[k] = cut(types[k + 1].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(*[have(m).alias(f"c{m}") for m in MODELS]))
    asked = {ORDER: counts.select("lang", "g").join(F.broadcast(types[1].select("lang").distinct()), "lang", "left_semi")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select("lang", F.substring("g", 2, k).alias("g")).distinct()
    spark = counts.sparkSession
    below = None
    for k in range(1, ORDER + 1):
        d = discounts(types[k])
        small = F.broadcast(spark.createDataFrame([(x, *v) for x, v in d.items()], "lang string, " + ", ".join(f"d{i}_{m} double" for m in MODELS for i in (1, 2, 3))))
        sums = [f(m) for m in MODELS for f in (lambda m: F.sum(f"c{m}").alias(f"total_{m}"), lambda m: have(m).alias(f"kinds_{m}"), *[lambda m, i=i: F.count(F.when(F.col(f"c{m}") == i, 1)).alias(f"n{i}_{m}") for i in (1, 2)])]
        context = types[k].groupBy("lang", F.substring("g", 1, k - 1).alias("h")).agg(*sums)
        rows = asked[k].withColumn("h", F.substring("g", 1, k - 1)).join(types[k], ["lang", "g"], "left").join(context, ["lang", "h"], "left").join(small, "lang")
        if below is None:
            size = types[1].groupBy("lang").agg(*[F.when(have(m) > 0, 1.0 / (have(m) + 1)).alias(f"q{m}") for m in MODELS])
            rows = rows.join(F.broadcast(size), "lang")
        else:
            lower = below.select("lang", F.col("g").alias("s"), *[F.col(f"p{m}").alias(f"q{m}") for m in MODELS])
            rows = rows.withColumn("s", F.substring("g", 2, k - 1)).join(lower, ["lang", "s"])
        below = rows.select("lang", "g", *[_smoothed(m).alias(f"p{m}") for m in MODELS])
        below = cut(below) if k > 2 else below
    return below.select("lang", "g", *[F.log(f"p{m}").alias(f"logp{m}") for m in MODELS])


def _smoothed(m: int):
    """Model m's probability, from its counts and that of the order below."""
    c, d, n, total = F.col(f"c{m}"), lambda i: F.col(f"d{i}_{m}"), lambda i: F.col(f"n{i}_{m}"), F.col(f"total_{m}")
    cost = F.when(c == 1, d(1)).when(c == 2, d(2)).otherwise(d(3))
    own = F.when(c > 0, F.greatest(c - cost, F.lit(0.0))).otherwise(0.0)
    spare = d(1) * n(1) + d(2) * n(2) + d(3) * (F.col(f"kinds_{m}") - n(1) - n(2))
    return F.when(total > 0, (own + spare * F.col(f"q{m}")) / total).otherwise(F.col(f"q{m}"))


def scored(docs: DataFrame, table: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` (doc_id, lang, text, fold, more) without text, with n and nll: of its fold's
    model, or the mean of all that its language has; null if there is none."""
    rest = [c for c in docs.columns if c != "text"]
    small = table.limit(table_rows + 1).count() <= table_rows
    out = (_looked_up if small else _joined)(docs.withColumn("fold", F.col("fold").cast("int")), table, rest)
    every = sum((F.coalesce(F.col(f"nll{m}"), F.lit(0.0)) for m in MODELS), F.lit(0.0))
    some = sum((F.col(f"nll{m}").isNotNull().cast("int") for m in MODELS), F.lit(0))
    own = F.coalesce(*[F.when(F.col("fold") == m, F.col(f"nll{m}")) for m in MODELS])
    nll = F.when(F.col("fold").isNotNull(), own).otherwise(F.when(some > 0, every / F.greatest(some, F.lit(1))))
    return out.select(*rest, "n", nll.alias("nll"))


def _looked_up(docs: DataFrame, table: DataFrame, rest: list[str]) -> DataFrame:
    """With n and each model's nll, from the broadcast table."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")

    def keyed(batches):
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            codes = np.frombuffer("".join(batch.column("g").to_pylist()).encode("utf-32-le"), np.uint32)
            key = gram_hash(codes, np.arange(batch.num_rows) * ORDER) ^ np.array([lang_key(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[batch.column(f"logp{m}") for m in MODELS]], names=["key", *[f"logp{m}" for m in MODELS]])

    known = {r["lang"]: [r[f"logp{m}"] > 0 for m in MODELS] for r in table.groupBy("lang").agg(*[F.count(f"logp{m}").alias(f"logp{m}") for m in MODELS]).collect()}
    got = table.mapInArrow(lean(keyed), "key long, " + ", ".join(f"logp{m} double" for m in MODELS)).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], [np.nan_to_num(got.column(f"logp{m}").fill_null(0.0).to_numpy()[order]) for m in MODELS], known))
    del got, keys, order
    tidy(docs.sparkSession)

    def sums(langs, raw, offs, keys, logs):
        codes, first, n = grams(raw, offs)
        code, types = pd.factorize(gram_hash(codes, first) ^ np.repeat(np.array([lang_key(x) for x in langs], np.uint64), n))
        ends = np.cumsum(n)
        at = np.minimum(np.searchsorted(keys, types), max(0, len(keys) - 1))
        out = []
        for m in MODELS:
            v = np.where(keys[at] == types, logs[m][at], 0.0) if len(keys) else np.zeros(len(types))
            s = np.concatenate([[0.0], np.cumsum(v[code])])
            out.append(s[ends - n] - s[ends])
        return n, out

    def run(batches):
        keys, logs, known = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            nll, count = [[] for _ in MODELS], []
            for a, b, raw, offs in slices(batch.column("text")):
                n, total = sums(langs[a:b], raw, offs, keys, logs)
                for m in MODELS:
                    nll[m] += [x if known.get(lang or "", [False] * FOLDS)[m] else None for x, lang in zip(total[m].tolist(), langs[a:b], strict=True)]
                count.append(n)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(np.concatenate(count) if count else [], pa.int64()), *[pa.array(x, pa.float64()) for x in nll]], names=[*rest, "n", *[f"nll{m}" for m in MODELS]]
            )

    return docs.mapInArrow(lean(run), kinds + ", n long, " + ", ".join(f"nll{m} double" for m in MODELS))


def _joined(docs: DataFrame, table: DataFrame, rest: list[str]) -> DataFrame:
    """The same by a join of the documents' n-grams with the table.

    Rows of equal id, language and text have one key; their n-grams are summed together,
    and divided by how many they are."""
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    docs = docs.withColumn("row_key", key)

    def ask(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            ids = batch.column("row_key")
            for a, b, raw, offs in slices(batch.column("text")):
                codes, first, n = grams(raw, offs)
                row = np.repeat(np.arange(a, b), n)
                code, _ = pd.factorize(gram_hash(codes, first) ^ mix(row.astype(np.uint64)))
                one = np.empty(code.max() + 1 if len(code) else 0, np.int64)
                one[code[::-1]] = np.arange(len(code))[::-1]
                r = row[one]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array([langs[i] or "" for i in r], pa.string()), strings(codes, first[one]), pa.array(np.bincount(code), pa.int64())], names=["row_key", "lang", "g", "times"])

    asked = docs.select("row_key", "lang", "text").mapInArrow(lean(ask), "row_key string, lang string, g string, times long")
    nll = [(-F.sum(F.col("times") * F.col(f"logp{m}"))).alias(f"nll{m}") for m in MODELS]
    sums = asked.join(table.hint("shuffle_hash"), ["lang", "g"], "left").groupBy("row_key").agg(F.sum("times").alias("n"), *nll)
    sums = sums.join(docs.groupBy("row_key").agg(F.count("*").alias("copies")), "row_key")
    sums = sums.select("row_key", (F.col("n") / F.col("copies")).cast("long").alias("n"), *[(F.col(f"nll{m}") / F.col("copies")).alias(f"nll{m}") for m in MODELS])
    out = docs.drop("text").join(sums, "row_key", "left")
    have = table.groupBy(F.col("lang").alias("l")).agg(*[(F.count(f"logp{m}") > 0).alias(f"k{m}") for m in MODELS])
    out = out.join(F.broadcast(have), F.coalesce("lang", F.lit("")) == F.col("l"), "left")
    return out.select(*rest, F.coalesce("n", F.lit(0)).alias("n"), *[F.when(F.col(f"k{m}"), F.coalesce(f"nll{m}", F.lit(0.0))).alias(f"nll{m}") for m in MODELS])


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior: float = PRIOR, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, lang, n_chars (scored), perplexity, threshold, kept for each row."""
    trusted = trusted_ids(labels).withColumn("trusted", F.lit(True))
    small = trusted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(trusted) if small else trusted, "doc_id", "left")
    fold = F.when(F.col("trusted"), (F.crc32(F.coalesce("text", F.lit(""))) % FOLDS).cast("int"))
    rows = rows.select("doc_id", "lang", "text", fold.alias("fold"))
    counts = cut(met(rows))
    tidy(docs.sparkSession)
    table = cut(probabilities(counts))
    tidy(docs.sparkSession)
    got = cut(scored(rows, table, table_rows).withColumn("l", F.coalesce("lang", F.lit(""))))
    ours = got.where("fold is not null and nll is not null and n > 0")
    means = F.broadcast(ours.groupBy("l").agg((F.sum("nll") / F.sum("n")).alias("mean")))
    drawn = (F.col("nll") + prior * F.col("mean")) / (F.col("n") + prior)
    limits = ours.join(means, "l").groupBy("l").agg(F.percentile_approx(drawn, quantile, 10_000).alias("limit"))
    out = got.join(means, "l", "left").join(F.broadcast(limits), "l", "left").withColumn("x", drawn)
    kept = F.coalesce(F.col("x") <= F.col("limit"), F.lit(True)) | (F.col("n") == 0)
    return out.select("doc_id", "lang", F.col("n").alias("n_chars"), F.exp("x").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))
