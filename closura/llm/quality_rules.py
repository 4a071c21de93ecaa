"""Quality rules as robust multivariate outliers (operator 10).

Counts of each whole text are taken, transformed, and compared with the robust
centre and scatter of the text's language and source: the minimum covariance
determinant (Rousseeuw & Van Driessen 1999).  Concentration steps begin at the
deterministic ``STARTS`` (Hubert, Rousseeuw & Verdonck 2012); after two steps each group
goes on from the start of least determinant, until that falls no more.  The scatter of the
kept rows is made consistent, and both estimates are taken anew from all rows within the
chi-squared quantile ``REWEIGHT``.  A text is rejected beyond the quantile ``LEVEL``.

A step is two aggregations over all groups and starts at once: the h-quantile of the
distances under the present estimates by a sketch, then sums and cross products of
the rows below it, which Spark adds up in each task before any shuffle.  A group is never
gathered; a row for each group and start comes to the driver.

Cases: null text counts as empty; null language or source is a group of its own;
a group of fewer than ``min_group`` rows uses the estimate over all rows, and a statistic of
little spread has that of ``FLOOR``; a text at the quantile (a tie) is kept; an empty table
gives an empty result; extra columns are not read, whatever their names; each row is judged by its own
text, also where ids repeat or are missing.  A task holds one text of any length, in about
40 times its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, Words, cut, lean, slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True  # [#*$%&|<>]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STARTS = ("scale", "tanh", "sign", "near")  # see ``first_estimates``
TRIED = 2  # concentration steps from every start
STEPS = 20  # concentration steps at most
SHARE = 0.75  # rows that a step keeps
NEAR = 0.5  # rows that the first step of ``near`` keeps
REWEIGHT = 0.975
LEVEL = 1 - 1e-7  # counts have longer tails than the normal distribution
MIN_GROUP = 50


def dup_lines(raw: np.ndarray, words: Words, offs: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    out = np.zeros(len(offs) - 1, np.int64)
    new = np.flatnonzero(raw == 10)
    rows_with = np.unique(np.searchsorted(offs, new, "right") - 1)
    for r in rows_with:
        lines = raw[offs[r] : offs[r + 1]].tobytes().split(b"\n")
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                out[r] += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    return out


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for a, b, raw, offs in slices(column):
        w = Words(raw, offs)
        n = b - a
        chars = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~WHITE[raw])])
        syms = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])
        at, h = w.windows(5)
        again = np.zeros(len(w.row) + 1, np.int64)
        if len(at):
            key = h ^ (w.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            np.add.at(again, at[twice], 1)
            np.add.at(again, at[twice] + 5, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(again)[:-1] > 0)])
        got["n_words"].append(np.diff(w.first))
        got["word_chars"].append(chars[offs[1:]] - chars[offs[:-1]])
        got["n_symbols"].append(syms[offs[1:]] - syms[offs[:-1]])
        got["n_dup_lines"].append(dup_lines(raw, w, offs))
        got["n_repeat_words"].append(covered[w.first[1:]] - covered[w.first[:-1]])
        assert len(got["n_words"][-1]) == n
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in got.items()}


def text_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and COUNTS for each row."""

    def run(batches):
        for batch in batches:
            c = count_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(c[k], pa.int64()) for k in COUNTS], names=[*keep, *COUNTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"{kinds}, " + ", ".join(f"{k} long" for k in COUNTS))


def features() -> list[Column]:
    """Transformed statistics: near symmetric for ordinary text."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 5.0) / (F.col("n_words") + 1.0)),
        F.log1p(100.0 * F.col("n_symbols") / words),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(100.0 * F.col("n_repeat_words") / words),
    ]


#: Least standard deviations: a statistic that hardly varies in a group is not
#: allowed to make every small difference an outlier.
FLOOR = np.array([0.5, 0.08, 0.35, 0.35, 0.5])


def chi2_cdf(x: float, p: int) -> float:
    """Of the chi-squared distribution, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = math.exp(-x / 2 + p / 2 * math.log(x / 2) - math.lgamma(p / 2 + 1))
    n = 1
    while term > 1e-17 * total:
        term *= x / 2 / (p / 2 + n)
        total += term
        n += 1
    return min(1.0, total)


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistent(share: float, p: int) -> float:
    """What makes the scatter of the nearest ``share`` of normal rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def floored(cov: np.ndarray) -> np.ndarray:
    """The scatter, its diagonal raised to FLOOR."""
    return cov + np.diag(np.maximum(0.0, FLOOR**2 - np.diag(cov)) + 1e-9)


def symmetric(r, prefix: str) -> np.ndarray:
    """The matrix of the columns ``prefix``i_j of a row."""
    p = len(FLOOR)
    return np.array([[r[f"{prefix}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])


def upper():
    p = len(FLOOR)
    return [(i, j) for i in range(p) for j in range(i, p)]


def beside(rows: DataFrame, state: dict[tuple, dict[str, tuple]], by: list[str], schema: str, how: str = "inner") -> DataFrame:
    """Each row once for every entry (start -> values of ``schema``) of its group's state: a
    small table, joined by the group, or written into the plan if there is one group."""
    spark = rows.sparkSession
    if not by:
        entries = spark.createDataFrame([(k, *v) for k, v in state[()].items()], f"start string, {schema}").collect() if () in state else []
        lit = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
        return rows.select("*", F.inline(F.array(*[F.struct(*[lit(r[c]).alias(c) for c in r.asDict()]) for r in entries])))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ", ".join([*(f"e_{k} {kinds[k]}" for k in by), "start string", schema])
    table = spark.createDataFrame([(*group, k, *v) for group, some in state.items() for k, v in some.items()], names)
    cond = [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in by]
    return rows.join(F.broadcast(table), cond, how).drop(*[f"e_{k}" for k in by])


def distances(rows: DataFrame, est: dict, by: list[str], limits: dict | None = None, how: str = "inner") -> DataFrame:
    """``d2``, the squared Mahalanobis distance, for each estimate of the row's group, and
    its ``most``, if there are limits."""
    p = len(FLOOR)
    inverse = lambda c: np.linalg.inv(floored(c)).ravel().tolist()
    state = {g: {k: (m.tolist(), inverse(c), limits[g, k] if limits else None) for k, (m, c) in some.items()} for g, some in est.items()}
    d = [F.col(f"x{i}") - F.col("m")[i] for i in range(p)]
    terms = [F.col("w")[i * p + j] * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in upper()]
    out = beside(rows, state, by, "m array<double>, w array<double>, most double", how)
    return out.withColumn("d2", sum(terms[1:], terms[0])).drop("m", "w")


def estimates(rows: DataFrame, by: list[str]) -> dict:
    """Mean and covariance for each group and start."""
    p = len(FLOOR)
    x = [F.col(f"x{i}") for i in range(p)]
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in upper()]
    out: dict = {}
    for r in rows.groupBy(*by, "start").agg(*sums).collect():
        out.setdefault(tuple(r[k] for k in by), {})[r["start"]] = (np.array([r[f"m{i}"] for i in range(p)]), symmetric(r, "c"))
    return out


def quantiles(rows: DataFrame, by: list[str], shares: dict[str, float]) -> dict:
    """Of ``d2``, for each group and start, that of the start's share."""
    every = sorted(set(shares.values()))
    got = rows.groupBy(*by, "start").agg(F.percentile_approx("d2", every, 1000).alias("q")).collect()
    return {(tuple(r[k] for k in by), r["start"]): r["q"][every.index(shares[r["start"]])] for r in got}


def first_estimates(rows: DataFrame, by: list[str], min_group: int) -> tuple[dict, dict[tuple, int]]:
    """For each group of ``min_group`` rows the starts, all with the medians as centre, and the
    quartiles' distance as scale: that alone; with the correlation of hyperbolic tangents of
    the standardised values; with that of their spatial signs; and again alone, to begin with
    the nearest half.  Also, the size of every group."""
    p = len(FLOOR)
    agg = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(p)]
    sizes, mid = {}, {}
    for r in rows.groupBy(*by).agg(F.count("*").alias("n"), *agg).collect():
        group, q = tuple(r[k] for k in by), np.array([r[f"q{i}"] or [0.0] * 3 for i in range(p)], float)
        sizes[group] = r["n"]
        if r["n"] and r["n"] >= min_group:
            mid[group] = (q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR))
    if not mid:
        return {}, sizes
    own = beside(rows, {g: {"": (m.tolist(), s.tolist())} for g, (m, s) in mid.items()}, by, "m array<double>, s array<double>")
    z = own.select(*by, *[((F.col(f"x{i}") - F.col("m")[i]) / F.col("s")[i]).alias(f"z{i}") for i in range(p)])
    z = z.withColumn("norm", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0"))), F.lit(1e-9)))
    tanh, sign = (lambda i: F.tanh(f"z{i}")), (lambda i: F.col(f"z{i}") / F.col("norm"))
    both = z.groupBy(*by).agg(*[F.covar_pop(tanh(i), tanh(j)).alias(f"t{i}_{j}") for i, j in upper()], *[F.avg(sign(i) * sign(j)).alias(f"u{i}_{j}") for i, j in upper()])
    out = {}
    for r in both.collect():
        m, scale = mid[tuple(r[k] for k in by)]
        plain = np.diag(scale**2)
        some = {"scale": (m, plain), "near": (m, plain)}
        for name, prefix in (("tanh", "t"), ("sign", "u")):
            c = symmetric(r, prefix)
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            some[name] = (m, 0.99 * c / np.outer(d, d) * np.outer(scale, scale) + 0.01 * plain)
        out[tuple(r[k] for k in by)] = {k: some[k] for k in STARTS}
    return out, sizes


def mcd(rows: DataFrame, by: list[str], share: float = SHARE, min_group: int = MIN_GROUP) -> tuple[dict, dict[tuple, int]]:
    """Robust mean and scatter for each group of ``by`` that has ``min_group`` rows, and the
    sizes of all groups."""
    p = len(FLOOR)
    est, sizes = first_estimates(rows, by, min_group)
    if not est:
        return {}, sizes

    def step(est: dict, shares: dict[str, float]) -> dict:
        limits = quantiles(distances(rows, est, by), by, shares)
        return estimates(distances(rows, est, by, limits).where("d2 <= most"), by)

    det = lambda x: np.linalg.slogdet(floored(x[1]))[1]
    plain = dict.fromkeys(STARTS, share)
    for k in range(TRIED):
        est = step(est, plain | ({"near": NEAR} if not k else {}))
    best = {g: min(some.items(), key=lambda x: (det(x[1]), x[0])) for g, some in est.items()}
    going = {g: {k: x} for g, (k, x) in best.items()}
    for _ in range(STEPS - TRIED):
        more = {g: next(iter(some.items())) for g, some in step(going, plain).items()}
        going = {g: {k: x} for g, (k, x) in more.items() if det(x) < det(best[g][1]) - 1e-6}
        best |= {g: more[g] for g in going}
        if not going:
            break
    raw = {g: {"": (m, c * consistent(share, p))} for g, (_, (m, c)) in best.items()}
    limits = {(g, ""): chi2_quantile(REWEIGHT, p) for g in raw}
    last = estimates(distances(rows, raw, by, limits).where("d2 <= most"), by)
    return {g: (x[""][0], x[""][1] * consistent(REWEIGHT, p)) for g, x in (raw | last).items()}, sizes


def judge(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), level: float = LEVEL, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, COUNTS, base_failed, d2, kept for each row of ``docs``."""
    by = list(by)
    counted = text_counts(docs, ("doc_id", *by))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = cut(counted.withColumn("base_failed", base).select("*", *[f.alias(f"x{i}") for i, f in enumerate(features())]))
    sound = counted.where(~F.col("base_failed"))
    est, sizes = mcd(sound, by, min_group=min_group)
    if not sizes:
        return counted.select("doc_id", *COUNTS, "base_failed", F.lit(None).cast("double").alias("d2"), (~F.col("base_failed")).alias("kept"))
    if any(n < min_group for n in sizes.values()):
        whole, _ = mcd(sound, [], min_group=1)
        est |= {g: whole[()] for g, n in sizes.items() if n < min_group}
    out = distances(counted, {g: {"": x} for g, x in est.items()}, by, how="left")
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(level, len(FLOOR)))
    return out.select("doc_id", *COUNTS, "base_failed", "d2", kept.alias("kept"))
