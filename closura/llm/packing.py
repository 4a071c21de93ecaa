"""Packing documents into sequences by the configuration linear program (operator 7).

A document is its token ids and an end id; one longer than a sequence is cut into
whole sequences and a rest.  The histogram of piece lengths (at most ``size`` numbers,
whatever the corpus) goes to the driver, where the program "fewest patterns that cover
every length" is solved by multiplicative weights: patterns' uses are weights, lengths have
prices, and knapsack tables over the capacity find the patterns that pay at these prices.
Uses are fractions, and the prices bound what any packing needs (``fractional``).  They are
rounded down, which leaves at most a sequence for each pattern in use, whatever the corpus; the
pieces left are packed by whole patterns or by best fit.  The plan (a row for each
length in each pattern) is bounded by the histogram, not the corpus.

Pieces take places by their rank among those of their length.  Ranks are counted in
salted groups of about ``GROUP`` rows, so no length gathers in one task.

Cases: null text is one piece, the end id; an empty table packs to nothing; repeated
rows are packed as often as they come; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LEAVING, cut, lean, texts

SIZE = 4096
END = 1
GROUP = 2_000
TABLES = 40  # knapsack tables of the program
SWEEPS = 150  # changes of all prices between two tables
HEAT, COOLING, COLDEST = 0.06, 0.7, 0.0005  # of the patterns' weights
NEAR = 0.001  # the program's value over its bound
WORDS_KEPT = 300_000  # words whose ids a worker remembers
CLASSES = (2, 0)  # lengths over size / 2 are covered first, then the others

#: Letters of Latin-1 in lower case (fixed values); the other ranges of SAFE leave out
#: digits that aren't 0-9 and what other libraries class differently.
LETTERS = "a-zªµºß-öø-ÿ"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
UNSAFE = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-ÿ]|<\\|")


class Encoder:
    """Ids as little-endian 32-bit bytes.

    In this tokenizer words are encoded one by one, so the ids of each are remembered.
    Texts outside Latin-1, or with the brackets of special tokens, go to the library
    whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, strings: list[str]) -> list[bytes]:
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in batch(strings, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """All words in one text; a token with the word-end mark closes each."""
        ids = np.frombuffer(self._ids([" ".join(words)])[0], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            raw, at = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *at], at)), strict=False))
        else:
            self.known.update(zip(words, self._ids(words), strict=True))

    def encode(self, strings: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        words: list = [None if UNSAFE.search(t) else WORD.findall(t.lower()) for t in strings]
        new = list(set().union(*filter(None, words)).difference(known))
        for a in range(0, len(new), 10_000):
            self._learn(new[a : a + 10_000])
        look = known.__getitem__
        return [self._ids([t])[0] if ws is None else b"".join(map(look, ws)) for t, ws in zip(strings, words, strict=True)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


LEAVING.append(encoder.cache_clear)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian
    32-bit, as binary)."""

    def run(batches):
        enc, stop = encoder(path), np.array([end], "<u4").tobytes()
        kinds = {"row": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
        for batch in batches:
            column = texts(batch.column("text"))
            step = 256
            for a in range(0, len(column), step):
                cols: dict[str, list] = {k: [] for k in kinds}
                for r, got in enumerate(enc.encode(column.slice(a, step).to_pylist()), a):
                    ids = got + stop
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        for name, v in zip(kinds, (r, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            cols[name].append(v)
                arrays = [pa.array(cols[k], kinds[k]) for k in kinds]
                names = list(kinds)[1:] if with_ids else list(kinds)[1:-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(arrays[0]), *arrays[1 : 1 + len(names)]], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Prices:
    """Knapsack tables: the most valuable patterns when value[l] is the price of length l.

    A length is used up to have[l] times: its copies are bundled by 1, 2, 4 and so on.
    Bundles are taken in order of length and a later one wins ties, so equal prices
    favour long lengths."""

    def __init__(self, value: np.ndarray, have: np.ndarray):
        size = len(value) - 1
        self.bundles: list[tuple[int, int]] = []
        for l in np.flatnonzero((value > 0) & (have > 0)).tolist():
            times, k = min(int(have[l]), size // l), 1
            while times > 0:
                self.bundles.append((l, min(k, times)))
                times -= k
                k *= 2
        self.takes = np.zeros((len(self.bundles), size + 1), bool)
        best = np.zeros(size + 1)
        for i, (l, k) in enumerate(self.bundles):
            total = best[: size + 1 - l * k] + k * value[l]
            # by 1e-9 less is a tie
            np.greater_equal(total, best[l * k :] - 1e-9, out=self.takes[i, l * k :])
            np.maximum(best[l * k :], total, out=best[l * k :])

    def pattern(self, i: int, room: int) -> dict[int, int]:
        """Length -> times, of the best pattern of ``room`` from the first i bundles."""
        out: dict[int, int] = {}
        while i > 0 and room > 0:
            column = self.takes[i - 1 :: -1, room] if i < len(self.takes) else self.takes[::-1, room]
            back = int(column.argmax())
            if not column[back]:
                break
            i -= back + 1
            l, k = self.bundles[i]
            out[l] = out.get(l, 0) + k
            room -= l * k
        return out

    def patterns(self, floor: int = 0):
        """For each length over ``floor``, longest first, the best pattern in which it is
        the longest: with one of it, and with as many as pay."""
        size = self.takes.shape[1] - 1
        for i in range(len(self.bundles) - 1, -1, -1):
            l, k = self.bundles[i]
            if l <= floor:
                return
            if k == 1 and (not i or self.bundles[i - 1][0] != l):
                more = i + 1  # bundles of l itself come first, then shorter ones
                while more < len(self.bundles) and self.bundles[more][0] == l:
                    more += 1
                p = {l: 1}
                for x, a in self.pattern(i, size - l).items():
                    p[x] = p.get(x, 0) + a
                yield p
                if more > i + 1:
                    yield self.pattern(more, size)


def solve(have: np.ndarray, rounds: int | None = None, rate: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; have[l] pieces of length l, all packed: the
    program's, or best fit's should those be fewer sequences."""
    return min(program(have, rounds, rate), best_fit(have), key=lambda plan: sum(times for _, times in plan))


class Fractional(NamedTuple):
    patterns: list[dict[int, int]]
    uses: np.ndarray  # of each pattern, fractions too
    value: float  # sequences that cover all pieces if patterns may be used in part
    bound: float  # no packing has fewer


def fractional(have: np.ndarray, tables: int = TABLES, sweeps: int = SWEEPS) -> Fractional:
    """The configuration program's fractional solution, by multiplicative weights.

    A length has a price, at first its share of a sequence.  A pattern's weight, the number
    of its uses, is multiplied by exp(change of its price / heat).  In a sweep each length's price
    goes up by the logarithm of what is asked over what is covered, so patterns of what is
    lacking gain weight and those of what is there twice lose it.  After ``sweeps`` the prices go to the
    knapsack, whose patterns of a price over 1 join, and the heat falls.  With the dearest
    pattern's price as divisor, prices are a solution of the dual program and so a bound for
    every packing; it ends when the value is within ``NEAR`` of the best bound.

    What stays uncovered counts in ``value`` as patterns of its length alone."""
    size = len(have) - 1
    asked = have.astype(np.float64)
    asked[0] = 0
    lengths, live = np.arange(size + 1), asked > 0
    if not live.any():
        return Fractional([], np.zeros(0), 0.0, 0.0)
    alone = size // np.maximum(1, lengths)
    price = np.where(live, lengths / size, 0.0)
    found: dict[tuple, None] = {}
    best, bound, heat = None, 0.0, HEAT
    for _ in range(tables):
        top = 0.0
        for p in Prices(price, alone * live).patterns():
            worth = sum(price[l] * a for l, a in p.items())
            top = max(top, worth)
            key = tuple(sorted(p.items()))
            if worth > 1 or best is None:
                found[key] = None
        bound = max(bound, float(asked @ price) / top)
        if best is not None and best[0] <= (1 + NEAR) * bound:
            break
        l, a = np.array([x for key in found for x in key]).T
        c = np.repeat(np.arange(len(found)), [len(key) for key in found])
        n = np.bincount(c, a)
        start = np.log(asked.sum() / len(found))
        for _ in range(sweeps):
            uses = np.exp(np.minimum((np.bincount(c, a * price[l]) - 1) / heat, 50) + start)
            covered = np.maximum(np.bincount(l, a * uses[c], size + 1), 1e-300)
            shared = np.maximum(np.bincount(l, a * (n * uses)[c], size + 1), 1e-300)
            # divided by a pattern's pieces, for the prices of all of them change at once
            step = heat * np.log(np.maximum(asked, 1e-300) / covered) * covered / shared
            price = np.where(live, np.maximum(0, price + step), 0)
        value = float(uses.sum() + (np.maximum(0, asked - covered)[live] / alone[live]).sum())
        if best is None or value < best[0]:
            best = value, uses, list(found)
        heat = max(COLDEST, heat * COOLING)
    value, uses, keys = best
    return Fractional([dict(key) for key in keys], uses, value, bound)


def program(have: np.ndarray, rounds: int | None = None, rate: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """The configuration program's plan for all pieces: its fractional solution's uses,
    rounded down, and what that leaves by ``leftover`` (as it takes ``rounds`` and ``rate``)
    or ``best_fit``."""
    left = have.astype(np.int64).copy()
    left[0] = 0
    solution = fractional(left)
    plan: list[tuple[dict[int, int], int]] = []
    for i in np.argsort(-solution.uses, kind="stable").tolist():
        p = solution.patterns[i]
        # uses may cover a bit more than there is
        times = min(int(solution.uses[i]), *(int(left[l]) // a for l, a in p.items()))
        if times:
            plan.append((p, times))
            for l, a in p.items():
                left[l] -= a * times
    return plan + min(leftover(left, rounds, rate), best_fit(left), key=lambda rest: sum(times for _, times in rest))


def leftover(have: np.ndarray, rounds: int | None = None, rate: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """Whole patterns for the pieces that rounding leaves.

    A length's weight is exp(-rate * its covered share).  Each table prices every length
    that isn't covered yet; its patterns are used as often as there are pieces for them,
    so one length at least is covered by each and nothing is scaled or rounded at the end.
    Lengths over a half of ``size`` are covered first, for each needs a pattern of its
    own, then the others.  Full patterns come first, under the weights
    for ``rounds`` tables (as many as there are lengths if not given), then by tokens
    alone; when there are none, those with the least room to spare."""
    size = len(have) - 1
    left = have.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[dict[int, int], int]] = []
    if left[size]:
        plan.append(({size: 1}, int(left[size])))
        left[size] = 0
    lengths = np.arange(size + 1)
    total = np.maximum(1, left)
    rounds = int((left > 0).sum()) if rounds is None else rounds
    tables = 0
    for part in CLASSES:
        floor = size // part if part else 0
        full, weighted = True, True
        while left[floor + 1 :].any():
            weighted = weighted and tables < rounds
            weights = np.exp(-rate * (1 - left / total)) if weighted else np.ones(size + 1)
            placed = False
            for p in Prices(lengths * weights * (left > 0), left).patterns(floor):
                times = min(int(left[l]) // a for l, a in p.items())
                if times and (not full or sum(l * a for l, a in p.items()) == size):
                    plan.append((p, times))
                    for l, a in p.items():
                        left[l] -= a * times
                    placed = True
                elif not full:
                    break  # its pieces went to longer lengths: it is priced anew
            tables += 1
            if not placed:
                full, weighted = full and weighted, False
    return plan


def best_fit(left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """The longest piece left, then always the best filling of the room that the
    pieces left allow, as often as there are pieces for it."""
    left = left.copy()
    plan = []
    size = len(left) - 1
    top = size
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return plan
        p: dict[int, int] = {top: 1}
        left[top] -= 1
        room = size - top
        for l in filling(left, room):
            p[l] = p.get(l, 0) + 1
        for l, a in p.items():
            left[l] -= a - (l == top)
        more = min(left[l] // a for l, a in p.items())
        for l, a in p.items():
            left[l] -= a * more
        plan.append((p, int(more) + 1))


def filling(left: np.ndarray, room: int) -> list[int]:
    """Pieces that fill ``room`` best: one that fits exactly, else two, else the
    longest and so on."""
    out: list[int] = []
    while room > 0:
        fit = np.flatnonzero(left[: room + 1])
        if not len(fit):
            break
        if fit[-1] == room:
            return [*out, room]
        other = room - fit
        pair = np.flatnonzero((left[other] > 0) & ((other != fit) | (left[fit] > 1)))
        if len(pair):
            a = int(fit[pair[-1]])
            return [*out, a, room - a]
        a = int(fit[-1])
        left = left.copy()
        left[a] -= 1
        out.append(a)
        room -= a
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        at = 0
        for l in sorted(pattern, reverse=True):
            for _ in range(pattern[l]):
                rows.append((l, used.get(l, 0), sequence, at))
                used[l] = used.get(l, 0) + times
                at += l
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank``, from 0, among those of their length."""
    spark = rows.sparkSession
    salts = spark.createDataFrame([(l, -(-n // GROUP)) for l, n in sizes.items()], "l long, salts long")
    rows = rows.join(F.broadcast(salts), F.col("length") == F.col("l")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("l", "salts")
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "salt").count().select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    rows = rows.withColumn("own", F.row_number().over(own) - 1)
    return rows.join(offsets, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("base") + F.col("own")).drop("l", "s", "base", "own", "salt")


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    rows = cut(pieces(docs, path, size, end, with_ids))
    sizes = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    have = np.zeros(size + 1, np.int64)
    for l, n in sizes.items():
        have[l] = n
    table = places(solve(have))
    # lengths are below 2**24 and ranks below 2**39, so one number orders both
    shared = docs.sparkSession.sparkContext.broadcast(table)
    order = ranked(rows.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids), sizes)
    names = [c for c in order.columns if c != "rank"]

    def run(batches):
        t = shared.value
        key = (t[:, 0] << 39) + t[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 39) + rank, "right") - 1
            arrays = [batch.column(k) for k in names] + [pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema if f.name != "rank")
    return order.mapInArrow(run, kinds + ", sequence_id long, offset long")
