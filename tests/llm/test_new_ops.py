"""Operators 11 to 13 against plain loops, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from closura.llm import sharding, spelling, whitening

from .helpers import corpus, edge_rows, frame


# -- whitening --------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int, component int")


def plain_whitened(rows, d):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = [tuple(int(np.floor(c * 64)) + 1000000 for c in v) for _, v in kept]
    fit = sorted(set(x))
    n = len(fit)
    s = [sum(v[k] for v in fit) for k in range(d)]
    dev = Counter((i, sum((n * a - b) ** 2 for a, b in zip(v, s))) for (i, _), v in zip(kept, x))
    cov = np.array([[float(sum(Fraction(n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3) for j in range(d)] for i in range(d)])
    return n, dev, cov


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9, 1e15])
def test_whitening_is_exact(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + k) * scale + k for k in range(5)], "a", 1, 1) for i in range(200)]
    rows += [(i + 500, rows[i][1], "b", 2, 2) for i in range(40)]  # copies
    rows += [(900, None, "", 0, 0), (901, [1.0, None, 1.0, 1.0, 1.0], "", 0, 0), (902, [float("nan")] * 5, "", 0, 0), (903, [float("-inf")] + [0.0] * 4, "", 0, 0), (None, [0.5] * 5, "", 0, 0)]
    n, dev, cov = plain_whitened(rows, 5)
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert {int(t) for t in got.n} == {n}
    first = got[got.component == 1]
    assert Counter((None if i != i else int(i), int(t)) for i, t in zip(first.vec_id, first.deviation_exact)) == dev
    exact = [int(t) for t in got.deviation_exact]
    assert all((t == e) if e < 1 << 63 else t != t for t, e in zip(got.deviation.astype(object), exact))
    e = np.linalg.eigvalsh(cov)[::-1]
    share = got.groupby("component").explained.first().to_numpy()
    live = e > 1e-12 * e[0]
    np.testing.assert_allclose(share[live], (e / e.sum())[live], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(1)
    for top in (2**10, 2**25, 2**45, 2**61):
        y = rng.integers(-top, top, (whitening.ROWS, 3))
        want = y.T.astype(object) @ y.astype(object)
        assert (whitening.gram(y) == want).all() and (whitening.gram(y.astype(object)) == want).all()
        back = sum(p.astype(np.int64).astype(object) * (1 << whitening.BITS * k) for k, p in enumerate(whitening.limbs(y)))
        assert (back == y).all()


def test_whitening_lengths_no_variance_and_nothing(spark):
    rows = [(1, [1.0, 2.0], "", 0, 0), (2, [2.0, 4.0], "", 0, 0), (3, [7.0], "", 0, 0), (4, [], "", 0, 0), (5, [1e300, -1e300, 0.0], "", 0, 0)]
    got = {(r.vec_id, r.component): r for r in whitening.whitened(vectors(spark, rows)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (5, 1), (5, 2), (5, 3)}
    assert got[1, 1].whitened == pytest.approx(-got[2, 1].whitened) and abs(got[1, 1].whitened) == pytest.approx(1)
    assert got[1, 2].whitened is None and got[1, 2].explained == 0 and got[1, 1].explained == pytest.approx(1)
    assert got[3, 1].whitened is None and got[3, 1].identity_error is None and got[3, 1].deviation == 0
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, None, "", 0, 0)])).collect() == []


# -- spelling ---------------------------------------------------------------


def plain_words(rows, every):
    found = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_grouped(rows, every):
    n = plain_words(rows, every)
    form, close = {}, {}
    for w in n:
        others = [v for v in n if one_edit(w, v)]
        close[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], close[w], n[form[w]] if form[w] else None))
    return out


def variants(seed, alphabet="abÀÿ×e"):
    """Few letters and short words: many pairs, deletions, chains and ties."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 8))): None for _ in range(60)}
    for w in list(words):
        k = rng.randrange(len(w))
        words[w[:k] + rng.choice(alphabet) + w[k + 1 :]] = words[w[:k] + w[k + 1 :]] = words[w[:k] + rng.choice(alphabet) + w[k:]] = None
    bag = [w if rng.random() < 0.7 else w.upper().lower() for w in words for _ in range(rng.choice([4, 5, 6, 30, 200, 1100]))]
    rng.shuffle(bag)
    return [(i, "  ".join(bag[a : a + 400]) + ". Zz", "en", "a") for i, a in enumerate(range(0, len(bag), 400))]


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
@pytest.mark.parametrize("seed", [0, 1])
def test_spelling_equals_plain_loops(spark, seed, block):
    rows = variants(seed)
    got = [tuple(r) for r in spelling.grouped(frame(spark, rows), block=block, every=7).collect()]
    want = plain_grouped(rows, 7)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f and r != f for _, f, r, *_ in want)  # chains


def test_spelling_of_odd_rows(spark):
    rows = edge_rows() + corpus(4, 60)
    got = [tuple(r) for r in spelling.grouped(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_grouped(rows, 199)
    assert spelling.grouped(frame(spark, [])).collect() == []
    assert spelling.grouped(frame(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).collect() == []


# -- sharding ---------------------------------------------------------------


def plain_ring(rows, shards, virtual):
    """How many rows of each home go where: arcs try their homes first, in the ring's order,
    then what is left tries the next shard on its way."""
    import hashlib

    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:4], 16)
    points = sorted((place(f"{s}:{c}"), s, c) for s in range(shards) for c in range(virtual))
    ways = []
    for a in range(len(points)):
        way = []
        for _, s, _ in points[a:] + points[:a]:
            if s not in way:
                way.append(s)
        ways.append(way)
    n = Counter()
    for i, *_ in rows:
        p = place("" if i is None else str(i))
        n[next((a for a, q in enumerate(points) if q[0] >= p), 0)] += 1
    total = sum(n.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = Counter()
    for k in range(shards):
        for a in sorted(n):
            take = min(n[a], room[ways[a][k]])
            n[a] -= take
            room[ways[a][k]] -= take
            out[ways[a][0], ways[a][k]] += take
    return +out


@pytest.mark.parametrize("bucket", [sharding.BUCKET, 7])
def test_sharding_equals_plain_loops(spark, bucket):
    rows = edge_rows() + corpus(2, 150) + [(77, "same", "en", "a")] * 300 + [(None, None, None, None)] * 90
    got = sharding.sharded(frame(spark, rows), bucket=bucket).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert Counter((r.home, r.shard) for r in got) == plain_ring(rows, 8, sharding.VIRTUAL)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1


def test_sharding_of_few_rows_and_of_another_shard(spark):
    assert sharding.sharded(frame(spark, [])).collect() == []
    few = sharding.sharded(frame(spark, [(1, "a", None, None), (2, None, None, None), (3, "ß", None, None)])).collect()
    assert sorted(r.size for r in few) == [1, 2, 3] and {r.slot for r in few} == {0} and len({r.shard for r in few}) == 3
    rows = [(i, "x", "en", "a") for i in range(2000)]
    eight = {r.doc_id: r for r in sharding.sharded(frame(spark, rows)).collect()}
    nine = {r.doc_id: r for r in sharding.sharded(frame(spark, rows), shards=9).collect()}
    assert all(nine[i].home in (8, eight[i].home) for i in eight)  # homes move to the new shard only
    moved = sum(nine[i].shard != eight[i].shard for i in eight)
    assert moved < 0.45 * len(rows)  # dealing by remainders moves eight ninths
