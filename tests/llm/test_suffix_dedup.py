import collections
import random

import numpy as np
import pytest

from closura.llm import suffix_dedup as sd

from .helpers import corpus, edge_rows, frame, words


@pytest.mark.parametrize(("n", "k"), [(1, 3), (5, 2), (60, 2), (400, 3), (2000, 4), (800, 1)])
def test_suffix_array(n, k):
    rng = np.random.default_rng(n)
    for _ in range(5):
        s = np.append(rng.integers(1, k + 1, n), 0)
        l = s.tolist()
        sa = sd.suffix_array(s)
        assert sa.tolist() == sorted(range(len(l)), key=lambda i: l[i:])
        p = sd.permuted_common_prefixes(s, sa, 20)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            shared = next((i for i in range(20) if max(a, b) + i >= n or l[a + i] != l[b + i]), 20)
            assert p[a] == shared


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, t, *_), raw in zip(rows, texts, strict=True):
        whole = (t or "").encode()
        gone = bytearray(len(whole))
        for j in range(len(raw) - length + 1):
            if seen[raw[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(whole, gone, strict=True) if not g)
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(whole), sum(gone), runs, kept))
    return collections.Counter(out)


def got(df):
    return collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect())


@pytest.mark.parametrize(("length", "gram", "blocks", "block"), [(400, 128, (68, 8), 512), (60, 20, (11, 3), 4), (60, 20, (7,), 2)])
def test_brute_force(spark, length, gram, blocks, block):
    rng = random.Random(2)
    passage = words(rng, 90)
    rows = corpus(3, 60) + [(200 + i, words(rng, 20) + passage[: 300 + 9 * i] + words(rng, 9) + passage[-200:], "en", "a") for i in range(25)]
    rows += [(300, "é" * 700, "fr", "a"), (301, "abcab" * 300, "en", "a"), (302, "ab" * 210, "en", "a")]
    assert got(sd.cleaned(frame(spark, rows), length, gram=gram, blocks=blocks, block=block, shard_bytes=3000)) == brute(rows, length)


def test_cases(spark):
    rows = [r for r in edge_rows() if r[1] is None or len(r[1]) < 10_000]
    assert got(sd.cleaned(frame(spark, rows))) == brute(rows, 400)
    a, b = (words(random.Random(k), 160) for k in (5, 6))  # rows of one id, and of none, each by its own text
    rows = [(9, a, "en", "a"), (9, b, "en", "a"), (5, b, "en", "a"), (None, a, "en", "a"), (None, "short", "en", "a")]
    assert got(sd.cleaned(frame(spark, rows))) == brute(rows, 400)
    long = [r for r in edge_rows() if r[0] in (7, 8)]
    assert [(r["n_removed"], r["n_spans"]) for r in sd.cleaned(frame(spark, long)).collect()] == [(len(long[0][1]), 1)] * 2
    twice = [(1, words(random.Random(4), 200), "en", "a")] * 2
    assert all(r["n_removed"] == r["n_bytes"] for r in sd.cleaned(frame(spark, twice)).collect())
    assert sd.cleaned(frame(spark, [])).collect() == []
