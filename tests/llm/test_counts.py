"""Operators that count: quality rules, packing, token counts."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from closura.llm import packing, quality_rules as qr, token_counts as tc

from .helpers import WORD, corpus, edge_rows, frame, words

ODD = ["don't  \n\n stop", "Ünï ©ode ² ¼ ª µ", "a<|endoftext|>b", "İstanbul ſ Σας ΟΔΟΣ", "tab\tand\x0bform\x0c", "\x85x\xa0y", "日本 テキスト", "''s 's'T", "  lead", "x" * 300, "12345 67", "é" * 20, ""]


def base_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    again = {k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    n, r = len(w), len(again)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, r, n < 10 or 100 * r > 20 * n


def test_quality_rules(spark):
    rows = corpus(1, 150) + edge_rows() + [(900 + i, "#$% " * 40 + words(random.Random(i), 60), "en", "s0") for i in range(2)]
    out = qr.judge(frame(spark, rows)).collect()
    want = collections.Counter((i, *base_counts(t)) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], *[r[k] for k in qr.COUNTS], r["base_failed"]) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    by = {r["doc_id"]: r for r in out}
    assert not by[900]["kept"] and not by[901]["kept"]
    plain = [r for r in out if not r["base_failed"] and r["doc_id"] is not None and r["doc_id"] < 150]
    assert sum(r["kept"] for r in plain) > 0.9 * len(plain)
    assert qr.judge(frame(spark, [])).collect() == []


def test_mcd_like_brute_force(spark):
    """The estimate of a contaminated sample is near that of its clean part."""
    rng = np.random.default_rng(0)
    p = len(qr.FLOOR)
    clean, bad = rng.normal(3, 1, (900, p)), rng.normal(20, 1, (100, p))
    df = spark.createDataFrame([(1, *map(float, r)) for r in np.vstack([clean, bad])], ", ".join(["g int", *[f"x{i} double" for i in range(p)]]))
    est, sizes = qr.mcd(df, ["g"])
    m, c = est[(1,)]
    assert sizes[(1,)] == 1000
    assert np.abs(m - clean.mean(0)).max() < 0.2
    assert 0.4 < np.diag(c).min() and np.diag(c).max() < 2.0


def test_mcd_is_the_least_determinant(spark, monkeypatch):
    """Against all subsets of small groups; distances and verdicts from plain numpy."""
    monkeypatch.setattr(qr, "FLOOR", np.full(5, 1e-3))
    rng = np.random.default_rng(1)
    groups = {}
    for g in "ab":
        groups[g] = rng.normal(size=(13, 5)) * [3, 1, 4, 2, 3]
        groups[g][:3] += rng.normal(size=(3, 5)) * 25
    df = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    est, _ = qr.mcd(df, ["g"], min_group=1)
    alone, _ = qr.mcd(df.where("g = 'a'"), [], min_group=1)
    assert np.allclose(alone[()][0], est[("a",)][0])
    for g, x in groups.items():
        of = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True))
        d2 = lambda m, c: ((x - m) @ np.linalg.inv(qr.floored(c)) * (x - m)).sum(1)  # noqa: B023, E731
        _, best = min((np.linalg.slogdet(qr.floored(of(x[list(k)])[1]))[1], k) for k in itertools.combinations(range(13), 10))
        m, c = of(x[list(best)])
        m, c = of(x[d2(m, c * qr.consistent(qr.SHARE, 5)) <= qr.chi2_quantile(qr.REWEIGHT, 5)])
        assert np.allclose(est[(g,)][0], m) and np.allclose(est[(g,)][1], c * qr.consistent(qr.REWEIGHT, 5))
        got = qr.distances(df.where(df.g == g), {(g,): {"": est[(g,)]}}, ["g"]).orderBy("x0").toPandas()["d2"]
        assert np.allclose(got, d2(*est[(g,)])[np.argsort(x[:, 0])])


def test_chi2_quantiles():
    for q, p, want in ((0.95, 1, 3.841459), (0.975, 5, 12.832502), (0.5, 5, 4.351460), (0.99, 7, 18.475307)):  # fixed values
        assert abs(qr.chi2_quantile(q, p) - want) < 1e-5


@pytest.fixture(scope="module")
def word_tool():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoder(word_tool):
    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + [t for _, t, *_ in corpus(2, 40)] + ["".join(random.Random(i).choice("aZ é'’-_ 1\n.,ßÀ×÷²́ǅ") for _ in range(200)) for i in range(60)]
    want = [np.array(word_tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(spark, word_tool, size):
    rows = corpus(4, 100) + edge_rows()
    docs = frame(spark, rows)
    out = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), size, with_ids=True).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*word_tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            want[(i, k, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for o, l in sorted(s):
            assert o == at
            at += l
        assert at <= size
    total = sum(r["length"] for r in out)
    assert len(sequences) <= 1.02 * total / size + 2
    assert packing.packed(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_solver(seed):
    rng = np.random.default_rng(seed)
    have = np.zeros(513, np.int64)
    np.add.at(have, np.minimum(rng.geometric(0.01, 20_000), 512), 1)
    plan = packing.solve(have, rounds=60)
    used = np.zeros_like(have)
    for p, times in plan:
        assert sum(l * a for l, a in p.items()) <= 512
        for l, a in p.items():
            used[l] += a * times
    assert (used == have).all()
    least = -(-int((np.arange(513) * have).sum()) // 512)
    assert sum(t for _, t in plan) <= 1.01 * least + 1


def test_token_trees():
    tool = tc.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    full = lambda s: len(tool.library.encode(s, add_special_tokens=False).ids)
    rng = random.Random(6)
    for text in [*ODD, *[t for _, t, *_ in corpus(6, 25)], "   " * 300, "中" * 700]:
        tree, n = tc.counted(text, tool)
        assert tree.total == full(text)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = a + rng.choice([0, 1, 3, 40, 400])
            new = rng.choice(["", " ", "x", "\n\n", " hello world", "'", "日本 ", "a b c " * 60])
            text, again = tc.edited(tree, text, a, b, new, tool)
            assert tree.total == full(text) and sum(tree.leaves(tree.chars)) == len(text)
    long = words(rng, 20_000)
    tree, n = tc.counted(long, tool)
    _, again = tc.edited(tree, long, 50_000, 50_003, "zz", tool)
    assert again < 4 * tc.LEAF < n


def test_token_counts(spark):
    rows = edge_rows()
    edit = [(3, 6, "new"), (0, 0, " "), (10**9, 10**9, "end")]
    df = spark.createDataFrame([(i, t, edit) for i, t, *_ in rows], f"doc_id long, text string, edits {tc.EDIT}")
    tool = tc.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    full = lambda s: len(tool.library.encode(s, add_special_tokens=False).ids)
    want = []
    for i, t, *_ in rows:
        t = t or ""
        e = " " + t[:3] + "new" + t[6:] + "end"
        want.append((i, full(t), full(e)))
    out = tc.count(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_tokens_after"]) for r in out) == collections.Counter(want)
    assert all(r["tree_tokens"][1] == r["n_tokens_after"] for r in out)
