"""The configuration program places every length itself."""

from functools import lru_cache

import numpy as np
import pytest

from closura.llm import packing


def sequences(plan):
    return sum(t for _, t in plan)


def histogram(kind):
    rng = np.random.default_rng(7)
    have = np.zeros(1025, np.int64)
    lengths = {"dense": lambda: rng.geometric(0.008, 9_000), "thirds": lambda: rng.integers(275, 510, 1_500), "few": lambda: rng.integers(1, 400, 300), "long": lambda: rng.integers(1, 1024, 2_000)}[kind]()
    np.add.at(have, np.minimum(lengths, 1024), 1)
    return have


@pytest.mark.parametrize("kind", ["dense", "thirds", "few", "long"])
def test_program_places_all(kind):
    have = histogram(kind)
    used = np.zeros_like(have)
    plan = packing.program(have)
    for p, times in plan:
        assert times > 0 and sum(l * a for l, a in p.items()) <= 1024
        for l, a in p.items():
            used[l] += a * times
    assert (used == have).all()
    fit = sequences(packing.best_fit(have))
    assert sequences(packing.solve(have)) == min(fit, sequences(plan))
    least = -(-int((np.arange(1025) * have).sum()) // 1024)
    if kind in ("dense", "few"):
        assert sequences(plan) <= 1.005 * least + 1
    if kind == "thirds":  # pairs and threes that best fit doesn't find
        assert sequences(plan) < fit


def test_prices_are_the_best():
    """Against all multisets, with no more copies than there are."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        have, value = rng.integers(0, 3, 13), np.concatenate([[0.0], rng.random(12)])
        have[0] = 0
        best = [0.0] * 13
        for l in range(1, 13):
            best = [max(best[c - a * l] + a * value[l] for a in range(int(have[l]) + 1) if a * l <= c) for c in range(13)]
        tables = packing.Prices(value, have)
        p = tables.pattern(len(tables.bundles), 12)
        assert all(a <= have[l] for l, a in p.items()) and sum(l * a for l, a in p.items()) <= 12
        assert sum(a * value[l] for l, a in p.items()) == pytest.approx(best[12])


def least(pieces, size):
    """The fewest sequences, by trying: the longest piece takes any set of others that fits."""

    @lru_cache(None)
    def fewest(rest):
        if not rest:
            return 0
        first, others = rest[-1], rest[:-1]
        sets = {()}
        for l in others:
            sets |= {(*t, l) for t in sets if sum(t) + l <= size - first}
        out = len(rest)
        for t in sets:
            left = list(others)
            for l in t:
                left.remove(l)
            out = min(out, 1 + fewest(tuple(left)))
        return out

    return fewest(tuple(sorted(pieces)))


def test_program_against_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(25):
        have = np.bincount(rng.integers(1, 13, rng.integers(1, 10)), minlength=13)
        best = least(np.repeat(np.arange(13), have).tolist(), 12)
        f = packing.fractional(have)
        assert f.bound <= best + 1e-9 and f.bound <= f.value + 1e-9
        assert best <= sequences(packing.program(have)) <= min(f.value + (have > 0).sum(), sequences(packing.best_fit(have)))


@pytest.mark.parametrize("lengths", [300, 1000])
def test_program_alone_of_many_pieces(lengths):
    rng = np.random.default_rng(11)
    have = np.zeros(4097, np.int64)
    have[rng.choice(np.arange(1, 4097), lengths, replace=False)] = rng.integers(1, 1000, lengths)
    f = packing.fractional(have)
    assert f.bound <= f.value <= 1.02 * f.bound
    # the solution is one: uses and what they lack cover everything
    covered = np.zeros(4097)
    for p, times in zip(f.patterns, f.uses, strict=False):
        assert sum(l * a for l, a in p.items()) <= 4096
        for l, a in p.items():
            covered[l] += a * times
    alone = 4096 // np.maximum(1, np.arange(4097))
    assert f.uses.sum() + (np.maximum(0, have - covered)[1:] / alone[1:]).sum() == pytest.approx(f.value)
    # more than nine in ten pieces lie in patterns of the rounded solution
    assert sum(int(u) * sum(p.values()) for p, u in zip(f.patterns, f.uses, strict=False)) > 0.9 * have.sum()
    plan = packing.program(have)
    assert f.bound <= sequences(plan) <= f.value + lengths
    assert sequences(plan) <= sequences(packing.best_fit(have))


def test_program_of_nothing_and_of_whole_sequences():
    assert packing.program(np.zeros(9, np.int64)) == []
    have = np.zeros(9, np.int64)
    have[8] = 5
    assert sequences(packing.program(have)) == 5


def test_program_of_ties_does_not_depend_on_the_order_of_calls():
    have = histogram("thirds")
    assert packing.program(have) == packing.program(have)
