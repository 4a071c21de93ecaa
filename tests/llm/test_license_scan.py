import random

from closura.llm import license_scan as ls

from .helpers import edge_rows, frame, words


def found(text):
    return [(n, text[a + x : a + y], exact) for a, b in ls.blocks(text) for n, x, y, _, exact, _ in ls.block_licenses(text[a:b])]


def test_every_notice_is_its_own():
    for name, (_, texts) in ls.TEMPLATES.items():
        for t in texts:
            got = found(f"Some prose before.\n{t}\nSome after it.")
            assert (name, True) in [(n, e) for n, _, e in got], (t, got)


def test_wording_differences():
    assert found("Licensed under the Apache License, Version 1.1.") == []  # another version is another license
    (name, x, y, gain, exact, differences), *_ = ls.block_licenses("This fine work is licensed under the GNU General Public License, version 3.")
    assert name == "GPL-3.0" and gain > 0
    two = "Released under the MIT License. And data: Licensed under CC BY-NC 4.0."
    assert sorted(n for n, *_ in found(two)) == ["CC-BY-NC-4.0", "MIT"]
    assert found("I have permission to drive; my license is old.") == []


def test_alignment():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 12))] for _ in "ab")
        pairs = ls.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_scan(spark):
    line = "Licensed under the Apache License, Version 2.0."
    long = words(random.Random(2), 20_000) + " " + line + " " + words(random.Random(3), 20_000)
    rows = [(1, "é" * 50 + "\n" + line, "en", "a"), (2, long, "en", "a"), (3, line, "en", "a"), (3, line, "en", "a"), *edge_rows()[:6]]
    out = ls.scan(frame(spark, rows)).collect()
    assert [len(r["licenses"]) for r in out] == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    for (_, t, *_), r in zip(rows[:4], out, strict=False):
        (x,) = r["licenses"]
        assert x["name"] == "Apache-2.0" and x["exact"] and t[x["start"] : x["end"]] == line[:-1]
    assert ls.scan(frame(spark, [])).collect() == []
