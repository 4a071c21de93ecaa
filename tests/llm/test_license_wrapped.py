"""Notices wrapped over lines, as comments too."""

import random
import textwrap

import pytest

from closura.llm import license_scan as ls

from .helpers import frame, words

TEXTS = [(name, t) for name, (_, texts) in ls.TEMPLATES.items() for t in texts]


@pytest.mark.parametrize("width", [24, 40, 72])
@pytest.mark.parametrize("mark", ["", "# ", "    // ", " * "])
def test_wrapped_notices(width, mark):
    for name, t in TEXTS:
        notice = "\n".join(mark + line for line in textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False))
        got = ls.licenses(f"Some prose before.\n\n{notice}\n\nSome after it.")
        assert (name, True) in [(n, e) for n, _, _, _, e, _ in got], (t, got)


def test_wrapped_in_long_text(spark):
    rng = random.Random(1)
    picks = [x for x in TEXTS if x[0] in ("MIT-text", "ISC", "BSD")][:1] + [x for x in TEXTS if x[1].startswith(("Redistribution", "Permission to use"))]
    prose = lambda n: textwrap.fill(words(rng, n), 60)
    rows = [(i, prose(300) + "\n" + textwrap.fill(t, 60) + "\n" + prose(300), "en", "a") for i, (_, t) in enumerate(picks)]
    many = "\n".join(textwrap.fill(t, 60) for _ in range(8) for _, t in picks)  # over LONGEST, blocks overlap
    rows.append((9, many, "en", "a"))
    out = {r["doc_id"]: r["licenses"] for r in ls.scan(frame(spark, rows)).collect()}
    for i, (name, t) in enumerate(picks):
        (x,) = out[i]
        assert (x["name"], x["exact"]) == (name, True)
        assert rows[i][1][x["start"] : x["end"]].split() == t.split()
    assert [x["name"] for x in out[9]] == [name for _ in range(8) for name, _ in picks] and all(x["exact"] for x in out[9])
