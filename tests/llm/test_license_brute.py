"""License scans against all templates by all stretches of words."""

import math
import random
import re

from closura.llm import license_scan as ls

from .helpers import words


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        back = row
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = back[j] + 1 if x == y else max(back[j + 1], row[j])
    return row[-1]


def there(text):
    """Names of the templates that some stretch of the text holds enough of."""
    own = re.findall(r"[a-z]+|\d+(?:\.\d+)*", text.lower())
    out = set()
    for name, (must, texts) in ls.TEMPLATES.items():
        for t in texts:
            want = re.findall(r"[a-z]+|\d+(?:\.\d+)*", t.lower())
            width = int(1.5 * len(want) + 3)
            for a in range(len(own)):
                part = own[a : a + width]
                if all(any(w == m or w.startswith(m + ".") for w in part) for m in must.split()) and longest(want, part) >= max(3, math.ceil(ls.COVER * len(want) - 1e-9)):
                    out.add(name)
    return out


def test_brute_force():
    rng = random.Random(11)
    seen = 0
    for name, (must, texts) in ls.TEMPLATES.items():
        t = rng.choice(texts)
        for share in (0.0, 0.08, 0.4):
            parts = t.split()
            for i, w in enumerate(parts):  # what makes a line a candidate and what must be there stays
                if rng.random() < share and not ls.CUE.search(w.lower()) and not any(m in w.lower() for m in must.split()):
                    parts[i] = "qu" + "aeiou"[i % 5]
            text = words(rng, 8) + ". " + " ".join(parts) + " " + words(rng, 8)
            got, want = {x[0] for x in ls.licenses(text)}, there(text)
            assert got <= want and bool(got) == bool(want), (text, got, want)
            assert share or name in got
            seen += bool(want)
    assert len(ls.TEMPLATES) <= seen < 3 * len(ls.TEMPLATES)
