"""Language identification against plain loops over each text alone."""

import math
import random
import re

from closura.llm import language_id as li

from .helpers import frame
from .test_models import many

MASK = (1 << 32) - 1


def margins(model, text):
    raw = text.lower().encode()
    body = b" ".join(re.findall(rb"[a-z\x80-\xff]+", raw))
    if body and not re.match(rb"[a-z\x80-\xff]", raw[-1:]):
        body += b" "
    out = [float(x) for x in model.bias]
    for i in range(len(body)):
        for k in (1, 2, 3, 4):
            h = 0
            for byte, times in zip(body[i : i + k].ljust(k), li._multipliers.tolist(), strict=False):
                h = (h + byte + 1) * times & MASK
            f = ((h ^ (h >> 15)) * 0x2C1B3C6D & MASK) >> 16
            out = [m + float(w) / len(body) for m, w in zip(out, model.weights[f], strict=True)]
    return out


def elected(model, names, m):
    duel = lambda a, b: m[model.tests.index((a, b))] if (a, b) in model.tests else -m[model.tests.index((b, a))]
    others = lambda a: [duel(a, b) for b in names if b != a]
    best = max(names, key=lambda a: (sum(x > 0 for x in others(a)), sum(others(a))))
    return best, 1 / (1 + math.exp(-2 * min([30, *others(best)])))


def test_predictions_like_plain_loops(spark):
    rows = many(5, 200) + [(500, "für", None, "a"), (501, "las", None, "a"), (502, "-- und", None, "a"), (503, "x", None, "a")]
    model = li.fit(frame(spark, rows))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.predict(frame(spark, rows), model).collect()}
    for i, text, *_ in rows[150:]:
        m = margins(model, text)
        family, sure = elected(model, sorted(model.families), m)
        lang, s = elected(model, sorted(model.families[family]), m)
        assert got[i][0] == lang and abs(got[i][1] - min(s, sure)) < 1e-4, (i, text)


def test_neighbours_in_a_batch_change_nothing(spark):
    """Texts that end in a letter, too."""
    rng = random.Random(8)
    rows = [(i, text.rstrip("."), lang, s) for i, text, lang, s in many(6, 120)] + [(300 + i, w, None, "a") for i, w in enumerate("für las the on und été no".split())]
    model = li.fit(frame(spark, rows))
    first = {tuple(r) for r in li.predict(frame(spark, rows).coalesce(1), model).collect()}
    rng.shuffle(rows)
    assert {tuple(r) for r in li.predict(frame(spark, rows).coalesce(1), model).collect()} == first
