"""Small tables with the cases that operators must define, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, items string, `key` string, score double, spans string, component string, `c` int"


def words(rng, n, lang="en"):
    pool = {"en": "the of and to in that is was for with on as by at from this be are".split(), "de": "der die und das nicht ein für mit sich auf dem ich als auch".split()}[lang]
    return " ".join(rng.choice(pool) + rng.choice(["", "", "er", "ing", "ly", "heit", "ab"]) for _ in range(n))


def edge_rows():
    rng = random.Random(1)
    long = words(rng, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "b"), (4, "one two", "en", None), (5, "one two", "en", None), (6, "12345 !!! 678", "de", "b"), (7, long, "en", "c"),
        (8, long, "en", "c"), (9, words(rng, 120), "en", "a"), (9, words(random.Random(99), 120), "en", "a"), (10, "日本語 テキスト ß É é ſ K " * 30, None, None), (None, words(rng, 50), "en", "a"), (11, "x" * 5000, "en", "a"), (12, "tie tie tie " * 100, "de", "b"),
    ]


def frame(spark, rows):
    """With columns whose names operators use themselves."""
    extra = (7, "i", "k", 0.5, "s", "c", 3)
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *extra) for r in rows], SCHEMA)


def corpus(seed=0, n=120):
    """Documents with copies, near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    passage = words(rng, 150)
    base = words(rng, 130).split()
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1:
            w = list(base)
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 99)}"
            text = " ".join(w)
        elif kind == 2:
            text = words(rng, rng.randint(5, 80)) + " " + passage + " " + words(rng, rng.randint(5, 80))
        elif kind == 3:
            text = "\n".join([words(rng, 12)] * rng.randint(1, 12))
        else:
            text = words(rng, rng.randint(1, 200), rng.choice(["en", "de"]))
        rows.append((i, text, "de" if "und" in text else "en", f"s{i % 3}"))
    return rows
