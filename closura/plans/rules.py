"""Rules as text, compiled to joins.

``T ?c sco ?d; A ?x type ?c -> ?x type ?d``: atoms over the schema (T), the facts (A) and
the identity pairs (E), and heads.  ``?a != ?b`` is a condition.  Columns are named after
variables, so an atom joins the ones before it on the variables that they share; schema
sides are broadcast when the plan that calls has counted the schema.

Over new and old facts a rule is applied once for each of its A and E atoms, with the new
rows in that place: nothing that only old rows make is made again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.vocab import NAMES


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[tuple[str, tuple], ...]
    heads: tuple[tuple, ...]
    unequal: tuple[tuple[str, str], ...] = ()
    identity: bool = field(default=False)  # its heads are identity pairs, not facts


def _term(x: str):
    return x[1:] if x[0] == "?" else NAMES[x] if x in NAMES else int(x)


def rule(name: str, text: str, identity: bool = False) -> Rule:
    left, right = text.split("->")
    body, unequal = [], []
    for part in filter(None, map(str.strip, left.split(";"))):
        if m := re.fullmatch(r"\?(\w+) != \?(\w+)", part):
            unequal.append(m.groups())
        else:
            source, *terms = part.split()
            body.append((source, tuple(map(_term, terms))))
    heads = tuple(tuple(map(_term, h.split())) for h in right.split(","))
    return Rule(name, tuple(body), heads, tuple(unequal), identity)


def _atom(df: DataFrame, terms: tuple) -> DataFrame:
    """Rows that fit an atom, columns named after its variables."""
    cols = df.columns[: len(terms)]
    seen: dict[str, str] = {}
    out = df
    for c, t in zip(cols, terms, strict=True):
        if isinstance(t, int):
            out = out.where(F.col(c) == t)
        elif t in seen:
            out = out.where(F.col(c) == F.col(seen[t]))
        else:
            seen[t] = c
    return out.select(*[F.col(c).alias(t) for t, c in seen.items()]) if seen else out.select(F.lit(1).alias("_")).limit(1)


def _joined(atoms: list[DataFrame], r: Rule) -> DataFrame:
    """Atoms joined, each time one that shares a variable with those before."""
    out, left = atoms[0], atoms[1:]
    while left:
        i = next((i for i, a in enumerate(left) if set(a.columns) & set(out.columns)), None)
        if i is None:
            raise ValueError(f"{r.name}: an atom shares no variable with the others")
        a = left.pop(i)
        out = out.join(a, sorted(set(a.columns) & set(out.columns)))
    for a, b in r.unequal:
        out = out.where(F.col(a) != F.col(b))
    return out


def _heads(df: DataFrame, r: Rule) -> DataFrame:
    value = lambda t: F.lit(t).cast("long") if isinstance(t, int) else F.col(t)
    names = ("s", "p", "o") if len(r.heads[0]) == 3 else ("a", "b")
    rows = [F.struct(*[value(t).alias(n) for n, t in zip(names, h, strict=True)]) for h in r.heads]
    if len(rows) == 1:
        return df.select(rows[0].alias("h")).select("h.*")
    return df.select(F.inline(F.array(*rows)))


def apply(r: Rule, sources: dict[str, tuple[DataFrame, DataFrame]], broadcast: Iterable[str] = ()) -> DataFrame | None:
    """What ``r`` makes of (new, all) rows of each source; a source whose new rows are
    None doesn't change."""
    places = [i for i, (x, _) in enumerate(r.body) if sources[x][0] is not None]
    out = None
    for place in places or [None]:
        atoms = []
        for i, (x, terms) in enumerate(r.body):
            new, whole = sources[x]
            a = _atom(new if i == place else whole, terms)
            atoms.append(F.broadcast(a) if x in broadcast else a)
        # the changing rows lead, then the schema: it is small, and facts that meet other
        # facts before it would be paired on all properties and classes
        lead = place if place is not None else next((i for i, (x, _) in enumerate(r.body) if x == "A"), 0)
        order = sorted(range(len(atoms)), key=lambda i: (i != lead, r.body[i][0] == "A"))
        df = _heads(_joined([atoms[i] for i in order], r), r)
        out = df if out is None else out.unionByName(df)
    return out


def apply_all(rules: Iterable[Rule], sources: dict, broadcast: Iterable[str] = ()) -> DataFrame | None:
    out = None
    for r in rules:
        df = apply(r, sources, broadcast)
        out = df if out is None else out.unionByName(df)
    return out
