"""Rules over a counted, small schema, on the driver.

A schema has some hundred to some ten thousand axioms; its closure takes longer to plan
than to compute.  Callers count it first and use the distributed plan beyond a limit.
What the rules make of it is bounded too: beyond ``MOST`` rows ``TooLarge`` is raised,
and callers go over to the distributed plan.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import islice

from .rules import Rule

Triple = tuple[int, int, int]
MOST = 500_000  # rows of a closure, or of a conjunction's bindings


class TooLarge(RuntimeError):
    """More rows than the driver should hold."""


def bindings(atoms: Iterable[tuple], facts: set, by_predicate: dict[int, list] | None = None, new: set | None = None, place: int | None = None, most: int = MOST) -> list[dict]:
    """Variable bindings of a conjunction; atom ``place`` is taken over ``new``."""
    by_predicate = indexed(facts) if by_predicate is None else by_predicate
    new_by = indexed(new) if new is not None else None
    out: list[dict] = [{}]
    order = sorted(enumerate(atoms), key=lambda x: x[0] != place) if place is not None else list(enumerate(atoms))
    todo = list(order)
    bound: set = set()
    while todo and out:
        k = next((i for i, (_, a) in enumerate(todo) if not bound or bound & {t for t in a if isinstance(t, str)}), 0)
        i, atom = todo.pop(k)
        source = new_by if i == place else by_predicate
        rows = source.get(atom[1], []) if isinstance(atom[1], int) else [r for v in source.values() for r in v]
        shared = [t for t in dict.fromkeys(atom) if isinstance(t, str) and t in bound]
        table = defaultdict(list)
        for r in rows:
            b: dict = {}
            for t, v in zip(atom, r, strict=True):
                if isinstance(t, int):
                    if t != v:
                        break
                elif b.setdefault(t, v) != v:
                    break
            else:
                table[tuple(b[t] for t in shared)].append(b)
        out = list(islice((x | b for x in out for b in table.get(tuple(x[t] for t in shared), ())), most + 1))
        if len(out) > most:
            raise TooLarge
        bound |= {t for t in atom if isinstance(t, str)}
    return out


def indexed(facts: Iterable[Triple]) -> dict[int, list]:
    out = defaultdict(list)
    for f in facts:
        out[f[1]].append(f)
    return out


def closed(facts: Iterable[Triple], rules: Iterable[Rule], most: int = MOST) -> set[Triple]:
    """All that schema rules (T atoms only) make of ``facts``, with them."""
    whole, new = set(facts), set(facts)
    rules = list(rules)
    while new:
        found = set()
        index = indexed(whole)
        for r in rules:
            atoms = [t for _, t in r.body]
            for place in range(len(atoms)):
                for b in bindings(atoms, whole, index, new, place, most):
                    for h in r.heads:
                        found.add(tuple(t if isinstance(t, int) else b[t] for t in h))
        new = found - whole
        whole |= new
        if len(whole) > most:
            raise TooLarge
    return whole
