"""A second reading of the rules: naive evaluation by nested loops, for small inputs."""

from __future__ import annotations


def matches(atoms, sources, binding=None):
    binding = binding or {}
    if not atoms:
        yield binding
        return
    (source, terms), *rest = atoms
    for row in sources[source]:
        b = dict(binding)
        for t, x in zip(terms, row, strict=True):
            if isinstance(t, int):
                if t != x:
                    break
            elif b.setdefault(t, x) != x:
                break
        else:
            yield from matches(rest, sources, b)


def once(r, sources):
    out = set()
    for b in matches(list(r.body), sources):
        if all(b[x] != b[y] for x, y in r.unequal):
            out |= {tuple(t if isinstance(t, int) else b[t] for t in h) for h in r.heads}
    return out


def schema_closure(rows, rules, extra=()):
    whole = set(rows) | set(extra)
    while True:
        new = set().union(*[once(r, {"T": whole}) for r in rules]) - whole
        if not new:
            return whole
        whole |= new


def equal_pairs(edges):
    pairs = set(edges) | {(b, a) for a, b in edges}
    while True:
        new = {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs
        if not new:
            return pairs
        pairs |= new


def fact_closure(schema, facts, rules, identity, replace, same=()):
    whole, edges = set(facts), set(same)
    while True:
        e = equal_pairs(edges)
        s = {"T": schema, "A": whole, "E": e}
        new = set().union(*[once(r, s) for r in [*rules, *replace]]) - whole
        more = set().union(*[once(r, s) for r in identity]) - e
        if not new and not more:
            return whole, e
        whole |= new
        edges |= more
