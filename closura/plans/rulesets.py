"""The rules of each profile.  ``compat`` variants keep the deviations that users of the
earlier engine may depend on; the default is the W3C's reading."""

from __future__ import annotations

from .rules import Rule, rule

RDFS_FACTS = {
    "rdfs7": rule("rdfs7", "T ?a spo ?b; A ?x ?a ?y -> ?x ?b ?y"),
    "rdfs2": rule("rdfs2", "T ?p dom ?c; A ?x ?p ?y -> ?x type ?c"),
    "rdfs3": rule("rdfs3", "T ?p rng ?c; A ?x ?p ?y -> ?y type ?c"),
    "rdfs9": rule("rdfs9", "T ?c sco ?d; A ?x type ?c -> ?x type ?d"),
}

_SCHEMA = {
    "scm-cls": "T ?c type Class -> ?c sco ?c, ?c eqc ?c, ?c sco Thing, Nothing sco ?c",
    "scm-sco": "T ?a sco ?b; T ?b sco ?c -> ?a sco ?c",
    "scm-eqc1": "T ?a eqc ?b -> ?a sco ?b, ?b sco ?a",
    "scm-eqc2": "T ?a sco ?b; T ?b sco ?a -> ?a eqc ?b",
    "scm-op": "T ?p type ObjectProperty -> ?p spo ?p, ?p eqp ?p",
    "scm-spo": "T ?a spo ?b; T ?b spo ?c -> ?a spo ?c",
    "scm-eqp1": "T ?a eqp ?b -> ?a spo ?b, ?b spo ?a",
    "scm-eqp2": "T ?a spo ?b; T ?b spo ?a -> ?a eqp ?b",
    "scm-dom1": "T ?p dom ?c; T ?c sco ?d -> ?p dom ?d",
    "scm-dom2": "T ?q dom ?c; T ?p spo ?q -> ?p dom ?c",
    "scm-rng1": "T ?p rng ?c; T ?c sco ?d -> ?p rng ?d",
    "scm-rng2": "T ?q rng ?c; T ?p spo ?q -> ?p rng ?c",
    "scm-hv": "T ?c hv ?i; T ?c onp ?p; T ?d hv ?i; T ?d onp ?q; T ?p spo ?q -> ?c sco ?d",
    "scm-svf1": "T ?c svf ?x; T ?c onp ?p; T ?x sco ?y; T ?d svf ?y; T ?d onp ?p -> ?c sco ?d",
    "scm-svf2": "T ?c svf ?y; T ?c onp ?p; T ?d svf ?y; T ?d onp ?q; T ?p spo ?q -> ?c sco ?d",
    "scm-avf1": "T ?c avf ?x; T ?c onp ?p; T ?x sco ?y; T ?d avf ?y; T ?d onp ?p -> ?c sco ?d",
    "scm-avf2": "T ?c avf ?y; T ?c onp ?p; T ?d avf ?y; T ?d onp ?q; T ?p spo ?q -> ?d sco ?c",
}

#: Where the earlier engine reads its schema otherwise.
_SCHEMA_COMPAT = {
    "scm-cls": "T ?c ?any Class -> ?c sco ?c, ?c eqc ?c, ?c sco Thing, Nothing sco ?c",
    "scm-op": "T ObjectProperty ?any ?other -> ObjectProperty spo ObjectProperty, ObjectProperty eqp ObjectProperty",
    "scm-svf1": "T ?c svf ?x; T ?c onp ?p; T ?x sco ?y; T ?y svf ?d; T ?d onp ?p -> ?c sco ?d",
    "scm-svf2": "T ?c svf ?y; T ?c onp ?p; T ?y svf ?d; T ?d onp ?q; T ?p spo ?q -> ?c sco ?d",
    "scm-avf1": "T ?c avf ?x; T ?c onp ?p; T ?x sco ?y; T ?y avf ?d; T ?d onp ?p -> ?c sco ?d",
    "scm-avf2": "T ?c avf ?y; T ?c onp ?p; T ?y avf ?d; T ?d onp ?q; T ?p spo ?q -> ?d sco ?c",
}

_FACTS = {
    "cax-sco": "T ?c sco ?d; A ?x type ?c -> ?x type ?d",
    "cax-eqc1": "T ?c eqc ?d; A ?x type ?c -> ?x type ?d",
    "cax-eqc2": "T ?c eqc ?d; A ?x type ?d -> ?x type ?c",
    "eq-rep-s": "E ?a ?b; A ?a ?p ?o -> ?b ?p ?o",
    "eq-rep-p": "E ?a ?b; A ?s ?a ?o -> ?s ?b ?o",
    "eq-rep-o": "E ?a ?b; A ?s ?p ?a -> ?s ?p ?b",
    "prp-dom": "T ?p dom ?c; A ?x ?p ?y -> ?x type ?c",
    "prp-rng": "T ?p rng ?c; A ?x ?p ?y -> ?y type ?c",
    "prp-symp": "T ?p type Symmetric; A ?x ?p ?y -> ?y ?p ?x",
    "prp-trp": "T ?p type Transitive; A ?x ?p ?y; A ?y ?p ?z -> ?x ?p ?z",
    "prp-spo1": "T ?p spo ?q; A ?x ?p ?y -> ?x ?q ?y",
    "prp-eqp1": "T ?p eqp ?q; A ?x ?p ?y -> ?x ?q ?y",
    "prp-eqp2": "T ?p eqp ?q; A ?x ?q ?y -> ?x ?p ?y",
    "prp-inv1": "T ?p inv ?q; A ?x ?p ?y -> ?y ?q ?x",
    "prp-inv2": "T ?p inv ?q; A ?x ?q ?y -> ?y ?p ?x",
    "cls-svf1": "T ?x svf ?c; T ?x onp ?p; A ?u ?p ?v; A ?v type ?c -> ?u type ?x",
    "cls-svf2": "T ?x svf Thing; T ?x onp ?p; A ?u ?p ?v -> ?u type ?x",
    "cls-avf": "T ?x avf ?c; T ?x onp ?p; A ?u type ?x; A ?u ?p ?v -> ?v type ?c",
    "cls-hv1": "T ?x hv ?y; T ?x onp ?p; A ?u type ?x -> ?u ?p ?y",
    "cls-hv2": "T ?x hv ?y; T ?x onp ?p; A ?u ?p ?y -> ?u type ?x",
}

_FACTS_COMPAT = {
    "prp-symp": "T ?any ?p Symmetric; A ?x ?p ?y -> ?y ?p ?x",
    "prp-trp": "T ?any ?p Transitive; A ?x ?p ?y; A ?y ?p ?z -> ?x ?p ?z",
    "cls-svf1": "T ?x svf ?c; T ?x onp ?p; A ?u ?p ?v; A ?v ?any ?c -> ?u type ?x",
}

_IDENTITY = {
    "prp-fp": "T ?p type Functional; A ?x ?p ?a; A ?x ?p ?b; ?a != ?b -> ?a ?b",
    "prp-ifp": "T ?p type InverseFunctional; A ?a ?p ?y; A ?b ?p ?y; ?a != ?b -> ?a ?b",
}
_IDENTITY_COMPAT = {
    "prp-fp": "T ?p ?any Functional; A ?x ?p ?a; A ?x ?p ?b; ?a != ?b -> ?a ?b",
    "prp-ifp": "T ?p ?any InverseFunctional; A ?a ?p ?y; A ?b ?p ?y; ?a != ?b -> ?a ?b",
}


def _made(texts: dict[str, str], identity: bool = False) -> dict[str, Rule]:
    return {k: rule(k, t, identity) for k, t in texts.items()}


def schema_rules(compat: bool = False) -> dict[str, Rule]:
    return _made(_SCHEMA | (_SCHEMA_COMPAT if compat else {}))


def fact_rules(compat: bool = False) -> dict[str, Rule]:
    return _made(_FACTS | (_FACTS_COMPAT if compat else {}))


def identity_rules(compat: bool = False) -> dict[str, Rule]:
    return _made(_IDENTITY_COMPAT if compat else _IDENTITY, True)


def list_rules(chains, intersections, compat: bool = False) -> dict[str, Rule]:
    """Rules that the schema's lists stand for: a chain of n properties is a join of n
    facts, an intersection of n classes one of n types.  ``chains`` and ``intersections``
    are (head term, items)."""
    out = {}
    for k, (p, items) in enumerate(chains):
        body = "; ".join(f"A ?u{i} {q} ?u{i + 1}" for i, q in enumerate(items) if q != 4)
        if len([q for q in items if q == 4]) == 0:
            out[f"prp-spo2-{k}"] = rule("prp-spo2", f"{body} -> ?u0 {p} ?u{len(items)}")
    for k, (c, items) in enumerate(intersections):
        if compat and len(items) > 1:
            continue
        out[f"cls-int1-{k}"] = rule("cls-int1", "; ".join(f"A ?y type {x}" for x in items) + f" -> ?y type {c}")
    return out
