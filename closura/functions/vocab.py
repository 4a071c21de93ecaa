"""Reserved ids of the encoded vocabulary (fixed values); user ids begin at
``FIRST_USER_ID``."""

from __future__ import annotations

SUB_CLASS_OF, SUB_PROPERTY_OF, DOMAIN, RANGE, TYPE, COMMENT, REST, FIRST, LABEL, NIL = range(10)
LITERAL, TRANSITIVE, INVERSE_OF, THING, MAX_QUALIFIED_CARDINALITY = range(10, 15)
SOME_VALUES_FROM, EQUIVALENT_CLASS, INTERSECTION_OF, MEMBERS, EQUIVALENT_PROPERTY = range(15, 20)
ON_PROPERTY, PROPERTY_CHAIN_AXIOM, DISJOINT_WITH, PROPERTY_DISJOINT_WITH, UNION_OF = range(20, 25)
HAS_KEY, ALL_VALUES_FROM, COMPLEMENT_OF, ON_CLASS, DISTINCT_MEMBERS = range(25, 30)
FUNCTIONAL, NAMED_INDIVIDUAL, OBJECT_PROPERTY, CLASS, ALL_DISJOINT_CLASSES = range(30, 35)
RESTRICTION, DATATYPE_PROPERTY, ONTOLOGY, ASYMMETRIC, SYMMETRIC = range(35, 40)
IRREFLEXIVE, ALL_DIFFERENT, INVERSE_FUNCTIONAL, SAME_AS, HAS_VALUE = range(40, 45)
NOTHING, ONE_OF = 45, 46
FIRST_USER_ID = 47

#: Short names used in rules.
NAMES = {
    "sco": SUB_CLASS_OF, "spo": SUB_PROPERTY_OF, "dom": DOMAIN, "rng": RANGE, "type": TYPE, "rest": REST, "first": FIRST, "nil": NIL,
    "Transitive": TRANSITIVE, "inv": INVERSE_OF, "Thing": THING, "svf": SOME_VALUES_FROM, "eqc": EQUIVALENT_CLASS, "int": INTERSECTION_OF,
    "eqp": EQUIVALENT_PROPERTY, "onp": ON_PROPERTY, "chain": PROPERTY_CHAIN_AXIOM, "uni": UNION_OF, "avf": ALL_VALUES_FROM, "Functional": FUNCTIONAL,
    "ObjectProperty": OBJECT_PROPERTY, "Class": CLASS, "Symmetric": SYMMETRIC, "InverseFunctional": INVERSE_FUNCTIONAL, "same": SAME_AS,
    "hv": HAS_VALUE, "Nothing": NOTHING, "oneof": ONE_OF,
}

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"

#: IRIs of the reserved ids, for the text form.
IRIS = {
    **{RDFS + n: i for n, i in {"subClassOf": 0, "subPropertyOf": 1, "domain": 2, "range": 3, "comment": 5, "label": 8, "Literal": 10}.items()},
    **{RDF + n: i for n, i in {"type": 4, "rest": 6, "first": 7, "nil": 9}.items()},
    **{
        OWL + n: i
        for n, i in {
            "TransitiveProperty": 11, "inverseOf": 12, "Thing": 13, "maxQualifiedCardinality": 14, "someValuesFrom": 15, "equivalentClass": 16,
            "intersectionOf": 17, "members": 18, "equivalentProperty": 19, "onProperty": 20, "propertyChainAxiom": 21, "disjointWith": 22,
            "propertyDisjointWith": 23, "unionOf": 24, "hasKey": 25, "allValuesFrom": 26, "complementOf": 27, "onClass": 28, "distinctMembers": 29,
            "FunctionalProperty": 30, "NamedIndividual": 31, "ObjectProperty": 32, "Class": 33, "AllDisjointClasses": 34, "Restriction": 35,
            "DatatypeProperty": 36, "Ontology": 37, "AsymmetricProperty": 38, "SymmetricProperty": 39, "IrreflexiveProperty": 40,
            "AllDifferent": 41, "InverseFunctionalProperty": 42, "sameAs": 43, "hasValue": 44, "Nothing": 45, "oneOf": 46,
        }.items()
    },
}
