"""Registered queries of the law and profile questions, over the view `law_graph`."""

from __future__ import annotations

from tessera.operators import law_questions as ops
from tessera.plans.registry import query

MATCH = "p IN ('skos:exactMatch', 'skos:closeMatch', 'skos:broadMatch')"
OPTIONAL = {"label": "p = 'rdfs:label'", "match": MATCH, "source": "p = 'dct:source'", "type": "p = 'rdf:type' AND o <> 'owl:NamedIndividual'"}


def typed(type_: str | None) -> str:
    return f" AND s IN (SELECT s FROM law_graph WHERE p = 'rdf:type' AND o = '{type_}')" if type_ else ""


def sql_of(q: ops.Question) -> str:
    heads, branches = [], [f"SELECT o, CAST(NULL AS VARCHAR) FROM law_graph WHERE p = '{p}'{typed(t)}" for t, p in q.members]
    if q.below:
        heads.append(f"cb(node) AS (SELECT s FROM law_graph WHERE p = 'rdfs:subClassOf' AND o = '{q.below}' UNION SELECT law_graph.s FROM law_graph JOIN cb ON law_graph.o = cb.node WHERE law_graph.p = 'rdfs:subClassOf')")
        branches.append("SELECT node, CAST(NULL AS VARCHAR) FROM cb")
    if q.matched:
        roots = " UNION ".join(f"SELECT '{r}'" for r in q.matched)
        heads.append(f"tb(node) AS ({roots} UNION SELECT law_graph.s FROM law_graph JOIN tb ON law_graph.o = tb.node WHERE law_graph.p IN ('rdfs:subClassOf', 'skos:broader'))")
        branches.append(f"SELECT s, CAST(NULL AS VARCHAR) FROM law_graph WHERE {MATCH} AND o IN (SELECT node FROM tb)")
    if q.articles:
        branches.append(f"SELECT s, CAST(NULL AS VARCHAR) FROM law_graph WHERE p = 'dct:source' AND regexp_matches(o, '{q.cited}')")
    flagged = f" AND s IN (SELECT s FROM law_graph WHERE p = '{q.flag}' AND o = 'true')" if q.flag else ""
    branches += [f"SELECT s, o FROM law_graph WHERE p = '{p}'{typed(t)}{flagged}" for t, p in q.values]
    heads.append(f"rw(concept, value) AS ({' UNION '.join(branches)})")
    joins = "".join(f" LEFT JOIN (SELECT s AS s_{c}, o AS {c} FROM law_graph WHERE {OPTIONAL[c]}) ON s_{c} = concept" for c in q.optional)
    return f"WITH {', '.join(heads)} SELECT DISTINCT {', '.join(q.columns)} FROM rw{joins}"


def registered(name: str, question: ops.Question) -> None:
    @query(name, sql_of(question))
    def _(t):
        return ops.answered(t.law_graph, question)


for _name, _question in ops.QUESTIONS.items():
    registered(_name, _question)
