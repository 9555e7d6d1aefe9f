"""Registered queries of the profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import humanize, trim_words
from tessera.operators import profile as ops
from tessera.plans.registry import query

LOCAL = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '[^#]*$') ELSE regexp_extract({0}, '[^/]*$') END"
PRIMARY = "lower(split_part(lang, '-', 1))"


@query("p01_graph_union", "SELECT DISTINCT s, p, o, dt, lang FROM triples")
def _(t):
    graph = t.triples
    return ops.graph_union(graph, graph.where("origin = 'nation'")).select(*ops.STATEMENT)


@query("p02_pattern", "SELECT s, o FROM triples WHERE p = 'rdf:type' AND o = 'owl:Class'")
def _(t):
    return ops.match(t.triples, p="rdf:type", o="owl:Class").select("s", "o")


@query("p03_local_name", f"SELECT iri, l AS local, substr(iri, 1, length(iri) - length(l)) AS namespace FROM (SELECT DISTINCT url AS iri, {LOCAL.format('url')} AS l FROM pages)")
def _(t):
    return ops.localized(t.pages.select(F.col("url").alias("s")))


@query("p04_humanize", r"SELECT key, trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')) AS words FROM concepts")
def _(t):
    return t.concepts.select("key", humanize(F.col("name")).alias("words"))


@query("p05_trim_text", r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE concat(regexp_extract(substr(x, 1, 240), '^(.*) ', 1), '...') END AS short FROM f""")
def _(t):
    return t.documents.select("doc_id", trim_words(F.col("text")).alias("short"))


@query("p06_first_literal", """
SELECT s, o FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY CASE p WHEN 'rdfs:label' THEN 0 ELSE 1 END, o) AS k
FROM triples WHERE p IN ('rdfs:label', 'skos:prefLabel') AND o_kind = 'literal') WHERE k = 1""")
def _(t):
    return ops.first_literal(t.triples, ["rdfs:label", "skos:prefLabel"])


@query("p07_literal_language", f"""
SELECT s, o, lang FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE {PRIMARY} WHEN 'es' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, o, lang) AS k
FROM triples WHERE p = 'skos:prefLabel') WHERE k = 1""")
def _(t):
    return ops.literal_by_language(t.triples, "skos:prefLabel", ["es", "en"])


@query("p08_borrowed", "SELECT url FROM pages WHERE NOT (url LIKE 'http://www.w3.org/%' OR url LIKE 'http://purl.org/%' OR url LIKE 'http://xmlns.com/%')")
def _(t):
    return t.pages.where(~ops.is_borrowed(F.col("url"))).select("url")


@query("p09_kinds", """
SELECT s, string_agg(DISTINCT CASE o WHEN 'owl:Class' THEN 'class' WHEN 'owl:ObjectProperty' THEN 'object' ELSE 'data' END, ',' ORDER BY CASE o WHEN 'owl:Class' THEN 'class' WHEN 'owl:ObjectProperty' THEN 'object' ELSE 'data' END) AS kinds
FROM triples WHERE p = 'rdf:type' AND o IN ('owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty') GROUP BY s""")
def _(t):
    kinds = ops.kinds_of(t.triples, {"owl:Class": "class", "owl:ObjectProperty": "object", "owl:DatatypeProperty": "data"})
    return kinds.select("s", F.array_join("kinds", ",").alias("kinds"))


@query("p10_undeclared", "SELECT DISTINCT p AS s FROM triples WHERE p NOT IN (SELECT s FROM triples WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty'))")
def _(t):
    return ops.undeclared_properties(t.triples, ["owl:ObjectProperty", "owl:DatatypeProperty"])


@query("p11_dataset_profile", """
WITH k AS (SELECT s, count(DISTINCT o) AS c FROM triples WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty') GROUP BY s),
n AS (SELECT count(*) AS n_statements, count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND o = 'owl:Class') AS n_classes,
 count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty') AS n_object,
 count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND o = 'owl:DatatypeProperty') AS n_data, (SELECT count(*) FROM k WHERE c > 1) AS n_both FROM triples)
SELECT *, CASE WHEN n_both > 0 THEN 'owl-full' WHEN n_object + n_data > 0 THEN 'dl-compatible' WHEN n_classes > 0 THEN 'rdfs' ELSE 'unknown' END AS flavour FROM n""")
def _(t):
    return ops.dataset_profile(t.triples)


@query("p12_concept_table", """
SELECT origin, kind, count(DISTINCT s) AS n FROM (SELECT s, origin, CASE o WHEN 'owl:Class' THEN 'class' ELSE 'other' END AS kind FROM triples WHERE p = 'rdf:type'
 AND NOT (s LIKE 'http://www.w3.org/%' OR s LIKE 'http://purl.org/%' OR s LIKE 'http://xmlns.com/%')) GROUP BY ALL""")
def _(t):
    typed = ops.match(t.triples, p="rdf:type")
    return ops.concept_table(typed.select(F.col("s").alias("iri"), "origin", F.when(F.col("o") == "owl:Class", "class").otherwise("other").alias("kind")))


@query("p13_proposed", """
SELECT name, CASE WHEN lower(substr(name, 1, 1)) = substr(name, 1, 1) AND upper(substr(name, 1, 1)) <> substr(name, 1, 1) THEN 'property' ELSE 'class' END AS kind, seq
FROM (SELECT name, seq, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS k FROM concepts) WHERE k = 1""")
def _(t):
    return ops.proposed_concepts(t.concepts.select("name", "seq"))


@query("p14_terms", """
WITH c AS (SELECT parent AS iri, count(*) AS n_children FROM terms WHERE parent <> iri GROUP BY parent)
SELECT t.iri, kind, parent AS parents, coalesce(n_children, 0) AS n_children FROM terms t LEFT JOIN c ON t.iri = c.iri""")
def _(t):
    return ops.target_terms(t.terms).withColumn("parents", F.array_join("parents", ","))


@query("p15_compatible", "SELECT c.kind, count(*) AS n, count(DISTINCT t.iri) AS n_terms FROM concepts c JOIN terms t ON c.kind = t.kind GROUP BY c.kind")
def _(t):
    pairs = ops.compatible_pairs(t.concepts.select("key", "kind"), t.terms.select("iri", "kind"))
    return pairs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t_iri").alias("n_terms"))


@query("p16_semantic_text", r"""
WITH h AS (SELECT key, label, definition, regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS w FROM concepts)
SELECT key, concat_ws('. ', w, CASE WHEN lower(label) <> lower(w) THEN label END, definition) AS semantic FROM h""")
def _(t):
    return ops.with_semantic_text(t.concepts).select("key", "semantic")


@query("p17_namespaces", f"""
WITH i AS (SELECT s AS iri FROM triples UNION ALL SELECT o FROM triples WHERE o_kind = 'iri'),
l AS (SELECT iri, {LOCAL.format('iri')} AS l FROM i WHERE iri LIKE 'http://%' OR iri LIKE 'https://%')
SELECT substr(iri, 1, length(iri) - length(l)) AS namespace, count(*) AS n FROM l GROUP BY 1""")
def _(t):
    return ops.used_namespaces(t.triples)


@query("p18_predicates", f"""
SELECT p, count(*) AS uses, count(DISTINCT s) AS subjects, count(*) FILTER (WHERE o_kind = 'literal') AS literals,
 coalesce(string_agg(DISTINCT {PRIMARY}, ',' ORDER BY {PRIMARY}), '') AS languages FROM triples GROUP BY p""")
def _(t):
    return ops.predicate_summary(t.triples)


@query("p19_label_inventory", f"""
WITH l AS (SELECT s, CASE WHEN lang IS NULL THEN NULL ELSE {PRIMARY} END AS tag FROM triples WHERE p IN ('rdfs:label', 'skos:prefLabel') AND trim(o) <> ''),
g AS (SELECT s, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS languages, count(*) FILTER (WHERE tag IS NULL) AS n_untagged,
 coalesce(bool_or(tag = 'en'), false) AS en, coalesce(bool_or(tag = 'es'), false) AS es FROM l GROUP BY s)
SELECT s, languages, n_untagged, CASE WHEN en AND es THEN '' WHEN en THEN 'es' WHEN es THEN 'en' ELSE 'en,es' END AS missing FROM g""")
def _(t):
    return ops.label_inventory(t.triples.where("p in ('rdfs:label', 'skos:prefLabel')"))


@query("p20_final_labels", """
WITH h AS (SELECT s, min(o) AS o FROM triples WHERE p = 'rdfs:label' AND lang = 'es' GROUP BY s), a AS (SELECT s, min(o) AS o FROM triples WHERE p = 'rdfs:label' GROUP BY s)
SELECT coalesce(h.s, a.s) AS s, coalesce(h.o, a.o) AS label, CASE WHEN h.o IS NOT NULL THEN 'existing' WHEN a.o IS NOT NULL THEN 'added' ELSE 'pending' END AS status
FROM h FULL JOIN a ON h.s = a.s""")
def _(t):
    labels = t.triples.where("p = 'rdfs:label'")
    one = lambda df: df.groupBy("s").agg(F.min("o").alias("o"))
    return ops.final_labels(one(labels.where("lang = 'es'")), one(labels))


@query("p21_glossary", "SELECT label AS key, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM concepts GROUP BY label")
def _(t):
    return ops.glossary(t.concepts.select(F.col("label").alias("key"), "name"))


@query("p22_article_links", r"SELECT url AS iri, CAST(regexp_extract(url, '/([0-9]+)', 1) AS INT) AS article FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''")
def _(t):
    return ops.article_links(t.pages.select(F.col("url").alias("iri")), "/([0-9]+)")
