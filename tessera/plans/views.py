"""Views on the driver tables: concepts, terms, logs, hierarchies and statements, as SQL that Spark and DuckDB both take.

A name in braces is a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "concepts": """
SELECT p_partkey AS seq, concat('part:', CAST(p_partkey AS STRING)) AS key,
       concat(CASE WHEN p_size % 5 = 0 THEN split_part(p_name, ' ', 1)
                   ELSE concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2)) END,
              upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS name,
       p_type AS label, concat(p_name, ' of type ', p_type, ' by ', p_brand) AS definition,
       CASE WHEN p_size % 5 = 0 THEN 'property' ELSE 'class' END AS kind, p_brand AS family, p_name AS plain FROM {part}""",
    "terms": """
SELECT concat('term:', lpad(CAST(m AS STRING), 9, '0')) AS iri,
       concat(upper(substr(split_part(n, ' ', 1), 1, 1)), substr(split_part(n, ' ', 1), 2),
              upper(substr(split_part(n, ' ', 2), 1, 1)), substr(split_part(n, ' ', 2), 2)) AS name,
       CASE WHEN m % 3 = 0 THEN concat(split_part(n, ' ', 2), ' ', split_part(n, ' ', 1)) WHEN m % 3 = 1 THEN concat(n, 's') ELSE n END AS label,
       CASE WHEN z = 0 THEN 'class' ELSE 'property' END AS kind,
       concat('term:', lpad(CAST(min(m) OVER (PARTITION BY split_part(n, ' ', 1)) AS STRING), 9, '0')) AS parent
FROM (SELECT p_name AS n, p_size % 2 AS z, min(p_partkey) AS m FROM {part} GROUP BY p_name, p_size % 2) AS t""",
    "decisions": """
SELECT event_id AS seq, concat('s', CAST(user_id % 2 AS STRING)) AS source_id, 'mapping' AS target, concat('u', CAST(user_id AS STRING)) AS concept_key,
       CASE WHEN event_type = 'signup' THEN '' ELSE concat('t', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 AS STRING)) END AS dpv_iri,
       CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' WHEN 'error' THEN 'pending' ELSE 'no_match' END AS decision,
       CASE WHEN event_type IN ('purchase', 'click') THEN
         CASE event_id % 5 WHEN 0 THEN 'exactMatch' WHEN 1 THEN 'closeMatch' WHEN 2 THEN 'broadMatch' WHEN 3 THEN 'narrowMatch' ELSE 'relatedMatch' END END AS relation,
       concat('r', CAST(user_id % 3 AS STRING)) AS reviewer, ts AS decided_at FROM {events}""",
    "edges": "SELECT p_partkey AS child, CAST(floor(p_partkey / 3) AS BIGINT) AS parent FROM {part} WHERE p_partkey > 0",
    "cyclic_edges": "SELECT child, parent FROM {edges} UNION ALL SELECT CAST(0 AS BIGINT), CAST(27 AS BIGINT)",
    "triples": """
SELECT concat('http://ex.org/region#', CAST(r_regionkey AS STRING)) AS s, 'rdf:type' AS p, 'owl:Class' AS o, 'iri' AS o_kind, CAST(NULL AS STRING) AS dt, CAST(NULL AS STRING) AS lang, 'region' AS origin FROM {region}
UNION ALL SELECT concat('http://ex.org/region#', CAST(r_regionkey AS STRING)), 'rdfs:label', r_name, 'literal', 'xsd:string', NULL, 'region' FROM {region}
UNION ALL SELECT concat('http://ex.org/nation#', CAST(n_nationkey AS STRING)), 'rdf:type', 'owl:Class', 'iri', NULL, NULL, 'nation' FROM {nation}
UNION ALL SELECT concat('http://ex.org/nation#', CAST(n_nationkey AS STRING)), 'rdfs:label', n_name, 'literal', 'xsd:string', NULL, 'nation' FROM {nation}
UNION ALL SELECT concat('http://ex.org/nation#', CAST(n_nationkey AS STRING)), 'rdfs:subClassOf', concat('http://ex.org/region#', CAST(n_regionkey AS STRING)), 'iri', NULL, NULL, 'nation' FROM {nation}
UNION ALL SELECT concat('http://ex.org/customer/', CAST(c_custkey AS STRING)), 'rdf:type', concat('http://ex.org/nation#', CAST(c_nationkey AS STRING)), 'iri', NULL, NULL, 'customer' FROM {customer}
UNION ALL SELECT concat('http://ex.org/customer/', CAST(c_custkey AS STRING)), 'ex:segment', c_mktsegment, 'literal', 'xsd:string', NULL, 'customer' FROM {customer}
UNION ALL SELECT concat('http://ex.org/supplier/', CAST(s_suppkey AS STRING)), 'rdf:type', 'owl:ObjectProperty', 'iri', NULL, NULL, 'supplier' FROM {supplier}
UNION ALL SELECT concat('http://ex.org/supplier/', CAST(s_suppkey AS STRING)), 'rdf:type', 'owl:DatatypeProperty', 'iri', NULL, NULL, 'supplier' FROM {supplier} WHERE s_suppkey % 4 = 0
UNION ALL SELECT concat('http://ex.org/supplier/', CAST(s_suppkey AS STRING)), 'skos:prefLabel', s_name, 'literal', 'rdf:langString', CASE WHEN s_suppkey % 3 = 0 THEN 'es' ELSE 'en-GB' END, 'supplier' FROM {supplier}
UNION ALL SELECT concat('http://ex.org/supplier/', CAST(s_suppkey AS STRING)), 'rdfs:domain', concat('http://ex.org/nation#', CAST(s_nationkey AS STRING)), 'iri', NULL, NULL, 'supplier' FROM {supplier}
UNION ALL SELECT concat('http://ex.org/doc#', CAST(doc_id AS STRING)), 'rdfs:label', text, 'literal', 'rdf:langString', lang, 'documents' FROM {documents}
UNION ALL SELECT concat('http://ex.org/doc#', CAST(doc_id AS STRING)), 'skos:exactMatch', concat('https://w3id.org/dpv#', source), 'iri', NULL, NULL, 'documents' FROM {documents} WHERE doc_id % 3 = 0""",
    "law_nodes": """
SELECT p_partkey AS k, p_name AS label, p_size AS size,
       CASE p_partkey WHEN 3 THEN 'onto:Rights' WHEN 4 THEN 'onto:Principles' WHEN 5 THEN 'onto:Special_personal_data_categories' WHEN 6 THEN 'op:Corrective_measures'
         WHEN 7 THEN 'onto:Sanctions' WHEN 8 THEN 'op:Transfer_or_communication' ELSE concat('c:', CAST(p_partkey AS STRING)) END AS iri,
       CASE p_partkey WHEN 3 THEN 'dpv:DataSubjectRight' WHEN 4 THEN 'dpv:LegalBasis' WHEN 5 THEN 'dpv:Principle' WHEN 6 THEN 'dpv:SpecialCategoryPersonalData'
         WHEN 7 THEN 'dpv:DataTransferLegalBasis' WHEN 8 THEN 'dpv:SafeguardForDataTransfer' WHEN 10 THEN 'dpv:SensitivePersonalData' ELSE concat('dpv:t', CAST(p_partkey AS STRING)) END AS term FROM {part}""",
    "law_graph": """
SELECT a.iri AS s, 'rdfs:subClassOf' AS p, b.iri AS o, 'iri' AS o_kind FROM {law_nodes} AS a JOIN {law_nodes} AS b ON b.k = CAST(floor(a.k / 3) AS BIGINT) WHERE a.k > 0
UNION ALL SELECT a.term, CASE WHEN a.k % 2 = 0 THEN 'rdfs:subClassOf' ELSE 'skos:broader' END, b.term, 'iri' FROM {law_nodes} AS a JOIN {law_nodes} AS b ON b.k = CAST(floor(a.k / 3) AS BIGINT) WHERE a.k > 0
UNION ALL SELECT iri, 'rdfs:label', label, 'literal' FROM {law_nodes} WHERE size % 10 <> 0
UNION ALL SELECT a.iri, CASE a.k % 4 WHEN 0 THEN 'skos:exactMatch' WHEN 1 THEN 'skos:closeMatch' WHEN 2 THEN 'skos:broadMatch' ELSE 'skos:relatedMatch' END, b.term, 'iri' FROM {law_nodes} AS a JOIN {law_nodes} AS b ON b.k = CAST(floor(a.k * 5 / 7) AS BIGINT) WHERE a.size % 3 = 0
UNION ALL SELECT iri, 'dct:source', concat('the law, art. ', CAST(k % 77 AS STRING)), 'literal' FROM {law_nodes} WHERE size % 4 = 1
UNION ALL SELECT iri, 'dct:source', concat('art. ', CAST(k % 77 AS STRING), ', second paragraph'), 'literal' FROM {law_nodes} WHERE size % 8 = 1
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), 'rdf:type', 'owl:NamedIndividual', 'iri' FROM {customer} WHERE c_custkey % 2 = 0
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), 'rdf:type', CASE c_nationkey % 12 WHEN 0 THEN 'onto:Rights' WHEN 1 THEN 'onto:Principles' WHEN 2 THEN 'onto:Special_personal_data_categories' WHEN 3 THEN 'onto:Corrective_measures'
  WHEN 4 THEN 'onto:Violations' WHEN 5 THEN 'onto:Sensitive_data' WHEN 6 THEN 'onto:Members_of_the_personal_data_protection_system' WHEN 7 THEN 'onto:Right_of_access' WHEN 8 THEN 'op:Notification' WHEN 9 THEN 'onto:Consent' ELSE 'onto:Person' END, 'iri' FROM {customer}
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), CASE c_nationkey % 12 WHEN 0 THEN 'onto:are_constituted_of' WHEN 1 THEN 'onto:are_composed_of' WHEN 2 THEN 'onto:special_categories_of_personal_data_are_composed_of' ELSE 'onto:are_comprised_of' END,
  concat('c:', CAST(c_custkey + 8 AS STRING)), 'iri' FROM {customer} WHERE c_nationkey % 12 IN (0, 1, 2, 4)
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), CASE c_nationkey % 12 WHEN 6 THEN 'onto:are_composed_of' WHEN 7 THEN 'onto:right_account_encumbered' ELSE 'onto:responsable_de_canalizar_el_ejercicio_de_derechos' END,
  concat('i:', CAST(c_custkey + 1 AS STRING)), 'iri' FROM {customer} WHERE c_nationkey % 12 IN (0, 6, 7)
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), CASE c_nationkey % 12 WHEN 3 THEN 'onto:what_will_be_the_corrective_measures' WHEN 5 THEN 'onto:data_related_to' WHEN 8 THEN 'op:Security_notification_of_infringement' WHEN 9 THEN 'onto:valid' WHEN 10 THEN 'onto:age' ELSE 'onto:conditions_for_legitimate_treatment' END,
  c_mktsegment, 'literal' FROM {customer} WHERE c_nationkey % 12 IN (3, 5, 8, 9, 10, 11)
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), CASE WHEN c_nationkey % 12 = 8 THEN 'op:time_of_a_vulnerability_notification' WHEN c_custkey % 3 = 0 THEN 'op:right_of_access_time' ELSE 'onto:deadline_in_days_for_the_right_of_access' END,
  CAST(c_custkey % 30 AS STRING), 'literal' FROM {customer} WHERE c_nationkey % 12 IN (7, 8)
UNION ALL SELECT concat('i:', CAST(c_custkey AS STRING)), 'onto:can_give_explicit_consent_to_treatment', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, 'literal' FROM {customer} WHERE c_nationkey % 12 = 10""",
    "shape_graph": """
SELECT DISTINCT concept_key AS s, concat('skos:', relation) AS p, concat('https://w3id.org/dpv#', dpv_iri) AS o, 'iri' AS o_kind, CAST(NULL AS STRING) AS dt, CAST(NULL AS STRING) AS lang FROM {decisions} WHERE relation IS NOT NULL
UNION ALL SELECT DISTINCT concept_key, 'rdf:type', 'owl:Class', 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE TRY_CAST(substr(concept_key, 2) AS BIGINT) % 4 <> 0
UNION ALL SELECT concept_key, 'rdfs:label', CASE WHEN seq % 7 = 0 THEN ' ' ELSE concat('label ', CAST(seq AS STRING)) END, 'literal', CASE WHEN seq % 5 = 0 THEN 'rdf:langString' ELSE 'xsd:string' END,
 CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 11 = 0 THEN NULL WHEN seq % 8 = 0 AND TRY_CAST(substr(concept_key, 2) AS BIGINT) % 3 <> 1 THEN 'es' WHEN TRY_CAST(substr(concept_key, 2) AS BIGINT) % 5 = 2 THEN 'fr' ELSE 'en-GB' END FROM {decisions} WHERE seq % 4 = 0
UNION ALL SELECT concept_key, 'skos:definition', concat('defined by ', reviewer), 'literal', 'rdf:langString', CASE WHEN seq % 9 = 0 THEN NULL ELSE 'en' END FROM {decisions} WHERE seq % 6 = 0 AND TRY_CAST(substr(concept_key, 2) AS BIGINT) % 3 <> 2
UNION ALL SELECT concept_key, 'dct:source', CASE WHEN TRY_CAST(substr(concept_key, 2) AS BIGINT) % 7 = 1 THEN 'no such place' ELSE concat('the law, art. ', CAST(seq % 77 AS STRING)) END, 'literal', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE seq % 12 = 0
UNION ALL SELECT concat('_:', CAST(seq AS STRING)), 'owl:annotatedSource', concept_key, 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE dpv_iri <> '' AND seq % 5 = 1
UNION ALL SELECT concat('_:', CAST(seq AS STRING)), 'owl:annotatedTarget', concat('https://w3id.org/dpv#', dpv_iri), 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE dpv_iri <> '' AND seq % 5 = 1
UNION ALL SELECT concat('_:', CAST(seq AS STRING)), 'decidedBy', reviewer, 'literal', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE dpv_iri <> '' AND seq % 5 = 1 AND seq % 13 <> 0
UNION ALL SELECT concat('_:', CAST(seq AS STRING)), 'owl:versionInfo', '1', 'literal', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {decisions} WHERE dpv_iri <> '' AND seq % 5 = 1 AND seq % 17 <> 0
UNION ALL SELECT concat('m:', CAST(c_custkey AS STRING)), 'owl:imports', concat('m:n', CAST(c_nationkey AS STRING)), 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {customer}
UNION ALL SELECT concat('m:n', CAST(n_nationkey AS STRING)), 'rdf:type', 'owl:Ontology', 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {nation} WHERE n_regionkey < 3
UNION ALL SELECT 'm:old', 'owl:versionIRI', concat('m:n', CAST(n_nationkey AS STRING)), 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {nation} WHERE n_regionkey = 3""",
    "gold": """
SELECT d.doc_id AS key, CASE WHEN l.quality = 1 THEN 'aligned' ELSE 'no_match' END AS status, d.lang AS term, l.toxic, l.quality,
       least(CAST(1.0 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / 4000) AS score, CASE WHEN d.n_chars % 3 = 0 THEN 'fr' ELSE d.lang END AS predicted,
       CASE WHEN d.n_chars > 3000 THEN 'high' WHEN d.n_chars > 1000 THEN 'medium' ELSE 'low' END AS confidence
FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id""",
}


def _names(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


class Inputs:
    """Tables and views of one folder as DataFrames: Inputs(spark, dir).part, .concepts, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            sql = VIEWS[name]
            return self.spark.sql(sql, **{n: getattr(self, n) for n in set(_names(sql))})
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """A DuckDB query with the views that it names put in front."""
    needed: list[str] = []

    def need(text: str, names) -> None:
        for name in names:
            if name in VIEWS and name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name], [n for n in _names(VIEWS[name])])
                needed.append(name)

    need(sql, list(VIEWS))
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    body = sql[own.end() :] if own else sql
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in needed}
    heads = ",\n".join(f"{n} AS ({s})" for n, s in plain.items())
    if not heads:
        return sql
    return f"WITH RECURSIVE {heads}{',' if own else ''}\n{body}"
