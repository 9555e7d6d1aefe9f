"""Registered queries of the graph, shape and law operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import local_name
from tessera.operators import graph as ops
from tessera.operators import laws, shapes
from tessera.plans.registry import query

CLOSURE = "WITH cl AS (SELECT child, parent FROM {0} UNION SELECT c.child, e.parent FROM cl c JOIN {0} e ON e.child = c.parent)"


def below(root: str) -> str:
    return f"WITH b AS ({root} UNION SELECT e.child FROM edges e JOIN b ON e.parent = b.node)"


@query("h01_family", """
WITH w AS (SELECT child AS node, child AS at, CASE WHEN child IN (1, 2) THEN child END AS family, 0 AS depth FROM (SELECT child FROM edges UNION SELECT parent FROM edges) n(child)
 UNION ALL SELECT w.node, e.parent, coalesce(w.family, CASE WHEN e.parent IN (1, 2) THEN e.parent END), depth + 1 FROM w JOIN edges e ON e.child = w.at)
SELECT node AS child, family, depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS k FROM w) WHERE k = 1""")
def _(t):
    return ops.ancestry(t.edges, t.spark.createDataFrame([(1,), (2,)], "node bigint"))


@query("h02_depth", "WITH w AS (SELECT child, parent, 1 AS depth FROM edges UNION ALL SELECT w.child, e.parent, depth + 1 FROM w JOIN edges e ON e.child = w.parent) SELECT child, max(depth) AS depth FROM w GROUP BY child")
def _(t):
    return ops.ancestry(t.edges, t.spark.createDataFrame([], "node bigint")).where("depth > 0").select("child", "depth")


@query("h03_sub_properties", f"{below('SELECT CAST(5 AS BIGINT) AS node')} SELECT node FROM b")
def _(t):
    return ops.descendants(t.edges, t.spark.createDataFrame([(5,)], "node bigint"))


@query("h04_descends_from", f"{below('SELECT seq AS node FROM concepts WHERE contains(lower(name), {0})'.format(chr(39) + 'bluerod' + chr(39)))} SELECT node FROM b")
def _(t):
    return ops.descendants(t.edges, t.concepts.where(F.lower("name").contains("bluerod")).select(F.col("seq").alias("node")))


MODULES = "modules AS (SELECT child AS node, CASE WHEN child % 10 = 3 THEN 'profile' ELSE 'core' END AS module FROM (SELECT child FROM edges UNION SELECT parent FROM edges) n(child))"


def modules(t):
    nodes = t.edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    return nodes.withColumn("module", F.when(F.col("node") % 10 == 3, "profile").otherwise("core"))


@query("h06_cross_references", f"WITH {MODULES} SELECT child, parent FROM edges JOIN modules a ON a.node = child AND a.module = 'core' JOIN modules b ON b.node = parent AND b.module = 'profile'")
def _(t):
    return ops.cross_references(t.edges, modules(t))


@query("h07_closure", f"{CLOSURE.format('cyclic_edges')} SELECT child, parent FROM cl")
def _(t):
    return ops.closure(t.cyclic_edges)


@query("h08_autonomy", f"WITH {MODULES}, r AS (SELECT node FROM modules WHERE module = 'profile' UNION SELECT e.child FROM edges e JOIN r ON e.parent = r.node) SELECT node, CASE WHEN node IN (SELECT node FROM r) THEN 'profile' ELSE 'core' END AS module FROM modules")
def _(t):
    return ops.moved(t.edges, modules(t))


@query("h09_individuals", "SELECT s, CASE WHEN bool_or(CAST(regexp_extract(o, '[0-9]+$') AS INT) % 4 = 1) THEN 'profile' ELSE 'core' END AS module FROM triples WHERE p = 'rdf:type' AND origin = 'customer' GROUP BY s")
def _(t):
    nation = F.regexp_extract("o", "[0-9]+$", 0).try_cast("int")
    types = t.triples.where("p = 'rdf:type' and origin = 'customer'").select("s", "o")
    return ops.individuals_module(types, types.select(F.col("o").alias("node"), F.when(nation % 4 == 1, "profile").otherwise("core").alias("module")).distinct())


@query("h10_description", """WITH g AS (SELECT s, p, CASE WHEN p = 'rdfs:domain' THEN concat('_:', o) ELSE o END AS o FROM triples WHERE origin = 'supplier' UNION ALL SELECT concat('_:', s), p, o FROM triples WHERE origin = 'nation'),
b AS (SELECT DISTINCT s AS node FROM g WHERE s LIKE 'http://ex.org/supplier/1%' UNION SELECT g.o FROM g JOIN b ON g.s = b.node WHERE g.o LIKE '_:%') SELECT s, p, o FROM g WHERE s IN (SELECT node FROM b)""")
def _(t):
    own = t.triples.where("origin = 'supplier'").select("s", "p", F.when(F.col("p") == "rdfs:domain", F.concat(F.lit("_:"), "o")).otherwise(F.col("o")).alias("o"))
    graph = own.unionByName(t.triples.where("origin = 'nation'").select(F.concat(F.lit("_:"), "s").alias("s"), "p", "o"))
    graph = graph.withColumn("o_kind", F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri"))
    return ops.bounded_description(graph, graph.where("s like 'http://ex.org/supplier/1%'").select("s").distinct()).select("s", "p", "o")


@query("h12_double_types", "SELECT s, 'data' AS kind FROM triples WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty') GROUP BY s HAVING count(DISTINCT o) = 2")
def _(t):
    return ops.double_typed(t.triples)


@query("h13_union_domains", "WITH m AS (SELECT c_mktsegment AS s, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ' ' ORDER BY CAST(c_nationkey AS VARCHAR)) AS members, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1) SELECT s, concat('union-', substr(sha256(members), 1, 12)) AS node, members FROM m WHERE n > 1")
def _(t):
    graph = t.customer.select(F.col("c_mktsegment").alias("s"), F.lit("rdfs:domain").alias("p"), F.col("c_nationkey").cast("string").alias("o"))
    return ops.union_domains(graph, "rdfs:domain")


@query("g01_aligned", "SELECT DISTINCT s FROM triples WHERE p IN ('skos:exactMatch', 'skos:closeMatch', 'skos:broadMatch') AND o LIKE 'https://w3id.org/dpv#%' AND s NOT LIKE 'https://w3id.org/dpv#%'")
def _(t):
    return ops.aligned(t.triples, "https://w3id.org/dpv#")


#: The roots of the six questions on what is aligned below one term.
ROOTS = {"g02_right": 1, "g03_basis": 2, "g04_purpose": 4, "g05_data": 7, "g06_entity": 13, "g07_processing": 22}


def under(name: str, root: int) -> None:
    @query(name, f"{below(f'SELECT CAST({root} AS BIGINT) AS node')} SELECT key AS concept, seq AS term FROM concepts WHERE kind = 'class' AND seq IN (SELECT node FROM b)")
    def _(t):
        matches = t.concepts.where("kind = 'class'").select(F.col("key").alias("concept"), F.col("seq").alias("term"))
        return ops.aligned_under(matches, ops.Steps(t.edges), t.spark.createDataFrame([(root,)], "node bigint")).drop("root")


for _name, _root in ROOTS.items():
    under(_name, _root)


@query("g_all_roots", f"WITH RECURSIVE b AS (SELECT r AS root, r AS node FROM (SELECT CAST(unnest({list(ROOTS.values())}) AS BIGINT) AS r) UNION SELECT b.root, e.child FROM edges e JOIN b ON e.parent = b.node) SELECT root, key AS concept, seq AS term FROM concepts JOIN b ON node = seq WHERE kind = 'class'")
def _(t):
    """The six questions in one run over one index."""
    matches = t.concepts.where("kind = 'class'").select(F.col("key").alias("concept"), F.col("seq").alias("term"))
    return ops.aligned_under(matches, ops.Steps(t.edges), t.spark.createDataFrame([(r,) for r in ROOTS.values()], "node bigint"))


@query("g08_citing", "SELECT s, o FROM law_graph WHERE o_kind = 'literal' AND contains(lower(o), 'art. 1')")
def _(t):
    return ops.citing(t.law_graph, "Art. 1")


@query("q02_row_keys", "SELECT DISTINCT concat_ws(' ', CASE WHEN s LIKE '%#%' THEN split_part(s, '#', 2) ELSE regexp_extract(s, '[^/]*$') END, o) AS row_key FROM triples WHERE p = 'ex:segment'")
def _(t):
    return ops.answer_keys(t.triples.where("p = 'ex:segment'").select("s", "o"), ["s", "o"]).select("row_key").distinct()


@query("q03_judge_value", r"SELECT source AS qid, bool_or(list_contains(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')), '2.0')) AS green FROM documents GROUP BY source")
def _(t):
    return ops.judged_value(t.documents.select(F.col("source").alias("qid"), "text", F.lit("2.0").alias("expected")))


@query("q04_judge_count", "SELECT c_mktsegment AS qid, count(DISTINCT c_nationkey) AS n, count(DISTINCT c_nationkey) >= 20 AS green FROM customer GROUP BY 1")
def _(t):
    return ops.judged_count(t.customer.select(F.col("c_mktsegment").alias("qid"), F.col("c_nationkey").alias("concept")), 20)


@query("q07_compare", """WITH a AS (SELECT DISTINCT p AS qid, o AS k FROM triples WHERE origin IN ('customer', 'nation')), b AS (SELECT DISTINCT p AS qid, o AS k FROM triples WHERE origin IN ('nation', 'region', 'supplier'))
SELECT coalesce(a.qid, b.qid) AS qid, count(*) FILTER (WHERE b.qid IS NULL) AS only_one, count(*) FILTER (WHERE a.qid IS NULL) AS only_other FROM a FULL JOIN b ON a.qid = b.qid AND a.k = b.k GROUP BY 1""")
def _(t):
    rows = lambda names: t.triples.where(F.col("origin").isin(names)).select(F.col("p").alias("qid"), F.col("o").alias("row_key"))
    return ops.compared(rows(["customer", "nation"]), rows(["nation", "region", "supplier"]))


def finding(name: str, rule: str, severity: str, sql: str):
    """sql gives focus and value."""
    return query(name, f"SELECT '{rule}' AS rule, '{severity}' AS severity, CAST(focus AS VARCHAR) AS focus, CAST(value AS VARCHAR) AS value FROM ({sql})")


@finding("v01_term_exists", "term_exists", "violation", "SELECT l_orderkey AS focus, l_partkey AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def _(t):
    return shapes.term_exists(t.lineitem.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("o")), t.part.where("p_size > 5").select(F.col("p_partkey").alias("o")))


HELD = "SELECT concept_key AS focus, dpv_iri AS value FROM decisions WHERE relation IS NOT NULL GROUP BY ALL HAVING "
CONFLICT = " OR ".join(f"(bool_or(relation = '{a}') AND bool_or(relation = '{b}'))" for a, b in shapes.DISJOINT)


@finding("v02_conflict", "mapping_conflict", "violation", HELD + CONFLICT)
def _(t):
    return shapes.mapping_conflict(t.decisions.where("relation is not null").select(F.col("concept_key").alias("s"), F.col("dpv_iri").alias("o"), "relation"))


@finding("v03_declared", "declared", "violation", "SELECT DISTINCT o_custkey AS focus, NULL AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return shapes.declared(t.orders.select(F.col("o_custkey").alias("s")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("s")))


@finding("v04_annotation", "annotation_complete", "violation", """SELECT focus, value FROM (SELECT d.concept_key AS focus, CASE WHEN m.s IS NULL THEN 'no statement' WHEN reviewer NOT IN ('r0', 'r1') THEN 'decider' WHEN seq % 50 = 0 THEN 'version' END AS value
 FROM decisions d LEFT JOIN (SELECT DISTINCT concept_key AS s, dpv_iri AS o FROM decisions WHERE decision = 'approved') m ON m.s = d.concept_key AND m.o = d.dpv_iri WHERE d.dpv_iri <> '') WHERE value IS NOT NULL""")
def _(t):
    own = t.decisions.where("dpv_iri <> ''").select(F.col("concept_key").alias("s"), F.col("dpv_iri").alias("o"), F.col("reviewer").alias("decided_by"), F.when(F.col("seq") % 50 != 0, 1).alias("version"))
    return shapes.annotation_complete(own, t.decisions.where("decision = 'approved'").select(F.col("concept_key").alias("s"), F.col("dpv_iri").alias("o")), ["r0", "r1"])


@finding("v05_label_language", "label_language", "violation", "SELECT s AS focus, o AS value FROM triples WHERE p = 'rdfs:label' AND (lang IS NULL OR trim(o) = '')")
def _(t):
    return shapes.text_with_language(t.triples.where("p = 'rdfs:label'"), "label_language")


@finding("v06_definition_language", "definition_language", "violation", "SELECT s AS focus, o AS value FROM shape_graph WHERE p = 'skos:definition' AND (lang IS NULL OR trim(o) = '')")
def _(t):
    return shapes.text_with_language(t.shape_graph.where("p = 'skos:definition'"), "definition_language")


@finding("v07_cites_article", "cites_article", "violation", "SELECT split_part(url, '/', 3) AS focus, count(DISTINCT page_id) AS value FROM pages GROUP BY 1 HAVING NOT bool_or(regexp_matches(url, '/en/')) OR count(DISTINCT page_id) > 1")
def _(t):
    return shapes.cites_article(t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("s"), F.col("url").alias("source"), F.col("page_id").alias("o")), "/en/")


@finding("v08_untagged", "untagged_langstring", "violation", "SELECT s AS focus, o AS value FROM (SELECT s, o, dt, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS lang FROM triples) WHERE dt = 'rdf:langString' AND coalesce(lang, '') = ''")
def _(t):
    return shapes.untagged_langstring(t.triples.withColumn("lang", F.when(F.col("lang") == "fr", "").otherwise(F.col("lang"))))


@finding("v09_imports", "imports_resolved", "violation", "SELECT c_custkey AS focus, c_nationkey AS value FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(t):
    return shapes.imports_resolved(t.customer.select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("o")), t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("o")))


def labelled(name: str, language: str):
    @finding(name, f"label_{language}", "warning", f"SELECT DISTINCT concept_key AS focus, NULL AS value FROM decisions WHERE concept_key NOT IN (SELECT s FROM shape_graph WHERE p = 'rdfs:label' AND lower(split_part(lang, '-', 1)) = '{language}' AND trim(o) <> '')")
    def _(t):
        return shapes.has_label(t.decisions.select(F.col("concept_key").alias("s")), t.shape_graph.where("p = 'rdfs:label'"), language)


labelled("v10_spanish", "es")
labelled("v11_english", "en")


@finding("v12_definition", "definition", "warning", "SELECT doc_id AS focus, NULL AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return shapes.has_definition(t.documents.select(F.col("doc_id").alias("s")), t.labels.select(F.col("doc_id").alias("s"), F.lit("x").alias("o")))


ALL = "SELECT 'label_language' AS rule, 'violation' AS severity, s AS focus FROM triples WHERE p = 'rdfs:label' AND (lang IS NULL OR trim(o) = '') UNION ALL SELECT 'label_es', 'warning', s FROM triples GROUP BY s HAVING NOT bool_or(coalesce(lang = 'es' AND p = 'rdfs:label', false))"


def every_finding(t):
    g = t.triples
    return shapes.all_findings(shapes.text_with_language(g.where("p = 'rdfs:label'"), "label_language"), shapes.has_label(g, g.where("p = 'rdfs:label'"), "es"))


@query("v13_all_findings", f"SELECT rule, severity, focus FROM ({ALL})")
def _(t):
    return every_finding(t).select("rule", "severity", "focus")


HELD_BOTH = " OR ".join(f"(bool_or(p = 'skos:{a}') AND bool_or(p = 'skos:{b}'))" for a, b in shapes.DISJOINT)
TWELVE = f"""g AS (SELECT * FROM shape_graph), m AS (SELECT s, p, o FROM g WHERE p IN ('skos:exactMatch', 'skos:closeMatch', 'skos:broadMatch', 'skos:narrowMatch', 'skos:relatedMatch') AND o LIKE 'https://w3id.org/dpv#%'),
e AS (SELECT DISTINCT s FROM g WHERE p = 'rdf:type' AND o = 'owl:Class'),
n AS (SELECT s AS node, min(o) FILTER (WHERE p = 'owl:annotatedSource') AS s, min(o) FILTER (WHERE p = 'owl:annotatedTarget') AS o, min(o) FILTER (WHERE p = 'decidedBy') AS who, min(o) FILTER (WHERE p = 'owl:versionInfo') AS v FROM g WHERE starts_with(g.s, '_:') GROUP BY g.s),
nr AS (SELECT n.s, CASE WHEN (n.s, n.o) NOT IN (SELECT (s, o) FROM m) THEN 'no statement' WHEN who IS NULL OR who NOT IN ('r0', 'r1') THEN 'decider' WHEN v IS NULL THEN 'version' END AS reason FROM n),
ci AS (SELECT d.s, bool_or(regexp_matches(c.o, 'art[.] ?[0-9]+')) AS cites, count(DISTINCT d.o) AS k FROM g d LEFT JOIN (SELECT s, o FROM g WHERE p = 'dct:source') c ON c.s = d.s WHERE d.p = 'skos:definition' GROUP BY d.s),
f AS (SELECT 'term_exists' AS rule, 'violation' AS severity, s AS focus, o AS value FROM m WHERE o NOT IN (SELECT concat('https://w3id.org/dpv#t', i) FROM range(0, 6) r(i))
UNION ALL SELECT 'mapping_conflict', 'violation', s, o FROM m GROUP BY s, o HAVING {HELD_BOTH}
UNION ALL SELECT DISTINCT 'declared', 'violation', s, NULL FROM m WHERE s NOT IN (SELECT s FROM g WHERE p = 'rdf:type')
UNION ALL SELECT 'annotation_complete', 'violation', s, reason FROM nr WHERE reason IS NOT NULL
UNION ALL SELECT 'label_language', 'violation', s, o FROM g WHERE p = 'rdfs:label' AND (lang IS NULL OR trim(o) = '')
UNION ALL SELECT 'definition_language', 'violation', s, o FROM g WHERE p = 'skos:definition' AND (lang IS NULL OR trim(o) = '')
UNION ALL SELECT 'cites_article', 'violation', s, CAST(k AS VARCHAR) FROM ci WHERE NOT coalesce(cites, false) OR k > 1
UNION ALL SELECT 'untagged_langstring', 'violation', s, o FROM g WHERE dt = 'rdf:langString' AND coalesce(lang, '') = ''
UNION ALL SELECT 'imports_resolved', 'violation', s, o FROM g WHERE p = 'owl:imports' AND o NOT IN (SELECT s FROM g WHERE p = 'rdf:type' AND o = 'owl:Ontology' UNION SELECT o FROM g WHERE p = 'owl:versionIRI')
UNION ALL SELECT 'label_es', 'warning', s, NULL FROM e WHERE s NOT IN (SELECT s FROM g WHERE p = 'rdfs:label' AND lower(split_part(lang, '-', 1)) = 'es' AND trim(o) <> '')
UNION ALL SELECT 'label_en', 'warning', s, NULL FROM e WHERE s NOT IN (SELECT s FROM g WHERE p = 'rdfs:label' AND lower(split_part(lang, '-', 1)) = 'en' AND trim(o) <> '')
UNION ALL SELECT 'definition', 'warning', s, NULL FROM e WHERE s NOT IN (SELECT s FROM g WHERE p = 'skos:definition' AND trim(o) <> ''))"""


def twelve_shapes(t):
    terms = t.spark.range(6).select(F.concat(F.lit("https://w3id.org/dpv#t"), F.col("id").cast("string")).alias("o"))
    return shapes.every_shape(t.shape_graph, "https://w3id.org/dpv#", terms, ["r0", "r1"])


@query("v13_twelve_shapes", f"WITH {TWELVE} SELECT rule, severity, focus, value FROM f")
def _(t):
    return twelve_shapes(t)


@query("v15_twelve_shapes", f"WITH {TWELVE} SELECT rule, severity, count(*) AS n, (SELECT count(*) FROM e) - count(DISTINCT focus) FILTER (WHERE focus IN (SELECT s FROM e)) AS complete FROM f GROUP BY ALL")
def _(t):
    entities = t.shape_graph.where("p = 'rdf:type' and o = 'owl:Class'").select("s").distinct()
    return shapes.completeness_of(twelve_shapes(t), entities)


@query("v14_origins", f"WITH f AS ({ALL}), e AS (SELECT s AS focus, bool_or(origin = 'documents') AS new, bool_or(origin = 'supplier') AS own FROM triples GROUP BY s) SELECT f.focus, rule, CASE WHEN new THEN 'new' WHEN own THEN 'ontology' ELSE 'base' END AS origin FROM f LEFT JOIN e ON e.focus = f.focus")
def _(t):
    evidence = t.triples.select(F.col("s").alias("focus"), (F.col("origin") == "documents").alias("only_system"), (F.col("origin") == "supplier").alias("in_ontology"))
    return shapes.origins(every_finding(t), evidence)


@query("v15_completeness", f"WITH f AS ({ALL}) SELECT rule, severity, count(*) AS n, (SELECT count(DISTINCT s) FROM triples) - count(DISTINCT focus) AS complete FROM f GROUP BY ALL")
def _(t):
    return shapes.completeness(every_finding(t), t.triples)


@query("v16_disjoint", """WITH u AS (SELECT child, parent FROM edges UNION SELECT u.child, e.parent FROM u JOIN edges e ON e.child = u.parent),
ty AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS c FROM lineitem WHERE l_quantity > 40), a AS (SELECT DISTINCT s, c FROM (SELECT s, c FROM ty UNION ALL SELECT s, parent FROM ty JOIN u ON u.child = ty.c))
SELECT CAST(x.s AS VARCHAR) AS focus FROM a x JOIN a y ON x.s = y.s WHERE x.c = 1 AND y.c = 2""")
def _(t):
    types = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("o")).distinct()
    pair = t.spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    classes = pair.select(F.explode(F.array("a", "b")).alias("node"))
    below = ops.Steps(t.edges).below(classes).select(F.col("node").alias("child"), F.col("root").alias("parent"))
    return shapes.disjoint_classes(types, below, pair).select("focus")


PROPS = "(SELECT 'ex:segment' AS p, 'object' AS kind UNION ALL SELECT 'rdfs:domain', 'data')"


def properties(t):
    return t.spark.createDataFrame([("ex:segment", "object"), ("rdfs:domain", "data")], "p string, kind string")


@finding("v17_data_values", "data_property_value", "violation", f"SELECT s AS focus, o AS value FROM triples t JOIN {PROPS} k ON k.p = t.p AND kind = 'data' WHERE o_kind <> 'literal'")
def _(t):
    return shapes.wrong_object_kind(t.triples, properties(t), "data")


@finding("v18_object_values", "object_property_value", "violation", f"SELECT s AS focus, o AS value FROM triples t JOIN {PROPS} k ON k.p = t.p AND kind = 'object' WHERE o_kind = 'literal'")
def _(t):
    return shapes.wrong_object_kind(t.triples, properties(t), "object")


@finding("v19_datatypes", "datatype", "violation", "SELECT event_id AS focus, o AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS o FROM events) WHERE try_cast(o AS BIGINT) IS NULL")
def _(t):
    o = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return shapes.datatype_mismatch(t.events.select(F.col("event_id").alias("s"), o.alias("o"), F.lit("xsd:integer").alias("dt")))


@query("v20_new_findings", f"WITH f AS ({ALL}) SELECT rule, focus, NOT (focus LIKE 'http://ex.org/nation%') AS new FROM f")
def _(t):
    found = every_finding(t)
    return shapes.new_findings(found, found.where("focus like 'http://ex.org/nation%'")).select("rule", "focus", "new")


@query("v21_overall", "SELECT CASE WHEN bool_or(o_orderstatus = 'F') THEN 'red' WHEN bool_or(o_orderstatus = 'P') THEN 'yellow' ELSE 'green' END AS status FROM orders")
def _(t):
    return shapes.overall(t.orders.select(F.when(F.col("o_orderstatus") == "F", "red").when(F.col("o_orderstatus") == "P", "failed").otherwise("green").alias("status")))


@query("v22_diff", "SELECT count(*) FILTER (WHERE origin = 'region') AS missing, CAST(0 AS BIGINT) AS extra, count(*) FILTER (WHERE origin = 'region') = 0 AS same FROM triples")
def _(t):
    return shapes.dataset_diff(t.triples, t.triples.where("origin <> 'region'"))


# laws: the turns of a conversation as numbered articles, with noise between; documents of a source as pages

LAWS = """lw AS (SELECT conv_id AS law, string_agg(concat('ARTICULO ', CAST(5 * turn + 2 AS VARCHAR), chr(10), 'Article ', CAST(turn + 1 AS VARCHAR), ' - Title ', role, '. More', chr(10), text, chr(10), 'see Article 9', chr(10)), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def law_texts(t):
    head = F.concat(F.lit("ARTICULO "), (5 * F.col("turn") + 2).cast("string"), F.lit("\nArticle "), (F.col("turn") + 1).cast("string"), F.lit(" - Title "), "role", F.lit(". More\n"), "text", F.lit("\nsee Article 9\n"))
    return t.conversations.groupBy(F.col("conv_id").alias("law")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", head.alias("h")))), lambda x: x["h"]), "").alias("text"))


PAGES = "pg AS (SELECT source AS doc, doc_id AS page, concat('Header 1', chr(10), replace(text, 'fi', 'ﬁ'), chr(10), '▼M1', chr(10), 'S e c t i o n 1', chr(10), '►C2 changed ◄ words', chr(10), '◄', chr(10), 'last line', chr(10), 'Page ', CAST(doc_id AS VARCHAR), ' of 9') AS text FROM documents)"


def page_texts(t):
    return t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("Header 1\n"), F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("\n▼M1\nS e c t i o n 1\n►C2 changed ◄ words\n◄\nlast line\nPage "), F.col("doc_id").cast("string"), F.lit(" of 9")).alias("text"))


EDGE = f"""{PAGES}, ln AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM pg),
eg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc, page ORDER BY pos DESC) AS down FROM ln WHERE trim(line) <> '') WHERE up <= 2 OR down <= 2),
fu AS (SELECT doc, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS norm FROM eg JOIN (SELECT doc AS d, count(DISTINCT page) AS np FROM pg GROUP BY doc) ON d = doc GROUP BY doc, norm, np HAVING count(DISTINCT page) >= 3 AND 2 * count(DISTINCT page) >= np)"""


@query("t01_furniture", f"WITH {EDGE} SELECT doc, norm FROM fu")
def _(t):
    return laws.furniture(page_texts(t))


@query("t02_cleaned", rf"""WITH {EDGE}, gn AS (SELECT DISTINCT eg.doc, eg.page, eg.pos FROM eg JOIN fu ON fu.doc = eg.doc AND fu.norm = regexp_replace(trim(line), '[0-9]+', '#', 'g')),
k AS (SELECT ln.*, CASE WHEN gn.pos IS NOT NULL THEN 'removed' WHEN regexp_matches(line, '^\s*[▼►◄]\s*[A-Z]?[0-9]*\s*$') THEN 'marker' WHEN regexp_matches(line, '^\s*(?:\S ){{4,}}\S?\s*$') THEN 'spaced' WHEN contains(line, '◄') THEN 'inline' ELSE 'kept' END AS kind FROM ln LEFT JOIN gn ON gn.doc = ln.doc AND gn.page = ln.page AND gn.pos = ln.pos),
j AS (SELECT doc, page, coalesce(string_agg(regexp_replace(regexp_replace(line, '►\s*[A-Z][0-9]+\s*', '', 'g'), '\s*◄', '', 'g'), chr(10) ORDER BY pos) FILTER (WHERE kind IN ('kept', 'inline')), '') AS text, count(*) FILTER (WHERE kind = 'removed') AS removed, count(*) FILTER (WHERE kind IN ('marker', 'inline')) AS markers, count(*) FILTER (WHERE kind = 'spaced') AS spaced FROM k GROUP BY ALL)
SELECT doc, page, replace(text, 'ﬁ', 'fi') AS text, removed, markers, spaced, length(text) - length(replace(text, 'ﬁ', '')) AS ligatures FROM j""")
def _(t):
    return laws.cleaned(page_texts(t))


CAND = rf"""{LAWS}, l0 AS (SELECT law, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM lw),
l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY law ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l0),
cd AS (SELECT law, CAST(start AS BIGINT) AS start, CAST(regexp_extract(line, '^Article ([0-9]+) - ', 1) AS INT) AS number, regexp_extract(line, '^Article [0-9]+ - (.*)\. More$', 1) AS title FROM l1 WHERE regexp_matches(line, '^Article [0-9]+ - [A-Z]')),
od AS (SELECT law, CAST(start AS BIGINT) AS start, CAST(regexp_extract(line, '[0-9]+') AS INT) AS number FROM l1 WHERE regexp_matches(line, '^ARTICULO [0-9]+$'))"""


@query("t03_candidates", f"WITH {CAND} SELECT law, start, 'en' AS family, number, 'en_inline' AS style FROM cd UNION ALL SELECT law, start, 'es', number, 'es_alone' FROM od")
def _(t):
    return laws.candidates(law_texts(t)).drop("marker")


def chains(t):
    return laws.longest_chain(laws.candidates(law_texts(t)))


@query("t04_chain", f"WITH {CAND} SELECT law, 'en' AS family, string_agg(number, ',' ORDER BY start) AS numbers FROM cd GROUP BY law")
def _(t):
    return chains(t).select("law", "family", F.array_join(F.transform("chain", lambda x: x["number"].cast("string")), ",").alias("numbers"))


@query("t06_rejected", f"WITH {CAND} SELECT law, count(*) AS rejected FROM od GROUP BY law")
def _(t):
    found = laws.candidates(law_texts(t))
    return laws.rejected(found, laws.longest_chain(found))


@query("t05_articles", f"WITH {CAND}, sp AS (SELECT *, lead(start) OVER (PARTITION BY law ORDER BY start) AS nx FROM cd) SELECT sp.law, number, title, start, coalesce(nx, length(text)) AS stop, trim(substr(text, CAST(start + 1 AS BIGINT), CAST(coalesce(nx, length(text)) - start AS BIGINT)), concat(' ', chr(10))) AS body FROM sp JOIN lw ON lw.law = sp.law")
def _(t):
    return laws.articles(law_texts(t), chains(t))


@query("t06_skipped", f"WITH {CAND.replace('FROM conversations GROUP', 'FROM conversations WHERE turn % 3 <> 1 GROUP')}, sp AS (SELECT law, number, lead(number) OVER (PARTITION BY law ORDER BY start) AS nx FROM cd WHERE law IN (SELECT law FROM cd WHERE number = 1)) SELECT law, CAST(unnest(range(number + 1, nx)) AS INT) AS number FROM sp WHERE nx > number + 1")
def _(t):
    own = type(t)(t.spark, t.sf_dir)
    own.conversations = t.conversations.where("turn % 3 <> 1")
    return laws.skipped(chains(own).where("chain[0].number = 1"))


WORDS = {
    "en": "'the', 'of', 'and', 'to', 'in', 'shall', 'be', 'or', 'for', 'by', 'with', 'that', 'this', 'which', 'data', 'on', 'is', 'as', 'an', 'are'",
    "es": "'de', 'la', 'que', 'el', 'en', 'los', 'del', 'las', 'por', 'para', 'con', 'una', 'se', 'su', 'al', 'lo', 'datos', 'sus', 'como', 'ley'",
}
COUNT = "len(list_filter(regexp_split_to_array(lower(text), '[^a-záéíóúñü]+'), lambda w: list_contains([{0}], w)))"


@query("t07_language", f"SELECT doc_id, CASE WHEN {COUNT.format(WORDS['en'])} > {COUNT.format(WORDS['es'])} THEN 'en' ELSE 'es' END AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", laws.language(F.col("text")).alias("found"))


@query("p03b_local_names", "SELECT DISTINCT s, CASE WHEN s LIKE '%#%' THEN split_part(s, '#', 2) ELSE regexp_extract(s, '[^/]*$') END AS local FROM triples")
def _(t):
    return t.triples.select("s", local_name(F.col("s")).alias("local")).distinct()
