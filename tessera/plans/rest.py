"""Registered queries of provenance, questions and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import decisions, graph, laws, matching, profiles, provenance, questions
from tessera.operators.pairs import Ranking
from tessera.plans.decisions import LATEST, current, keys
from tessera.plans.graph import CAND, chains, law_texts
from tessera.plans.matching import PAIRS, items, sides
from tessera.plans.registry import query
from tessera.plans.rules import DECIDED, GOLD_PAIRS, decided, right_among
from tessera.sources import statements as io
from tessera.sources.storage import saved, scratch


@query("d11_batch", "SELECT decision AS action, count(*) AS n, count(*) FILTER (WHERE decision = 'approved' AND relation IS NULL OR seq % 19 = 0) AS bad, count(*) FILTER (WHERE decision = 'approved' AND relation IS NULL OR seq % 19 = 0) < 0 AS written FROM decisions GROUP BY decision")
def _(t):
    return provenance.batch_report(t.decisions.withColumn("reviewer", F.when(F.col("seq") % 19 != 0, F.col("reviewer"))))


@query("d17_change_reasons", """
WITH q AS (SELECT seq, concept_key, CASE WHEN seq % 6 = 0 THEN 'class' ELSE 'property' END AS kind, dpv_iri, CASE WHEN seq % 4 < 2 THEN 't1' END AS replaces, CASE WHEN seq % 5 = 0 THEN 'odd' ELSE 'exactMatch' END AS relation FROM decisions WHERE dpv_iri <> ''),
st AS (SELECT concept_key, count(DISTINCT dpv_iri) AS n, list(DISTINCT dpv_iri) AS held FROM decisions WHERE decision = 'approved' AND seq % 9 = 0 AND dpv_iri <> '' GROUP BY concept_key),
r AS (SELECT q.*, CASE WHEN dpv_iri IN ('t5', 't6') THEN 'unknown term' WHEN kind <> CASE WHEN dpv_iri IN ('t0', 't1', 't2') THEN 'class' ELSE 'property' END THEN 'incompatible kind' WHEN relation = 'odd' THEN 'unknown relation'
 WHEN coalesce(n, 0) > 1 AND replaces IS NULL THEN 'which mapping' WHEN coalesce(list_contains(held, dpv_iri), false) THEN 'no change' END AS reason FROM q LEFT JOIN st ON st.concept_key = q.concept_key)
SELECT seq, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY concept_key, reason IS NULL ORDER BY seq) > 1 THEN 'one change a concept' ELSE reason END AS reason FROM r""")
def _(t):
    s = F.col("seq")
    asked = t.decisions.where("dpv_iri <> ''").select("seq", "concept_key", F.when(s % 6 == 0, "class").otherwise("property").alias("kind"), "dpv_iri", F.when(s % 4 < 2, "t1").alias("replaces"), F.when(s % 5 == 0, "odd").otherwise("exactMatch").alias("relation"))
    state = t.decisions.where("decision = 'approved' and seq % 9 = 0 and dpv_iri <> ''").select("concept_key", "dpv_iri")
    terms = t.spark.createDataFrame([(f"t{i}", "class" if i < 3 else "property") for i in range(5)], "iri string, kind string")
    return provenance.change_reasons(asked, state, terms)


APPROVALS = """ap0 AS (SELECT *, lag(decision) OVER w AS d0, lag(relation) OVER w AS r0 FROM decisions WHERE dpv_iri <> '' WINDOW w AS (PARTITION BY source_id, concept_key, dpv_iri ORDER BY seq)),
ap AS (SELECT * FROM (SELECT *, lead(seq) OVER (PARTITION BY source_id, concept_key, dpv_iri ORDER BY seq) AS until FROM ap0 WHERE NOT coalesce(decision = 'approved' AND d0 = 'approved' AND r0 IS NOT DISTINCT FROM relation, false)) WHERE decision = 'approved')"""
RECORDS = f"""{LATEST}, {APPROVALS}, rec AS (SELECT 'mapping' AS activity, concept_key, dpv_iri, reviewer AS who, seq FROM cur WHERE decision = 'approved' UNION ALL SELECT 'no_match', concept_key, dpv_iri, reviewer, seq FROM cur WHERE decision = 'no_match'
 UNION ALL SELECT 'ended', concept_key, dpv_iri, NULL, seq FROM ap WHERE until IS NOT NULL), pr AS (SELECT substr(sha256(concat_ws(' ', activity, concept_key, dpv_iri, seq)), 1, 16) AS id, activity, concept_key AS subject, who, seq FROM rec)"""


def all_records(t):
    return provenance.records(current(t), decisions.approvals(t.decisions))


@query("d26_records", f"{RECORDS} SELECT * FROM pr")
def _(t):
    return all_records(t)


@query("d27_current_records", f"{LATEST} SELECT concept_key AS subject, dpv_iri, relation, seq, EXISTS (SELECT 1 FROM cur c WHERE c.concept_key = d.concept_key AND c.dpv_iri = d.dpv_iri AND c.relation = d.relation AND c.decision = 'approved') AS current FROM decisions d WHERE decision = 'approved'")
def _(t):
    rows = t.decisions.where("decision = 'approved'").select(F.col("concept_key").alias("subject"), "dpv_iri", "relation", "seq")
    return provenance.marked_current(rows, current(t).where("decision = 'approved'")).select("subject", "dpv_iri", "relation", "seq", "current")


@query("d28_activity_records", "WITH a AS (SELECT 'labels' AS activity, CAST(doc_id AS VARCHAR) AS subject FROM labels UNION ALL SELECT 'law', CAST(conv_id AS VARCHAR) FROM conversations WHERE turn = 0) SELECT *, substr(sha256(concat_ws(' ', activity, subject)), 1, 16) AS id FROM a")
def _(t):
    return provenance.activity_records({"labels": t.labels.select(F.col("doc_id").alias("subject")), "law": t.conversations.where("turn = 0").select(F.col("conv_id").alias("subject"))})


@query("d30_records_of", f"{RECORDS} SELECT activity, who, seq, CASE WHEN seq % 2 = 0 THEN concat('even; note ', activity) ELSE concat('note ', activity) END AS notes FROM pr WHERE subject = 'u3'")
def _(t):
    own = all_records(t)
    notes = own.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("note "), "activity"), F.when(F.col("seq") % 2 == 0, "even")))).alias("note"))
    return provenance.records_of(own, notes, "u3")


@query("s19_alignment_module", """WITH m AS (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS s, event_type AS o FROM events WHERE event_type IN ('view', 'click')), d AS (SELECT s, CASE WHEN length(s) = 2 THEN 'u0' END AS same_as FROM m GROUP BY s)
SELECT s, 'exactMatch' AS p, o FROM m WHERE length(s) <> 2 UNION ALL SELECT DISTINCT CASE WHEN length(s) = 2 THEN 'u0' ELSE s END, 'dct:source', concat('art. ', length(s)) FROM m""")
def _(t):
    own = t.events.where("event_type in ('view', 'click')").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("s"), F.col("event_type").alias("o")).distinct()
    approved = own.withColumns({"relation": F.lit("exactMatch"), "articles": F.array(F.length("s"))})
    return provenance.alignment_module(approved, own.where("length(s) = 2").select("s", F.lit("u0").alias("same_as")).distinct())


@query("s21_profile", "SELECT concat('http://ex.org/nation#', CAST(n_nationkey AS VARCHAR)) AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM nation UNION ALL SELECT concat('http://ex.org/nation#', CAST(n_nationkey AS VARCHAR)), 'rdfs:label', n_name FROM nation WHERE n_nationkey % 2 = 0")
def _(t):
    entries = t.nation.select(F.concat(F.lit("http://ex.org/nation#"), F.col("n_nationkey").cast("string")).alias("s"), F.when(F.col("n_nationkey") % 2 == 0, "new").otherwise("reused").alias("status"), F.col("n_name").alias("label"))
    return provenance.profile_statements(entries, t.triples)


BRIDGE = "WITH br AS (SELECT a, b, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, list(DISTINCT term) AS l FROM (SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b, x.l_partkey AS term FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_quantity > 45 AND y.l_quantity < 5) GROUP BY a, b)"


def bridged(t):
    own = lambda name, where: t.lineitem.where(where).select(F.col("l_suppkey").alias(name), F.col("l_partkey").alias("term"))
    return matching.bridge(own("a", "l_quantity > 45"), own("b", "l_quantity < 5"))


@query("s22_bridge_module", f"{BRIDGE} SELECT CAST(a AS VARCHAR) AS s, 'skos:closeMatch' AS p, CAST(b AS VARCHAR) AS o FROM br UNION ALL SELECT concat('_:pair', substr(sha256(concat_ws(' ', a, b)), 1, 24)), 'via', CAST(unnest(l) AS VARCHAR) FROM br")
def _(t):
    return provenance.bridge_statements(bridged(t))


@query("c24_review_items", f"{BRIDGE} SELECT a, b, terms, x.s_name AS a_label, y.s_name AS b_label FROM br LEFT JOIN supplier x ON x.s_suppkey = a LEFT JOIN supplier y ON y.s_suppkey = b")
def _(t):
    names = t.supplier.select("s_suppkey", "s_name")
    return profiles.review_items(bridged(t), names, names)


@query("v23_written", f"{LATEST} SELECT count(*) FILTER (WHERE relation IN ('exactMatch', 'closeMatch', 'broadMatch', 'narrowMatch', 'relatedMatch')) AS written, count(*) AS logged, count(relation) = count(*) AS same FROM cur WHERE decision = 'approved'")
def _(t):
    own = current(t)
    mapped = own.where("decision = 'approved'").select(F.col("concept_key").alias("s"), F.col("dpv_iri").alias("o"), "relation", F.col("reviewer").alias("by"), F.lit(None).cast("double").alias("score"))
    return provenance.written_counts(io.mapping_statements(mapped), own)


@query("c06_vectors", "SELECT plain AS name, count(*) AS n, count(*) > 0 AS unit FROM concepts GROUP BY plain")
def _(t):
    own = profiles.vectors_of(t.concepts.select(F.col("plain").alias("name"), "key"), "name")
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3)
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.bool_and(norm == 1.0).alias("unit"))


@query("c21_core_match", "SELECT key, CASE WHEN lower(name) IN (SELECT lower(name) FROM concepts WHERE kind = 'property') THEN 'reused' WHEN seq % 3 = 0 THEN 'linked' ELSE 'new' END AS status FROM concepts WHERE kind = 'class'")
def _(t):
    classes = t.concepts.where("kind = 'class'")
    return profiles.core_match(classes.select("key", "name"), t.concepts.where("kind = 'property'"), classes.where("seq % 3 = 0"))


@query("c22_definitions", "SELECT c.key, min(l.definition) AS definition FROM concepts c JOIN (SELECT name, CASE WHEN seq % 97 = 0 THEN family ELSE plain END AS definition FROM concepts WHERE seq % 3 = 0) l ON lower(l.name) = lower(c.name) GROUP BY c.key HAVING count(DISTINCT l.definition) = 1")
def _(t):
    said = t.concepts.where("seq % 3 = 0").withColumn("definition", F.when(F.col("seq") % 97 == 0, F.col("family")).otherwise(F.col("plain")))
    return profiles.matched_definitions(t.concepts, said)


@query("c27_evidence", "SELECT key, coalesce(a, n) AS article, CASE WHEN a IS NOT NULL THEN 'own' WHEN n IS NOT NULL THEN 'nearest' ELSE 'none' END AS origin FROM (SELECT key, CASE WHEN seq % 3 = 0 THEN seq % 12 END AS a, CASE WHEN seq % 2 = 0 THEN seq % 7 END AS n FROM concepts)")
def _(t):
    own = t.concepts.select("key", F.when(F.col("seq") % 3 == 0, F.col("seq") % 12).alias("article"))
    return profiles.evidence(own, t.concepts.where("seq % 2 = 0").select("key", (F.col("seq") % 7).alias("article")))


@query("h05_modules", """
WITH c AS (SELECT seq AS id, name, CASE WHEN seq % 6 <> 0 THEN family END AS family FROM concepts WHERE kind = 'class'), p AS (SELECT seq AS id, name, CASE WHEN seq % 7 <> 0 THEN family END AS family, CAST(floor(seq / 3) AS BIGINT) AS domain FROM concepts WHERE kind = 'property'),
hi(node) AS (SELECT seq FROM concepts WHERE contains(lower(name), 'bluerod') UNION SELECT child FROM edges JOIN hi ON parent = node),
f AS (SELECT x.*, CASE WHEN family IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'profile' WHEN left(family, 7) IN ('Brand#2', 'Brand#3') THEN 'core' END AS fm FROM (SELECT *, NULL AS domain, false AS pure FROM c UNION ALL SELECT *, true FROM p) x),
m1 AS (SELECT *, CASE WHEN fm = 'core' AND id IN (SELECT node FROM hi) THEN 'profile' ELSE coalesce(fm, 'core') END AS module, CASE WHEN fm = 'core' AND id IN (SELECT node FROM hi) THEN 'hint' WHEN fm IS NOT NULL THEN 'family' ELSE 'default' END AS reason FROM f WHERE NOT pure),
m AS (SELECT id, family, module, reason, false AS pure FROM m1 UNION ALL SELECT f.id, f.family, coalesce(m1.module, f.fm, 'core'), CASE WHEN m1.id IS NOT NULL THEN 'domain' WHEN f.fm IS NOT NULL THEN 'family' ELSE 'default' END, true FROM f LEFT JOIN m1 ON m1.id = f.domain WHERE f.pure)
SELECT m.id, module, reason, concat_ws('|', CASE WHEN pure AND reason = 'default' THEN 'no domain' END, CASE WHEN family IS NULL THEN 'no family' END, CASE WHEN module = 'profile' AND score >= 0.75 THEN 'near' WHEN module = 'core' AND score < 0.35 THEN 'far' END) AS flags FROM m LEFT JOIN (SELECT p_partkey AS id, p_size / 50.0 AS score FROM part WHERE p_partkey % 2 = 0) s ON s.id = m.id""")
def _(t):
    own = t.concepts.select(F.col("seq").alias("id"), "name", "family", "kind")
    classes = own.where("kind = 'class'").select("id", "name", F.when(F.col("id") % 6 != 0, F.col("family")).alias("family"))
    properties = own.where("kind = 'property'").select("id", "name", F.when(F.col("id") % 7 != 0, F.col("family")).alias("family"), F.floor(F.col("id") / 3).alias("domain"))
    scores = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score"))
    core = [f"Brand#{n}{m}" for n in (2, 3) for m in ("", *range(10))]
    return profiles.module_assignment(classes, properties, t.edges, scores, ["Brand#11", "Brand#12", "Brand#13"], core, "bluerod")


@query("h11_module_counts", "SELECT module, count(*) AS statements, count(DISTINCT s) AS subjects FROM (SELECT s, CASE WHEN origin IN ('nation', 'region') THEN 'core' ELSE 'profile' END AS module FROM triples) GROUP BY module")
def _(t):
    modules = t.triples.select("s", F.when(F.col("origin").isin("nation", "region"), "core").otherwise("profile").alias("module")).distinct()
    return profiles.module_counts(t.triples, modules)


@query("h14_preview", "WITH n AS (SELECT p_partkey AS node, p_size % 3 = 0 AS al FROM part), o AS (SELECT node FROM (SELECT node, CASE WHEN al AND row_number() OVER (PARTITION BY al ORDER BY node) <= 10 THEN 0 ELSE 1 END AS turn FROM n) ORDER BY turn, node LIMIT 16) SELECT child, parent FROM edges WHERE child IN (SELECT node FROM o) AND parent IN (SELECT node FROM o)")
def _(t):
    return profiles.preview(t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 3 == 0).alias("aligned")), t.edges)


@query("q01_query_sets", "SELECT a.set_id, q.qid, (SELECT count(*) FROM triples t WHERE (a.set_id = 'all' OR t.origin = 'nation') AND ((q.qid = 'labels' AND t.p = 'rdfs:label') OR (q.qid = 'types' AND t.p = 'rdf:type'))) AS n FROM (VALUES ('all'), ('nation')) a(set_id), (VALUES ('labels'), ('types')) q(qid)")
def _(t):
    ask = {"labels": lambda g: g.where("p = 'rdfs:label'"), "types": lambda g: g.where("p = 'rdf:type'")}
    return questions.over_sets({"all": t.triples, "nation": t.triples.where("origin = 'nation'")}, ask)


ELEMENTS = """el AS (SELECT family AS qid, key AS element, plain AS words, seq % 9 AS article FROM concepts), an AS (SELECT DISTINCT family AS qid, concat('a ', plain, ' b') AS text, (seq + 1) % 9 AS article FROM concepts WHERE seq % 2 = 0),
ow AS (SELECT *, count(*) OVER (PARTITION BY qid, article) = 1 AS own FROM el),
fd AS (SELECT qid, element, EXISTS (SELECT 1 FROM an WHERE an.qid = ow.qid AND contains(concat(' ', an.text, ' '), concat(' ', ow.words, ' '))) OR (own AND EXISTS (SELECT 1 FROM an WHERE an.qid = ow.qid AND an.article = ow.article)) AS found FROM ow)"""


def found_elements(t):
    own = t.concepts
    elements = own.select(F.col("family").alias("qid"), F.col("key").alias("element"), F.col("plain").alias("words"), (F.col("seq") % 9).alias("article"))
    answers = own.where("seq % 2 = 0").select(F.col("family").alias("qid"), F.concat(F.lit("a "), "plain", F.lit(" b")).alias("text"), ((F.col("seq") + 1) % 9).alias("article")).distinct()
    return questions.elements_found(elements, answers)


@query("q05_elements", f"WITH {ELEMENTS} SELECT qid, element, found FROM fd")
def _(t):
    return found_elements(t)


@query("q05_judged", f"WITH {ELEMENTS} SELECT qid, bool_and(found) AS every, bool_or(found) AS some FROM fd GROUP BY qid")
def _(t):
    return questions.judged_elements(found_elements(t))


COLOR = "CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'grey' END"


@query("q06_summary", f"SELECT count(*) FILTER (WHERE c = 'green') AS green, count(*) FILTER (WHERE c = 'yellow') AS yellow, count(*) FILTER (WHERE c = 'grey') AS grey, CASE WHEN count(*) FILTER (WHERE c = 'grey') > 0 THEN 'grey' WHEN count(*) FILTER (WHERE c = 'yellow') > 0 THEN 'yellow' ELSE 'green' END AS status FROM (SELECT {COLOR} AS c FROM orders)")
def _(t):
    return questions.status_summary(t.orders.select(F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "O", "yellow").otherwise("grey").alias("color")))


@query("q08_catalogue", "SELECT id, 'id repeats' AS problem FROM (SELECT n_nationkey % 20 AS id FROM nation) GROUP BY id HAVING count(*) > 1 UNION ALL SELECT n_nationkey, 'no group' FROM nation WHERE n_nationkey BETWEEN 5 AND 19 AND n_regionkey = 2")
def _(t):
    return questions.catalogue_problems(t.nation.select((F.col("n_nationkey") % 20).alias("id"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("grp"), F.lit("value").alias("criterion")))


@query("e18_questions", """
WITH d AS (SELECT key, kind, family AS part, seq, seq % 3 AS priority, CAST(seq % 10 AS DOUBLE) AS score FROM concepts WHERE seq % 4 <> 1),
o AS (SELECT key, seq % 2 AS rank, concat('t', seq % 7) AS term, CASE WHEN seq % 11 = 0 THEN 'odd' ELSE 'closeMatch' END AS rel, CASE WHEN seq % 3 = 0 THEN 't2' END AS replaces FROM concepts UNION ALL SELECT key, 9, 't3', 'exactMatch', NULL FROM concepts WHERE seq % 5 = 0),
st AS (SELECT key, concat('t', seq % 4) AS term FROM concepts WHERE seq % 3 = 0 UNION SELECT key, 't6' FROM concepts WHERE seq % 9 = 0), h AS (SELECT key, count(*) AS n, list(term) AS held FROM st GROUP BY key),
f AS (SELECT o.key, string_agg(term, ',' ORDER BY rank, term) AS options FROM o JOIN d ON d.key = o.key LEFT JOIN h ON h.key = o.key WHERE term IN ('t0', 't1', 't2', 't3', 't4') AND d.kind = CASE WHEN term IN ('t0', 't1', 't2') THEN 'class' ELSE 'property' END AND rel <> 'odd'
 AND NOT (coalesce(n, 0) > 1 AND replaces IS NULL) AND NOT coalesce(list_contains(held, term), false) GROUP BY o.key)
SELECT d.key, part, options, CASE WHEN options IS NULL THEN 'no option' WHEN row_number() OVER (PARTITION BY part, options IS NULL ORDER BY priority, score DESC, d.key) > 3 THEN 'over limit' ELSE 'asked' END AS status FROM d LEFT JOIN f ON f.key = d.key""")
def _(t):
    s, term = F.col("seq"), lambda n: F.concat(F.lit("t"), n.cast("string")).alias("dpv_iri")
    doubts = t.concepts.where("seq % 4 <> 1").select("key", "kind", F.col("family").alias("part"), (s % 3).alias("priority"), (s % 10).cast("double").alias("score"))
    options = t.concepts.select("key", (s % 2).alias("rank"), term(s % 7), F.when(s % 11 == 0, "odd").otherwise("closeMatch").alias("relation"), F.when(s % 3 == 0, "t2").alias("replaces"))
    options = options.unionByName(t.concepts.where("seq % 5 = 0").select("key", F.lit(9).cast("bigint").alias("rank"), F.lit("t3").alias("dpv_iri"), F.lit("exactMatch").alias("relation"), F.lit(None).cast("string").alias("replaces")))
    state = t.concepts.where("seq % 3 = 0").select(F.col("key").alias("concept_key"), term(s % 4)).unionByName(t.concepts.where("seq % 9 = 0").select(F.col("key").alias("concept_key"), F.lit("t6").alias("dpv_iri")))
    terms = t.spark.createDataFrame([(f"t{i}", "class" if i < 3 else "property") for i in range(5)], "iri string, kind string")
    return questions.questions_with_options(doubts, options, state, terms, 3)


@query("e19_citations", "SELECT o_orderkey AS key, bool_and(o_orderkey % 5 <> 0 OR o_custkey % 2 = 0) AS valid FROM orders GROUP BY o_orderkey")
def _(t):
    cited = F.when(F.col("o_orderkey") % 5 == 0, F.array("o_custkey")).otherwise(F.array().cast("array<bigint>"))
    shown = t.orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("row_id"))
    return questions.citations_valid(t.orders.select(F.col("o_orderkey").alias("key"), cited.alias("cited")), shown)


@query("f03_weight_sweep", f"""{PAIRS}, {GOLD_PAIRS}, s AS (SELECT p.*, w, round(w * lexical + (1 - w) * semantic, 4) AS sc FROM p, (SELECT CAST(x AS DOUBLE) AS w FROM (VALUES (0.0), (0.4), (1.0)) v(x))),
r AS (SELECT *, row_number() OVER (PARTITION BY w, id ORDER BY sc DESC, lexical DESC, t_id) AS rank FROM s), b AS (SELECT w, r.id, min(rank) AS rank FROM r JOIN g ON g.id = r.id AND g.t_id = r.t_id WHERE rank <= 3 GROUP BY ALL) SELECT w, count(*) FILTER (WHERE rank = 1) AS hit_1, count(*) AS hit_3 FROM b GROUP BY w""")
def _(t):
    weights = [0.0, 0.4, 1.0]
    best = saved(matching.best_pairs(*sides(t), 3, *[Ranking(w, 1 - w) for w in weights]))  # holds the three best of each weight
    return questions.weight_sweep(best, t.spark.createDataFrame([(w,) for w in weights], "w double"), right_among(t, best))


@query("f15_verdicts", """WITH h AS (SELECT key % 2 AS half, status, term, CASE WHEN key % 50 = 0 THEN predicted END AS old, CASE WHEN key % 2 = 0 THEN term WHEN key % 4 = 1 THEN predicted END AS new FROM gold),
c AS (SELECT half, count(*) FILTER (WHERE status = 'aligned') AS al, count(old) AS po, count(*) FILTER (WHERE status = 'aligned' AND old = term) AS ro, count(new) AS pn, count(*) FILTER (WHERE status = 'aligned' AND new = term) AS rn FROM h GROUP BY half),
r AS (SELECT half, round(ro / nullif(po, 0), 4) AS p1, round(ro / nullif(al, 0), 4) AS c1, round(rn / nullif(pn, 0), 4) AS p2, round(rn / nullif(al, 0), 4) AS c2 FROM c),
f AS (SELECT half, p2, CASE WHEN p1 > 0 AND c1 > 0 THEN round(2 * p1 * c1 / (p1 + c1), 4) END AS f1, CASE WHEN p2 > 0 AND c2 > 0 THEN round(2 * p2 * c2 / (p2 + c2), 4) END AS f2 FROM r)
SELECT CAST(half AS INTEGER) AS half, coalesce(p2 >= 0.5 AND f2 - f1 >= 0.02, false) AS adopted FROM f""")
def _(t):
    from tessera.operators import measure

    halves = t.gold.withColumn("half", (F.col("key") % 2).cast("int"))
    none = measure.score_card(halves.withColumn("proposed", F.when(F.col("key") % 50 == 0, F.col("predicted"))), "half")
    better = measure.score_card(halves.withColumn("proposed", F.when(F.col("half") == 0, F.col("term")).when(F.col("key") % 4 == 1, F.col("predicted"))), "half")
    return measure.verdicts(none, better, 0.5, 0.02)


@query("f17_reviewer", """WITH o AS (SELECT l_orderkey AS question, l_returnflag AS option, CAST(l_returnflag = 'N' AS INT) AS rec, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY ALL)
SELECT question, option, value FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY value DESC, rec DESC, option DESC) AS k FROM o) WHERE k = 1""")
def _(t):
    return questions.simulated_reviewer(t.lineitem.select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("option"), (F.col("l_returnflag") == "N").cast("int").alias("recommended"), F.col("l_linenumber").alias("value")))


KNOWN = f"WITH {DECIDED}, k AS (SELECT g.key, confidence AS method, CASE WHEN status = 'aligned' THEN g.term END AS rt, CASE WHEN g.key % 9 <> 0 AND g.key % 4 <> 1 THEN predicted END AS term, score, CASE WHEN g.key % 7 <> 0 THEN 1 END AS rank FROM gold g), v AS (SELECT key, method, CASE WHEN rt IS NULL AND term IS NULL THEN 'abstain_ok' WHEN term = rt THEN 'hit' WHEN term IS NOT NULL THEN 'wrong' WHEN rank IS NULL THEN 'lost_by_rank' WHEN score < 0.5 THEN 'lost_by_threshold' ELSE 'lost_by_answer' END AS verdict FROM k)"


def known(t):
    g = t.gold
    own = decided(t).select("key", F.when(F.col("answered"), F.col("term")).alias("term"), "score")
    return questions.known_answers(g.select("key", F.col("confidence").alias("method"), F.when(F.col("status") == "aligned", F.col("term")).alias("term")), own, g.where("key % 7 <> 0").select("key", F.lit(1).alias("rank")))


@query("f18_known_answers", f"{KNOWN} SELECT key, method, verdict FROM v")
def _(t):
    return known(t)


@query("f18_summary", f"{KNOWN} SELECT method, count(*) AS n, count(*) FILTER (WHERE verdict = 'hit') AS hits, round(count(*) FILTER (WHERE verdict = 'hit') / count(*), 4) AS share FROM v GROUP BY GROUPING SETS ((method), ())")
def _(t):
    return questions.known_summary(known(t))


@query("f19_outcomes", """WITH r AS (SELECT c_nationkey AS qid, c_mktsegment AS k FROM customer), d AS (SELECT DISTINCT qid, k FROM r WHERE qid % 5 <> 0 AND (qid % 3 <> 0 OR k <> 'MACHINERY')), c AS (SELECT n_nationkey AS qid, n_regionkey AS grp FROM nation),
s AS (SELECT grp, CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.qid = c.qid) THEN 'none' WHEN (SELECT count(DISTINCT k) FROM r WHERE r.qid = c.qid) = (SELECT count(*) FROM d WHERE d.qid = c.qid) THEN 'same' ELSE 'other' END AS state FROM c)
SELECT grp, count(*) FILTER (WHERE state = 'same') AS same, count(*) FILTER (WHERE state = 'other') AS other, count(*) FILTER (WHERE state = 'none') AS none FROM s GROUP BY GROUPING SETS ((grp), ())""")
def _(t):
    rows = t.customer.select(F.col("c_nationkey").alias("qid"), F.col("c_mktsegment").alias("row_key"))
    draft = rows.where("qid % 5 <> 0 and (qid % 3 <> 0 or row_key <> 'MACHINERY')")
    return questions.draft_outcomes(rows, draft, t.nation.select(F.col("n_nationkey").alias("qid"), F.col("n_regionkey").alias("grp")))


@query("f20_explanations", "SELECT d.doc_id AS qid, contains(lower(text), 'the') AND contains(lower(text), 'an') AS \"right\" FROM documents d")
def _(t):
    words = t.documents.select(F.col("doc_id").alias("qid"), F.explode(F.array(F.lit("The"), F.lit("an"))).alias("word"))
    return questions.explanation_right(t.documents.select(F.col("doc_id").alias("qid"), "text"), words)


@query("s05_candidate_file", f"{LATEST} SELECT concept_key, t AS dpv_iri, r AS rank FROM keys, (VALUES ('t1', 1), ('t3', 2)) v(t, r)")
def _(t):
    path = scratch(t.spark)
    row = lambda term, rank: F.struct(F.lit(term).alias("dpv_iri"), F.lit(rank).alias("rank"))
    keys(t).select("concept_key", F.array(row("t1", 1), row("t3", 2)).alias("rows")).write.json(path)
    read = t.spark.read.schema("concept_key string, rows array<struct<dpv_iri string, rank int>>").json(path)
    return read.select("concept_key", F.inline("rows"))


@query("t05_law_articles", f"WITH {CAND} SELECT law, count(*) AS n FROM cd GROUP BY law")
def _(t):
    return laws.articles(law_texts(t), chains(t)).groupBy("law").agg(F.count(F.lit(1)).alias("n"))


@query("c05_self_similarity", "SELECT vec_id AS id, round(least(1.0, list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) = 1.0 AS one FROM embeddings")
def _(t):
    from tessera.functions.text import cosine

    return items(t).select("id", (F.round(cosine(F.col("embedding"), F.col("embedding")), 4) == 1.0).alias("one"))
