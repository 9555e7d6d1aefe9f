"""Registered queries of the sources, sinks, streams and reports: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import laws, matching, report
from tessera.operators.decisions import RECORD, concept_status, latest, replay
from tessera.plans.decisions import LATEST, STATUS, current, keys, status
from tessera.plans.graph import CAND, chains, law_texts
from tessera.plans.matching import PAIRS, sides
from tessera.plans.registry import query
from tessera.plans.rules import DECIDED, decided
from tessera.sources import collections as vectors
from tessera.sources import statements as io
from tessera.sources.storage import scratch
from tessera.streaming import logs

STATEMENTS = "SELECT DISTINCT s, p, o, o_kind, dt, lang FROM triples"


@query("s01_statements", STATEMENTS)
def _(t):
    path = scratch(t.spark)
    io.write_statements(t.triples, path)
    return io.read_statements(t.spark, path).distinct()


@query("s01_json_ld", STATEMENTS)
def _(t):
    path = scratch(t.spark)
    io.write_json_ld(t.triples.drop("origin"), path)
    return io.read_json_ld(t.spark, path).distinct()


LOG_COLUMNS = "seq, source_id, target, concept_key, dpv_iri, decision, relation"


def log(t):
    return t.decisions.selectExpr(*LOG_COLUMNS.split(", "))


@query("s02_log", f"SELECT {LOG_COLUMNS} FROM decisions")
def _(t):
    path = scratch(t.spark)
    io.append_log(log(t), path)
    return io.read_log(t.spark, path, logs.LOG)


def with_snapshot(t):
    """The log as whole records; the snapshot is the event's own properties in a record of other shape for each type of event."""
    event = t.events.select(F.col("event_id").alias("seq"), "props", "event_type")
    made = F.concat(F.lit('{"rank": '), (F.col("seq") % 5).cast("string"), F.lit(', "run": {"model": "m'), (F.col("seq") % 3).cast("string"), F.lit('", "scores": [0.25, '), (F.col("seq") % 10).cast("string"), F.lit("]}, "), F.when(F.col("event_type") == "click", F.lit('"origin": null, ')).otherwise(""), F.lit('"props": '), F.to_json(F.struct("props")), F.lit("}"))
    columns = {"entity_kind": F.lit(None).cast("string"), "same_as": F.lit(None).cast("string"), "note": F.when(F.col("seq") % 4 == 0, F.concat(F.lit("note \n"), F.col("seq").cast("string"))), "snapshot": F.parse_json(made)}
    return t.decisions.join(event, "seq").withColumns(columns).select(*[c.split()[0] for c in RECORD.split(", ")])


def stored_records(t):
    path = scratch(t.spark)
    for turn in range(2):
        io.append_log(with_snapshot(t).where(F.col("seq") % 2 == turn), path)
    return io.read_log(t.spark, path, RECORD)


SNAPSHOT = "concat('m', seq % 3) AS model, CAST(seq % 10 AS BIGINT) AS second, props"


@query("s02_records", f"SELECT seq, source_id, target, concept_key, d.dpv_iri, decision, relation, reviewer, CASE WHEN seq % 4 = 0 THEN concat('note ', chr(10), seq) END AS note, CAST(seq % 5 AS BIGINT) AS rank, {SNAPSHOT} FROM decisions d JOIN events ON event_id = seq")
def _(t):
    at = lambda path, kind, name: F.variant_get("snapshot", path, kind).alias(name)
    rows = stored_records(t)
    return rows.select("seq", "source_id", "target", "concept_key", "dpv_iri", "decision", "relation", "reviewer", "note", at("$.rank", "bigint", "rank"), at("$.run.model", "string", "model"), at("$.run.scores[1]", "bigint", "second"), at("$.props.props", "string", "props"))


@query("d15_snapshots", f"""WITH cl AS (SELECT concept_key, max(seq) AS cleared FROM decisions WHERE decision = 'no_match' GROUP BY concept_key),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_key, dpv_iri ORDER BY seq DESC) AS k FROM decisions WHERE dpv_iri <> '') WHERE k = 1)
SELECT ev.concept_key, dpv_iri, relation, {SNAPSHOT} FROM ev JOIN events ON event_id = seq LEFT JOIN cl ON cl.concept_key = ev.concept_key WHERE decision = 'approved' AND (cleared IS NULL OR seq > cleared)""")
def _(t):
    at = lambda path, kind, name: F.variant_get("snapshot", path, kind).alias(name)
    none = t.spark.createDataFrame([], "concept_key string, dpv_iri string, relation string")
    return replay(none, stored_records(t), ("snapshot",)).select("concept_key", "dpv_iri", "relation", at("$.run.model", "string", "model"), at("$.run.scores[1]", "bigint", "second"), at("$.props.props", "string", "props"))


@query("s03_cache", "SELECT cache_key, seq, answer FROM (SELECT event_type || CAST(user_id AS VARCHAR) AS cache_key, event_id AS seq, props AS answer, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 7 <> 0) WHERE k = 1")
def _(t):
    path = scratch(t.spark)
    row = F.to_json(F.struct(F.concat("event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").alias("seq"), F.col("props").alias("answer")))
    t.events.select(F.when(F.col("event_id") % 7 == 0, F.substring(row, 1, 20)).otherwise(row).alias("value")).write.text(path)
    return io.read_cache(t.spark, path, "cache_key string, seq bigint, answer string")


@query("s04_labelled", "SELECT doc_id, quality, toxic FROM labels")
def _(t):
    path = scratch(t.spark)
    t.labels.write.option("header", True).option("sep", ";").csv(path)
    return io.read_labelled(t.spark, path, "doc_id bigint, quality int, toxic int")


@query("s06_pages", "SELECT source, count(*) AS pages, sum(length(replace(text, chr(12), ''))) AS chars FROM documents GROUP BY source")
def _(t):
    path = scratch(t.spark)
    # bounded files: the pages of a source go to as many as their number asks for; form feeds part them
    own = t.documents.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"), F.replace("text", F.lit("\f"), F.lit("")).alias("value"))
    own.repartition("source", "part").write.option("maxRecordsPerFile", 2000).option("lineSep", "\f").partitionBy("source", "part").text(path)
    pages = io.read_pages(t.spark, path)
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.char_length("text")).alias("chars"))


def collection(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("doc "), F.col("label").cast("string")).alias("document"), F.col("label").cast("string").alias("kind"))


@query("s07_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'new' ELSE concat('doc ', label) END AS document FROM embeddings UNION ALL SELECT 1000000 + vec_id, 'new' FROM embeddings WHERE vec_id % 10 = 0")
def _(t):
    own = collection(t).select("id", "document")
    new = own.where("id % 10 = 0").select("id", F.lit("new").alias("document"))
    more = new.unionByName(new.withColumn("id", F.col("id") + 1000000))
    path = scratch(t.spark)
    for rows in (own, more, more):
        vectors.upsert_collection(rows, path)
    return vectors.read_collection(t.spark, path)


@query("s08_select", "SELECT vec_id AS id, concat('doc ', label) AS document FROM embeddings WHERE label IN (1, 3)")
def _(t):
    return vectors.selected(collection(t), kind=["1", "3"]).select("id", "document")


DOCUMENT = "concat(vec_id, ':', CASE WHEN {0} THEN 'x' ELSE concat('doc ', label) END)"


def manifest_sql(name: str, where: str = "true", other: str = "false", twice: bool = False) -> str:
    rows = f"(SELECT * FROM embeddings{' UNION ALL SELECT * FROM embeddings' if twice else ''})"
    return f"SELECT '{name}' AS name, count(*) AS n, count(DISTINCT vec_id) AS ids, md5(string_agg({DOCUMENT.format(other)}, ',' ORDER BY vec_id)) AS digest FROM {rows} WHERE {where}"


STORED = " UNION ALL ".join([manifest_sql("a"), manifest_sql("b", "vec_id % 2 = 0"), manifest_sql("d", other="true"), manifest_sql("e")])
WANTED = " UNION ALL ".join([*[manifest_sql(n) for n in "abcd"], manifest_sql("e", twice=True)])


@query("s09_rebuild_status", f"WITH st AS ({STORED}), wa AS ({WANTED}) SELECT wa.name, CASE WHEN wa.n <> wa.ids THEN 'duplicate_ids' WHEN st.n IS NULL THEN 'missing' WHEN st.n <> wa.n THEN 'incomplete' WHEN st.digest <> wa.digest THEN 'stale' ELSE 'current' END AS status FROM wa LEFT JOIN st ON st.name = wa.name")
def _(t):
    own = collection(t)
    part, other = own.where("id % 2 = 0"), own.withColumn("document", F.lit("x"))
    stored = vectors.manifest(own, "a").unionByName(vectors.manifest(part, "b")).unionByName(vectors.manifest(other, "d")).unionByName(vectors.manifest(own, "e"))
    wanted = vectors.manifest(own, "a")
    for name, rows in (("b", own), ("c", own), ("d", own), ("e", own.unionByName(own))):
        wanted = wanted.unionByName(vectors.manifest(rows, name))
    return vectors.rebuild_status(stored, wanted)


@query("s09_ensure", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS even FROM embeddings)
SELECT 0 AS turn, 'missing' AS before, 'current' AS after, even AS items FROM n UNION ALL SELECT 1, 'current', 'current', even FROM n UNION ALL SELECT 2, 'stale', 'current', n FROM n""")
def _(t):
    path, found = scratch(t.spark), []
    turns = [(collection(t).where("id % 2 = 0"), "a"), (collection(t), "a"), (collection(t), "b")]  # the second is not built: the inputs are said to be the same
    for turn, (rows, fingerprint) in enumerate(turns):
        before = vectors.ensure_collection(rows, path, fingerprint)
        found.append(vectors.read_collection(t.spark, path).agg(F.count(F.lit(1)).alias("items")).select(F.lit(turn).alias("turn"), F.lit(before).alias("before"), F.lit(vectors.collection_state(t.spark, path, fingerprint)).alias("after"), "items"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("s10_term_records", "SELECT iri AS id, concat_ws('. ', name, label) AS document, kind, parent AS parents FROM terms")
def _(t):
    return vectors.term_records(t.terms).withColumn("parents", F.array_join("parents", ","))


@query("s11_decision_records", f"{LATEST} SELECT concept_key AS id, string_agg(DISTINCT concat_ws(' ', relation, dpv_iri), ',' ORDER BY concat_ws(' ', relation, dpv_iri)) AS mappings, count(*) AS n FROM cur WHERE decision = 'approved' GROUP BY concept_key")
def _(t):
    return vectors.decision_records(current(t)).withColumn("mappings", F.array_join("mappings", ","))


@query("s12_article_records", f"WITH {CAND}, sp AS (SELECT *, lead(start) OVER (PARTITION BY law ORDER BY start) AS nx FROM cd) SELECT concat(CAST(sp.law AS VARCHAR), '/art-', CAST(number AS VARCHAR)) AS id, start, coalesce(nx, length(text)) AS stop FROM sp JOIN lw ON lw.law = sp.law")
def _(t):
    return vectors.article_records(laws.articles(law_texts(t), chains(t))).drop("document")


@query("s13_candidate_file", f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lexical DESC, t_id) AS rank FROM p) SELECT id, t_id, score, rank, count(*) OVER (PARTITION BY id) AS n FROM r WHERE rank <= 3")
def _(t):
    path = scratch(t.spark)
    io.write_candidates(matching.top_candidates(matching.best_pairs(*sides(t), 3), 3).select("id", "t_id", "score", "rank"), path, {"top": "3"}, "id")
    rows = t.spark.read.schema("id bigint, t_id bigint, score double, rank int").option("header", True).csv(f"{path}/csv")
    counted = t.spark.read.schema("id bigint, n bigint").json(f"{path}/counts")
    same = t.spark.read.schema("id bigint, t_id bigint, score double, rank int").json(f"{path}/rows")
    return rows.intersect(same).join(counted, "id")


@query("s14_report", "SELECT family, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM concepts GROUP BY family")
def _(t):
    path = scratch(t.spark)
    io.write_report(t.concepts.groupBy("family").agg(F.sort_array(F.collect_set("name")).alias("names")), path)
    return t.spark.read.schema("family string, names string").option("header", True).csv(path)


@query("s15_append", "SELECT decision, count(*) AS n FROM decisions GROUP BY decision")
def _(t):
    path = scratch(t.spark)
    for turn in range(3):
        io.append_log(log(t).where(F.col("seq") % 3 == turn), path)
    return io.read_log(t.spark, path, logs.LOG).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("s16_round_trip", """WITH w AS (SELECT s, p, o, dt, lang FROM triples WHERE p <> 'ex:segment'), g AS (SELECT s, p, o, dt, lang FROM triples)
SELECT (SELECT count(*) FROM (FROM g EXCEPT ALL FROM w)) AS missing, (SELECT count(*) FROM (FROM w EXCEPT ALL FROM g)) AS extra, (SELECT count(*) FROM (FROM g EXCEPT ALL FROM w)) + (SELECT count(*) FROM (FROM w EXCEPT ALL FROM g)) = 0 AS same""")
def _(t):
    from tessera.operators.shapes import dataset_diff

    path = scratch(t.spark)
    io.write_statements(t.triples.where("p <> 'ex:segment'"), path)  # what is left out is found missing, and nothing else
    return dataset_diff(t.triples, io.read_statements(t.spark, path))


@query("s17_labels", "SELECT concat('c', CAST(doc_id AS VARCHAR)) AS s, 'rdfs:label' AS p, source AS o, lang FROM documents UNION ALL SELECT concat('c', CAST(doc_id AS VARCHAR)), 'rdfs:label', lang, 'xx' FROM documents WHERE doc_id % 2 = 0")
def _(t):
    labels = F.create_map(F.col("lang"), F.col("source"), F.lit("xx"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return io.label_statements(t.documents.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("key"), labels.alias("labels")))


@query("s18_definitions", """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS s, text AS o, lang, concat('_:', substr(sha256(concat(CAST(doc_id AS VARCHAR), chr(31), text)), 1, 16)) AS node, concat('art. ', doc_id % 9) AS art FROM documents)
SELECT s, 'skos:definition' AS p, o, lang FROM a UNION ALL SELECT node, 'owl:annotatedSource', s, NULL FROM a UNION ALL SELECT node, 'dct:source', art, NULL FROM a""")
def _(t):
    added = t.documents.select(F.col("doc_id").cast("string").alias("s"), F.col("text").alias("o"), "lang", (F.col("doc_id") % 9).alias("article"))
    return io.definition_statements(added)


MAPPED = f"{LATEST}, m0 AS (SELECT concept_key AS s, dpv_iri AS o, coalesce(CASE WHEN relation <> 'relatedMatch' THEN relation END, 'rdfs:seeAlso') AS relation, reviewer, seq FROM cur WHERE decision = 'approved'), m AS (SELECT *, concat('_:', substr(sha256(concat_ws(chr(31), s, relation, o)), 1, 16)) AS node FROM m0)"


@query("s20_alignment", f"""{MAPPED} SELECT s, relation AS p, o FROM m UNION ALL SELECT node, 'owl:annotatedSource', s FROM m UNION ALL SELECT node, 'owl:annotatedProperty', relation FROM m UNION ALL SELECT node, 'owl:annotatedTarget', o FROM m
UNION ALL SELECT node, 'decidedBy', reviewer FROM m UNION ALL SELECT node, 'confidence', CAST(seq % 8 / 8.0 AS VARCHAR) FROM m WHERE seq % 2 = 0 UNION ALL SELECT node, 'owl:versionInfo', CAST(seq % 3 + 1 AS VARCHAR) FROM m""")
def _(t):
    relation, score = F.when(F.col("relation") != "relatedMatch", F.col("relation")), F.when(F.col("seq") % 2 == 0, F.col("seq") % 8 / 8.0)
    return io.mapping_statements(current(t).where("decision = 'approved'").select(F.col("concept_key").alias("s"), F.col("dpv_iri").alias("o"), relation.alias("relation"), F.col("reviewer").alias("by"), score.alias("score"), (F.col("seq") % 3 + 1).alias("version")))


@query("s23_merge", f"{STATEMENTS.replace('o_kind, ', '')} WHERE s NOT IN ('http://ex.org/nation#1', 'http://ex.org/nation#2')")
def _(t):
    heads = t.triples.where("s in ('http://ex.org/nation#1', 'http://ex.org/nation#2', 'http://ex.org/nation#3') and p = 'rdf:type'").withColumn("o", F.lit("owl:Ontology"))
    merged = io.merged_modules(t.triples.unionByName(heads), "http://ex.org/nation#3")
    return merged.where("o <> 'owl:Ontology'").select("s", "p", "o", "dt", "lang")


def streamed(t):
    """The log in three files, the newest first."""
    path = scratch(t.spark)
    for turn in (2, 0, 1):
        log(t).where(F.col("seq") % 3 == turn).repartitionByRange(4, "seq").write.mode("append").json(path)
    return logs.log_stream(t.spark, path)


@query("w01_stream_latest", f"{LATEST} SELECT source_id, concept_key, dpv_iri, decision, seq FROM cur")
def _(t):
    return logs.latest_of(logs.finished(logs.latest_changes(streamed(t)))).where("decision <> 'pending'").select("source_id", "concept_key", "dpv_iri", "decision", "seq")


@query("w02_stream_replay", """WITH cl AS (SELECT concept_key, max(seq) AS cleared FROM decisions WHERE decision = 'no_match' GROUP BY concept_key),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_key, dpv_iri ORDER BY seq DESC) AS k FROM decisions WHERE dpv_iri <> '') WHERE k = 1)
SELECT ev.concept_key, dpv_iri, relation FROM ev LEFT JOIN cl ON cl.concept_key = ev.concept_key WHERE decision = 'approved' AND (cleared IS NULL OR seq > cleared)""")
def _(t):
    return logs.in_force(logs.finished(logs.replay_changes(streamed(t))))


@query("w03_stream_answers", "SELECT DISTINCT md5(text) AS cache_key FROM documents")
def _(t):
    path = scratch(t.spark)
    t.documents.select(F.md5("text").alias("cache_key")).repartition(3).write.json(path)
    return logs.take_in(logs.log_stream(t.spark, path, "cache_key string"))


CONCEPT_ROWS = f"WITH {DECIDED}, r AS (SELECT key, 'inherited' AS status, term, 'base' AS who FROM d WHERE key % 3 = 0 UNION ALL SELECT key, CASE WHEN term IS NULL THEN 'no_match' WHEN answered THEN 'accepted' ELSE 'suggested' END, term, 'rule' FROM d WHERE key % 2 = 0)"


def report_rows(t):
    own = decided(t)
    state = F.when(F.col("term").isNull(), "no_match").when(F.col("answered"), "accepted").otherwise("suggested")
    labels = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("label"))
    return report.concept_rows(own.where("key % 3 = 0").withColumn("status", F.lit("inherited")), own.where("key % 2 = 0").withColumn("status", state), labels)


@query("j01_concept_rows", f"{CONCEPT_ROWS} SELECT key, status, term, who, source AS label FROM r JOIN documents ON doc_id = key")
def _(t):
    return report_rows(t)


@query("j02_summary", f"{CONCEPT_ROWS}, o AS (SELECT key, arg_min(status, CASE status WHEN 'inherited' THEN 0 WHEN 'accepted' THEN 1 WHEN 'suggested' THEN 2 ELSE 3 END) AS status, count(term) AS m FROM r GROUP BY key) SELECT status, count(*) AS concepts, CAST(sum(m) AS BIGINT) AS mappings FROM o GROUP BY status")
def _(t):
    return report.summary(report_rows(t))


@query("j03_evidence_text", "SELECT l_orderkey AS key, string_agg(concat('art. ', l_linenumber, ' (', CASE WHEN l_tax = 0 THEN 'cited' ELSE replace(format('{:.2f}', l_discount), '.', ',') END, ')'), '; ' ORDER BY l_partkey, concat('art. ', l_linenumber, ' (', CASE WHEN l_tax = 0 THEN 'cited' ELSE replace(format('{:.2f}', l_discount), '.', ',') END, ')')) AS text FROM lineitem GROUP BY 1")
def _(t):
    return report.evidence_text(t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("rank"), F.col("l_linenumber").alias("article"), F.when(F.col("l_tax") != 0, F.col("l_discount")).alias("distance")))


@query("j04_filter", "SELECT key, name FROM concepts WHERE kind = 'class' AND contains(lower(concat_ws(' ', name, label, definition)), 'economy')")
def _(t):
    return report.filtered(t.concepts, kinds=["class"], text="Economy").select("key", "name")


@query("j05_first_evidence", "SELECT key, seq FROM (SELECT family AS key, seq, row_number() OVER (PARTITION BY family ORDER BY seq) AS k FROM concepts WHERE kind = 'property') WHERE k = 1")
def _(t):
    own = t.concepts.select(F.col("family").alias("key"), "seq", F.when(F.col("kind") == "property", F.col("definition")).alias("definition"), F.lit(None).cast("int").alias("article"))
    return report.first_evidence(own).select("key", "seq")


@query("j06_modules", "SELECT label AS module, count(*) FILTER (WHERE kind = 'class') AS class, count(*) FILTER (WHERE kind = 'property') AS property, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM concepts GROUP BY label")
def _(t):
    return report.module_structure(t.concepts.select(F.col("label").alias("module"), "kind", "family"))


@query("j07_ranking_summary", f"{PAIRS}, b AS (SELECT id, kind, CAST(max(score) * 10000 AS BIGINT) AS best FROM p GROUP BY ALL) SELECT kind, count(*) AS n, (2 * sum(best) + count(*)) // (2 * count(*)) / 10000.0 AS mean FROM b GROUP BY kind")
def _(t):
    return report.ranking_summary(matching.best_pairs(*sides(t), 1))


@query("j08_readiness", f"""{STATUS}, half AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target, concept_key, dpv_iri ORDER BY seq DESC) AS k FROM decisions WHERE seq % 5 = 0) WHERE k = 1 AND decision <> 'pending'),
hs AS (SELECT k.concept_key, CASE WHEN coalesce(bool_or(decision = 'approved'), false) THEN 'aligned' WHEN coalesce(bool_or(decision = 'no_match'), false) THEN 'no_match' ELSE 'pending' END AS status FROM keys k LEFT JOIN half c ON c.concept_key = k.concept_key GROUP BY k.concept_key),
a AS (SELECT status, count(*) AS n FROM st GROUP BY status), b AS (SELECT status, count(*) AS n FROM hs GROUP BY status)
SELECT (SELECT coalesce(max(n) FILTER (WHERE status = 'pending'), 0) FROM a) AS pending, (SELECT bool_or(a.n IS DISTINCT FROM b.n) FROM a FULL JOIN b ON a.status = b.status) AS stale""")
def _(t):
    before = concept_status(latest(t.decisions.where("seq % 5 = 0")), keys(t))  # the report is of an earlier log
    return report.readiness(status(t), before.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
