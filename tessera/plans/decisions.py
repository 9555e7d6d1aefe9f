"""Registered queries of the decision-log operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import decisions as ops
from tessera.operators import digests
from tessera.plans.registry import query

LATEST = """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target, concept_key, dpv_iri ORDER BY seq DESC) AS k FROM decisions) WHERE k = 1 AND decision <> 'pending'),
keys AS (SELECT DISTINCT concept_key FROM decisions)"""
STATUS = f"""{LATEST}, st AS (SELECT k.concept_key, CASE WHEN coalesce(bool_or(decision = 'approved'), false) THEN 'aligned' WHEN coalesce(bool_or(decision = 'no_match'), false) THEN 'no_match' ELSE 'pending' END AS status
 FROM keys k LEFT JOIN cur c ON c.concept_key = k.concept_key GROUP BY k.concept_key)"""
CANDIDATES = "cand AS (SELECT concept_key, 't1' AS dpv_iri, 1 AS rank FROM keys UNION ALL SELECT concept_key, 't3', 2 FROM keys)"


def keys(t):
    return t.decisions.select("concept_key").distinct()


def candidates(t):
    pair = lambda term, rank: F.struct(F.lit(term).alias("dpv_iri"), F.lit(rank).alias("rank"))
    return keys(t).select("concept_key", F.explode(F.array(pair("t1", 1), pair("t3", 2))).alias("c")).select("concept_key", "c.*")


def current(t):
    return ops.latest(t.decisions)


def status(t):
    return ops.concept_status(current(t), keys(t))


@query("d01_validate", """
WITH b AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN 'concept' WHEN seq % 101 = 0 THEN 'other' ELSE 'mapping' END AS target, CASE WHEN seq % 11 = 0 THEN 'maybe' WHEN seq % 21 = 0 THEN 'duplicate' ELSE decision END AS decision,
 CASE WHEN seq % 13 = 0 THEN '' ELSE concept_key END AS concept_key, CASE WHEN seq % 14 = 0 OR seq % 21 = 0 THEN '' ELSE dpv_iri END AS dpv_iri, CASE WHEN seq % 17 = 0 OR seq % 28 = 0 OR seq % 21 = 0 THEN NULL ELSE relation END AS relation,
 CASE WHEN seq % 19 = 0 THEN '  ' ELSE reviewer END AS reviewer, CASE WHEN seq % 23 = 0 THEN NULL ELSE source_id END AS source_id, CASE WHEN seq % 56 = 0 THEN 'class' WHEN seq % 29 = 0 THEN 'thing' END AS entity_kind, CASE WHEN seq % 42 = 0 OR seq % 31 = 0 THEN 'x' END AS same_as FROM decisions)
SELECT seq, CASE WHEN trim(coalesce(reviewer, '')) = '' THEN 'no reviewer' WHEN source_id IS NULL THEN 'no source' WHEN concept_key = '' THEN 'no concept' WHEN target NOT IN ('concept', 'mapping') THEN 'unknown target'
 WHEN (target = 'concept' AND decision NOT IN ('approved', 'rejected', 'duplicate', 'pending')) OR (target = 'mapping' AND decision NOT IN ('approved', 'rejected', 'no_match', 'pending')) THEN 'unknown decision'
 WHEN target = 'concept' THEN CASE WHEN dpv_iri <> '' THEN 'concept with a term' WHEN relation IS NOT NULL THEN 'concept with a relation' WHEN decision = 'approved' AND coalesce(entity_kind, '') NOT IN ('class', 'object_property', 'datatype_property') THEN 'approved without an entity kind'
  WHEN decision <> 'approved' AND entity_kind IS NOT NULL THEN 'entity kind without approval' WHEN decision = 'duplicate' AND same_as IS NULL THEN 'duplicate of nothing' WHEN decision <> 'duplicate' AND same_as IS NOT NULL THEN 'same entity without duplicate' END
 WHEN entity_kind IS NOT NULL THEN 'mapping with an entity kind' WHEN same_as IS NOT NULL THEN 'mapping with a same entity' WHEN decision = 'no_match' AND (dpv_iri <> '' OR relation IS NOT NULL) THEN 'no_match with a term or relation'
 WHEN decision NOT IN ('no_match', 'pending') AND dpv_iri = '' THEN 'no term' WHEN decision = 'approved' AND relation IS NULL THEN 'approved without a known relation' WHEN decision <> 'approved' AND relation IS NOT NULL THEN 'relation without approval' END AS reason FROM b""")
def _(t):
    by = lambda *n: reduce(lambda a, b: a | b, [F.col("seq") % i == 0 for i in n])
    bad = t.decisions.withColumns({
        "target": F.when(by(7), "concept").when(by(101), "other").otherwise("mapping"), "decision": F.when(by(11), "maybe").when(by(21), "duplicate").otherwise(F.col("decision")),
        "concept_key": F.when(by(13), "").otherwise(F.col("concept_key")), "dpv_iri": F.when(by(14, 21), "").otherwise(F.col("dpv_iri")), "relation": F.when(~by(17, 28, 21), F.col("relation")),
        "reviewer": F.when(by(19), "  ").otherwise(F.col("reviewer")), "source_id": F.when(~by(23), F.col("source_id")), "entity_kind": F.when(by(56), "class").when(by(29), "thing"), "same_as": F.when(by(42, 31), "x"),
    })
    return ops.validated(bad).select("seq", "reason")


@query("d02_latest", f"{LATEST} SELECT source_id, concept_key, dpv_iri, decision, relation, reviewer, seq FROM cur")
def _(t):
    return current(t).select("source_id", "concept_key", "dpv_iri", "decision", "relation", "reviewer", "seq")


@query("d03_counts", f"{LATEST} SELECT target, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE decision = 'no_match') AS no_match, count(*) FILTER (WHERE decision = 'pending') AS pending FROM cur GROUP BY target")
def _(t):
    return ops.counts(current(t))


@query("d04_status", f"{STATUS} SELECT concept_key, status FROM st")
def _(t):
    return status(t)


@query("d05_progress", f"{STATUS} SELECT substr(concept_key, 1, 2) AS origin, count(*) FILTER (WHERE status = 'aligned') AS aligned, count(*) FILTER (WHERE status = 'no_match') AS no_match, count(*) FILTER (WHERE status = 'pending') AS pending FROM st GROUP BY 1")
def _(t):
    return ops.progress(status(t), keys(t).withColumn("origin", F.substring("concept_key", 1, 2)))


@query("d06_approved", f"{LATEST}, {CANDIDATES} SELECT source_id, c.concept_key, c.dpv_iri, relation, rank, CASE WHEN rank IS NULL THEN 'search' ELSE 'candidates' END AS found_by FROM cur c LEFT JOIN cand d ON d.concept_key = c.concept_key AND d.dpv_iri = c.dpv_iri WHERE decision = 'approved'")
def _(t):
    return ops.approved_mappings(current(t), candidates(t))


@query("d07_row_states", f"{LATEST}, {CANDIDATES}, o AS (SELECT concept_key, dpv_iri, arg_max(decision, seq) AS decision FROM cur WHERE dpv_iri <> '' GROUP BY ALL) SELECT coalesce(d.concept_key, o.concept_key) AS concept_key, coalesce(d.dpv_iri, o.dpv_iri) AS dpv_iri, rank, coalesce(decision, 'open') AS state FROM cand d FULL JOIN o ON d.concept_key = o.concept_key AND d.dpv_iri = o.dpv_iri")
def _(t):
    return ops.row_states(candidates(t), current(t))


@query("d08_next_pending", f"{STATUS} SELECT concept_key, coalesce((SELECT min(b.concept_key) FROM st b WHERE b.status = 'pending' AND b.concept_key > a.concept_key), (SELECT min(b.concept_key) FROM st b WHERE b.status = 'pending')) AS next FROM st a")
def _(t):
    return ops.next_pending(status(t))


@query("d09_agreement", f"{LATEST}, pr AS (SELECT concept_key, concat('t', CAST(i AS VARCHAR)) AS dpv_iri, 'closeMatch' AS proposed FROM keys, range(0, 7) r(i)), b AS (SELECT relation, proposed FROM cur c JOIN pr p ON p.concept_key = c.concept_key AND p.dpv_iri = c.dpv_iri WHERE decision = 'approved') SELECT count(*) AS n, count(*) FILTER (WHERE relation = proposed) AS same, round(count(*) FILTER (WHERE relation = proposed) / count(*), 4) AS share FROM b")
def _(t):
    proposals = keys(t).select("concept_key", F.explode(F.array(*[F.lit(f"t{i}") for i in range(7)])).alias("dpv_iri"), F.lit("closeMatch").alias("relation"))
    return ops.agreement(current(t), proposals)


@query("d10_open_proposals", f"""WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target, concept_key, dpv_iri ORDER BY seq DESC) AS k FROM decisions WHERE dpv_iri IN ('t0', 't2')) WHERE k = 1 AND decision <> 'pending'),
keys AS (SELECT DISTINCT concept_key FROM decisions), {CANDIDATES}, done AS (SELECT concept_key FROM cur WHERE decision IN ('approved', 'no_match'))
SELECT concept_key, dpv_iri, rank FROM cand WHERE concept_key NOT IN (SELECT concept_key FROM done)""")
def _(t):
    early = ops.latest(t.decisions.where("dpv_iri in ('t0', 't2')"))  # as the log stood when only these terms had been looked at
    return ops.open_proposals(candidates(t), ops.concept_status(early, keys(t)))


@query("d12_best_with_clash", "WITH b AS (SELECT family AS key, arg_min(name, seq) AS name FROM concepts GROUP BY family) SELECT key, name, lower(name) IN (SELECT lower(name) FROM concepts WHERE kind = 'property') AS clash FROM b")
def _(t):
    rows = t.concepts.select(F.col("family").alias("key"), "name", F.col("seq").alias("rank"))
    return ops.best_with_clash(rows, t.concepts.where("kind = 'property'"))


@query("d13_excluded", f"{LATEST} SELECT DISTINCT concept_key FROM cur WHERE decision = 'rejected' AND concept_key NOT IN (SELECT concept_key FROM cur WHERE decision = 'approved')")
def _(t):
    return ops.excluded(current(t))


@query("d14_approvals", """
WITH a AS (SELECT *, lag(decision) OVER w AS d0, lag(relation) OVER w AS r0 FROM decisions WHERE dpv_iri <> '' WINDOW w AS (PARTITION BY source_id, concept_key, dpv_iri ORDER BY seq)),
b AS (SELECT *, lead(seq) OVER (PARTITION BY source_id, concept_key, dpv_iri ORDER BY seq) AS until FROM a WHERE NOT coalesce(decision = 'approved' AND d0 = 'approved' AND r0 IS NOT DISTINCT FROM relation, false)),
c AS (SELECT source_id, concept_key, dpv_iri, relation, seq, until FROM b WHERE decision = 'approved')
SELECT *, 1 + (SELECT count(*) FROM c x WHERE x.source_id = c.source_id AND x.concept_key = c.concept_key AND x.until < c.seq) AS version FROM c""")
def _(t):
    return ops.approvals(t.decisions)


REPLAY = """WITH base AS (SELECT DISTINCT concept_key, 't0' AS dpv_iri, 'exactMatch' AS relation FROM decisions UNION ALL SELECT 'x9', 't0', 'exactMatch'),
cl AS (SELECT concept_key, max(seq) AS cleared FROM log WHERE decision = 'no_match' GROUP BY concept_key),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_key, dpv_iri ORDER BY seq DESC) AS k FROM log WHERE dpv_iri <> '') WHERE k = 1),
rp AS (SELECT concept_key, dpv_iri, relation, 'base' AS origin FROM base b WHERE concept_key NOT IN (SELECT concept_key FROM cl) AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.concept_key = b.concept_key AND ev.dpv_iri = b.dpv_iri)
 UNION ALL SELECT ev.concept_key, dpv_iri, relation, 'user' FROM ev LEFT JOIN cl ON cl.concept_key = ev.concept_key WHERE decision = 'approved' AND (cleared IS NULL OR seq > cleared))"""
REPLAY = REPLAY.replace("WITH base", "WITH log AS (SELECT * FROM decisions WHERE seq % 3 = 0), base", 1)


def base(t):
    one = lambda df: df.select("concept_key", F.lit("t0").alias("dpv_iri"), F.lit("exactMatch").alias("relation"))
    return one(keys(t)).unionByName(one(t.spark.createDataFrame([("x9",)], "concept_key string")))


@query("d15_replay", f"{REPLAY} SELECT concept_key, dpv_iri, relation, origin FROM rp")
def _(t):
    return ops.replay(base(t), t.decisions.where("seq % 3 = 0"))


@query("d16_overlay", f"""{REPLAY}, tc AS (SELECT DISTINCT concept_key FROM log), af AS (SELECT * FROM rp WHERE concept_key IN (SELECT concept_key FROM tc))
SELECT concept_key, dpv_iri, relation, 'base' AS origin FROM base WHERE concept_key NOT IN (SELECT concept_key FROM tc) UNION ALL SELECT concept_key, dpv_iri, relation, origin FROM af
UNION ALL SELECT concept_key, '', NULL, 'no_match' FROM tc WHERE concept_key NOT IN (SELECT concept_key FROM af)""")
def _(t):
    return ops.overlay(base(t), t.decisions.where("seq % 3 = 0"))


@query("d18_change_rows", """
WITH r AS (SELECT seq, concept_key, CASE WHEN seq % 4 < 2 THEN 't1' END AS replaces, dpv_iri, CASE seq % 4 WHEN 0 THEN 'replace' WHEN 1 THEN 'remove' WHEN 2 THEN 'add' ELSE 'remove' END AS action FROM decisions WHERE dpv_iri <> '')
SELECT seq, concept_key, 0 AS step, CASE WHEN action = 'replace' THEN 'rejected' WHEN action = 'add' THEN 'approved' WHEN replaces IS NOT NULL THEN 'rejected' ELSE 'no_match' END AS decision,
 CASE WHEN action = 'add' THEN dpv_iri WHEN replaces IS NOT NULL THEN replaces ELSE '' END AS dpv_iri FROM r
UNION ALL SELECT seq, concept_key, 1, 'approved', dpv_iri FROM r WHERE action = 'replace'""")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("replace", "remove", "add", "remove"))), (F.col("seq") % 4 + 1).cast("int"))
    requests = t.decisions.where("dpv_iri <> ''").select("seq", "concept_key", "dpv_iri", F.when(F.col("seq") % 4 < 2, "t1").alias("replaces"), kind.alias("action"))
    return ops.change_rows(requests)


@query("d19_versions", "SELECT source_id, concept_key, row_number() OVER w AS version, seq, lead(seq) OVER w AS until FROM decisions WINDOW w AS (PARTITION BY source_id, concept_key ORDER BY seq)")
def _(t):
    return ops.version_validity(t.decisions)


def field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({x} AS VARCHAR))), ':', {x}) END"


def row_hash(*columns: str) -> str:
    return f"sha256(concat({', '.join(map(field, columns))}))"


@query("d20_fingerprint", f"SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(h, ':', n), ',' ORDER BY h)) AS digest FROM (SELECT {row_hash('n_nationkey', 'n_name', 'n_regionkey')} AS h, count(*) AS n FROM nation GROUP BY h)")
def _(t):
    return digests.fingerprint(t.nation, ["n_nationkey", "n_name", "n_regionkey"])


TREE = f"""r AS (SELECT {row_hash('l_returnflag', 'l_linestatus', 'l_partkey', 'l_quantity')} AS h, count(*) AS n FROM lineitem GROUP BY h),
t2 AS (SELECT 2 AS level, substr(h, 1, 2) AS prefix, sum(n) AS n, sha256(string_agg(concat(h, ':', n), ',' ORDER BY h)) AS digest FROM r GROUP BY substr(h, 1, 2)),
t1 AS (SELECT 1 AS level, substr(prefix, 1, 1) AS prefix, sum(n) AS n, sha256(string_agg(concat(prefix, ':', digest), ',' ORDER BY prefix)) AS digest FROM t2 GROUP BY substr(prefix, 1, 1)),
t0 AS (SELECT 0 AS level, '' AS prefix, sum(n) AS n, sha256(string_agg(concat(prefix, ':', digest), ',' ORDER BY prefix)) AS digest FROM t1)"""


@query("d20_tree", f"WITH {TREE} SELECT level, prefix, CAST(n AS BIGINT) AS n, digest FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)")
def _(t):
    return digests.digest_tree(t.lineitem, ["l_returnflag", "l_linestatus", "l_partkey", "l_quantity"], depth=2)


@query("d20_changed", f"WITH h AS (SELECT DISTINCT {row_hash('c_custkey', 'c_name', 'c_mktsegment')} AS h FROM customer WHERE c_custkey % 500 = 0 UNION SELECT DISTINCT {row_hash('c_custkey', 'c_name', chr(39) + 'NEW' + chr(39))} FROM customer WHERE c_custkey % 500 = 0) SELECT DISTINCT substr(h, 1, 2) AS prefix, 2 AS level FROM h")
def _(t):
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    new = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 500 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return digests.changed_subtrees(digests.digest_tree(t.customer, columns, 2), digests.digest_tree(new, columns, 2))


@query("d21_current", "SELECT 'nation' AS name, NOT EXISTS (SELECT n_nationkey, n_name FROM nation EXCEPT SELECT n_nationkey, n_name FROM nation ORDER BY 1) AS current UNION ALL SELECT 'region', (SELECT count(*) FROM region WHERE r_regionkey > 0) = (SELECT count(*) FROM region)")
def _(t):
    one = lambda name, df, c: digests.fingerprint(df, c).withColumn("name", F.lit(name))
    n, r = ["n_nationkey", "n_name"], ["r_regionkey", "r_name"]
    saved = one("nation", t.nation, n).unionByName(one("region", t.region, r))
    return ops.is_current(saved, one("nation", t.nation.orderBy(F.desc("n_name")), n).unionByName(one("region", t.region.where("r_regionkey > 0"), r)))


@query("d22_cache_split", f"SELECT doc_id, sha256(concat('5:model', {field('text')})) AS cache_key, source IN ('src1', 'src2') OR text IN (SELECT text FROM documents WHERE source IN ('src1', 'src2')) AS hit FROM documents")
def _(t):
    keyed = t.documents.select("doc_id", "source", ops.cache_key(F.lit("model"), F.col("text")).alias("cache_key"))
    return ops.cache_split(keyed.select("doc_id", "cache_key"), keyed.where("source in ('src1', 'src2')"))


@query("d23_cache_merge", """
WITH c AS (SELECT md5(text) AS cache_key, source AS answer, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS turn FROM documents)
SELECT cache_key, answer FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY turn, answer) AS k FROM c) WHERE k = 1""")
def _(t):
    own = lambda where: t.documents.where(where).select(F.md5("text").alias("cache_key"), F.col("source").alias("answer"))
    return ops.cache_merge(own("lang = 'en'"), own("lang = 'de'"), own("lang not in ('en', 'de')"))


@query("d24_aliases", "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(t):
    aliases = t.spark.createDataFrame([("HOUSEHOLD", "home"), ("MACHINERY", "industry")], "alias string, person string")
    return ops.canonical_names(t.customer.select("c_custkey", "c_mktsegment"), aliases, "c_mktsegment")


@query("d25_record_ids", "SELECT c_custkey, substr(sha256(concat_ws(' ', c_name, c_mktsegment)), 1, 16) AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", ops.record_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("d29_unattributed", f"{LATEST} SELECT DISTINCT concept_key, dpv_iri FROM cur WHERE decision = 'approved' AND (concept_key, dpv_iri) NOT IN (SELECT (concept_key, dpv_iri) FROM decisions WHERE seq % 3 = 0)")
def _(t):
    return ops.unattributed(current(t).where("decision = 'approved'"), t.decisions.where("seq % 3 = 0"))


@query("d31_in_force", f"{LATEST}, r AS (SELECT concept_key, dpv_iri, source_id, decision, seq % 2 = 0 AS current FROM cur WHERE decision IN ('approved', 'no_match')) SELECT *, CASE WHEN decision = 'approved' THEN current ELSE current AND NOT bool_or(decision = 'approved' AND current) OVER (PARTITION BY concept_key) END AS in_force FROM r")
def _(t):
    records = current(t).where("decision in ('approved', 'no_match')").select("concept_key", "dpv_iri", "source_id", "decision", (F.col("seq") % 2 == 0).alias("current"))
    return ops.in_force(records)


@query("d32_content_ids", "SELECT sha256(concat('law', chr(10), text)) AS id, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return ops.content_ids(t.documents, "law", "text")
