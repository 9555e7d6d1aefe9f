"""Registered queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, indel_ratio, normalize_name
from tessera.operators import matching as ops
from tessera.operators.neighbours import build_index
from tessera.operators.search import found_by_index, search_by_index, write_postings
from tessera.plans.registry import query
from tessera.sources.storage import scratch

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def norm(x: str) -> str:
    camel = rf"strip_accents(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'))"
    words = f"list_filter(regexp_split_to_array(lower({camel}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{STOPS}], w))"
    one = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN concat(left(w, length(w) - 3), 'y') WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"
    return f"array_to_string(list_transform({words}, lambda w: {one}), ' ')"


def indel(a: str, b: str) -> str:
    """Of columns a and b, token-sorted before."""
    cell = f"CASE WHEN {b}[e[1]:e[1]] = chr(CAST(x[1] AS INT)) THEN acc[e[1]] + 1 ELSE greatest(acc[e[1] + 1], o[-1]) END"
    inner = f"list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda o, e: list_append(o, {cell}))"
    zero = f"list_transform(range(0, length({b}) + 1), lambda j: CAST(0 AS BIGINT))"
    lcs = f"list_reduce(list_prepend({zero}, list_transform(string_split({a}, ''), lambda c: [CAST(ord(c) AS BIGINT)])), lambda acc, x: {inner})[-1]"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE round(2.0 * {lcs} / (length({a}) + length({b})), 4) END"


def tsort(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


ITEMS = f"""items AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN label % 2 = 0 THEN 'class' ELSE 'property' END AS kind,
 label, {norm('p_name')} AS norm FROM embeddings JOIN part ON p_partkey = vec_id % (SELECT count(*) FROM part))"""
PAIRS = f"""WITH {ITEMS}, l AS (SELECT a, b, {indel('sa', 'sb')} AS lexical FROM (SELECT DISTINCT x.norm AS a, y.norm AS b, {tsort('x.norm')} AS sa, {tsort('y.norm')} AS sb FROM items x JOIN items y ON x.kind = y.kind AND x.id % 100 = 0)),
p AS (SELECT x.id, y.id AS t_id, x.kind, lexical, semantic, round((0.4 * lexical + 0.6 * semantic) / 1.0, 4) AS score FROM
 (SELECT x.id AS id, y.id AS t, round(least(1.0, greatest(0.0, list_dot_product(x.v, y.v))), 6) AS semantic FROM items x JOIN items y ON x.kind = y.kind AND x.id % 100 = 0 AND y.id <> x.id) AS q
 JOIN items x ON x.id = q.id JOIN items y ON y.id = q.t JOIN l ON l.a = x.norm AND l.b = y.norm)"""
NEAR = f"""WITH {ITEMS}, n AS (SELECT id, t_id, distance, row_number() OVER (PARTITION BY id ORDER BY distance, t_id) AS rank FROM
 (SELECT x.id, y.id AS t_id, round(1 - least(1.0, greatest(0.0, list_dot_product(x.v, y.v))), 6) AS distance FROM items x JOIN items y ON x.kind = y.kind AND x.id % 100 = 0 AND y.id <> x.id))"""


def items(t):
    kind = F.when(F.col("label") % 2 == 0, "class").otherwise("property")
    named = t.embeddings.join(F.broadcast(t.part.agg(F.count(F.lit(1)).alias("n_part")))).withColumn("n_part", F.col("vec_id") % F.col("n_part"))
    own = named.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("n_part"))
    return own.select(F.col("vec_id").alias("id"), "embedding", kind.alias("kind"), "label", normalize_name(F.col("p_name")).alias("norm"))


def sides(t):
    """The query set (every id that 100 divides) and all rows."""
    own = items(t)
    return own.where("id % 100 = 0"), own


def all_pairs(t):
    return ops.scored_pairs(*sides(t)).where("id <> t_id")


@query("c01_normalize", f"SELECT DISTINCT label, {norm('label')} AS norm FROM (SELECT label FROM terms UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents)")
def _(t):
    names = t.terms.select("label").unionByName(t.documents.select(F.explode(F.split("text", " ")).alias("label"))).distinct()
    return ops.normalized(names, "label").select("label", "norm")


@query("c02_indel", f"SELECT a, b, {indel('sa', 'sb')} AS ratio FROM (SELECT DISTINCT {norm('x.label')} AS a, {norm('y.name')} AS b, {tsort(norm('x.label'))} AS sa, {tsort(norm('y.name'))} AS sb FROM terms x JOIN terms y ON x.kind = y.kind)")
def _(t):
    a = t.terms.select("kind", normalize_name(F.col("label")).alias("a")).distinct()
    b = t.terms.select("kind", normalize_name(F.col("name")).alias("b")).distinct()
    pairs = a.join(b, "kind").select("a", "b").distinct()
    return pairs.withColumn("ratio", F.round(indel_ratio(F.col("a"), F.col("b")), 4))


@query("c03_lexical_matrix", f"SELECT kind, a, b, {indel('sa', 'sb')} AS lexical FROM (SELECT DISTINCT x.kind, {norm('x.name')} AS a, {norm('y.label')} AS b, {tsort(norm('x.name'))} AS sa, {tsort(norm('y.label'))} AS sb FROM (SELECT DISTINCT name, kind FROM concepts) x JOIN terms y ON x.kind = y.kind)")
def _(t):
    return ops.lexical_scores(ops.normalized(t.concepts), ops.normalized(t.terms, "label"))


@query("c03_similar_names", f"SELECT * FROM (SELECT kind, a, b, {indel('sa', 'sb')} AS lexical FROM (SELECT DISTINCT x.kind, {norm('x.name')} AS a, {norm('y.label')} AS b, {tsort(norm('x.name'))} AS sa, {tsort(norm('y.label'))} AS sb FROM (SELECT DISTINCT name, kind FROM concepts) x JOIN terms y ON x.kind = y.kind)) WHERE lexical >= 0.8")
def _(t):
    return ops.similar_names(ops.normalized(t.concepts), ops.normalized(t.terms, "label"), 0.8)


@query("c04_best_lexical", f"""
WITH n AS (SELECT DISTINCT name, kind, {norm('name')} AS a FROM concepts), m AS (SELECT iri, kind, {norm('label')} AS b FROM terms),
s AS (SELECT a, b, {indel('sa', 'sb')} AS lexical FROM (SELECT DISTINCT a, b, {tsort('a')} AS sa, {tsort('b')} AS sb FROM n JOIN m ON n.kind = m.kind)),
r AS (SELECT n.name, n.kind, iri, lexical, row_number() OVER (PARTITION BY n.name, n.kind ORDER BY lexical DESC, iri) AS rank FROM n JOIN m ON n.kind = m.kind JOIN s ON s.a = n.a AND s.b = m.b)
SELECT key, iri, lexical, rank FROM concepts c JOIN r ON c.name = r.name AND c.kind = r.kind WHERE rank <= 2""")
def _(t):
    return ops.best_lexical(ops.normalized(t.concepts), ops.normalized(t.terms, "label"), 2)


@query("c05_cosine", f"{PAIRS} SELECT id, t_id, semantic FROM p")
def _(t):
    return ops.cosines(*[side.where("norm is not null") for side in sides(t)]).where("id <> t_id")


@query("c07_hybrid", f"{PAIRS} SELECT id, t_id, kind, lexical, semantic, score FROM p")
def _(t):
    return all_pairs(t)


@query("c08_listed_scores", f"{PAIRS} SELECT id, t_id, score FROM p WHERE t_id IN (id + 1, id + 2)")
def _(t):
    s, targets = sides(t)
    listed = s.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("t_id"))
    return ops.listed_pairs(s, targets, listed).select("id", "t_id", "score")


RANKED = f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lexical DESC, t_id) AS rank FROM p)"


@query("c09_top_candidates", f"{RANKED} SELECT id, t_id, kind, lexical, semantic, score, rank FROM r WHERE rank <= 3")
def _(t):
    return ops.top_candidates(ops.best_pairs(*sides(t), 3), 3)


@query("c10_candidate_lists", f"{RANKED}, g AS (SELECT id, string_agg(t_id, ',' ORDER BY rank) AS l FROM r WHERE rank <= 5 GROUP BY id) SELECT i.id, coalesce(l, '') AS candidates FROM items i LEFT JOIN g ON g.id = i.id WHERE i.id % 100 = 0")
def _(t):
    s, targets = sides(t)
    return ops.candidate_lists(s, all_pairs(t), 5).select("id", F.array_join("candidates", ",").alias("candidates"))


@query("c11_nearest", f"{NEAR} SELECT id, t_id, distance, rank FROM n WHERE rank <= 5")
def _(t):
    return ops.nearest(*sides(t), 5)


@query("c11_by_cells", f"{NEAR} SELECT id, t_id, distance, rank FROM n WHERE rank <= 5")
def _(t):
    s, targets = sides(t)
    return ops.nearest(s, targets, 5, index=build_index(targets))


@query("c12_pool_rerank", f"""{PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 1 - semantic, t_id) AS near FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lexical DESC, t_id) AS rank FROM n WHERE near <= 10) SELECT id, t_id, kind, lexical, semantic, score, rank FROM r WHERE rank <= 3""")
def _(t):
    return ops.pooled(*sides(t), 10, 3)


@query("c13_precedents", f"{NEAR.replace('y.id <> x.id', 'y.id <> x.id AND (x.id + y.id) % 5 <> 0')} SELECT id, t_id, distance, rank FROM n WHERE rank <= 3")
def _(t):
    s, decided = sides(t)
    return ops.precedents(s, decided, (F.col("id") + F.col("t_id")) % 5 == 0, 3)


@query("c13_by_cells", f"{NEAR.replace('y.id <> x.id', 'y.id <> x.id AND y.id NOT IN (x.id + 1, x.id + 2, x.id + 20)')} SELECT id, t_id, distance, rank FROM n WHERE rank <= 3")
def _(t):
    s, decided = sides(t)
    forbidden = s.select("id", F.explode(F.array([F.col("id") + i for i in (1, 2, 20)])).alias("t_id"))
    return ops.precedents(s, decided, forbidden, 3, index=build_index(decided))


@query("c14_retrieve", "WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS t_id, round(1 - least(1.0, greatest(0.0, list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.v))), 6) AS distance FROM embeddings, q WHERE vec_id <> 0 ORDER BY distance, t_id LIMIT 10")
def _(t):
    one = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.lit("any").alias("kind"))
    return ops.nearest(one.where("id = 0"), one, 10).select("t_id", "distance")


DUPLICATES = f"""{PAIRS}, b AS (SELECT id, arg_max(t_id, [-rs]) AS by_score, max(score) AS score, arg_max(t_id, [-rn]) AS by_name, max(lexical) AS lexical FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lexical DESC, t_id) AS rs, row_number() OVER (PARTITION BY id ORDER BY lexical DESC, score DESC, t_id) AS rn FROM p) GROUP BY id),
d AS (SELECT id, CASE WHEN score >= 0.75 THEN by_score WHEN lexical >= 0.95 THEN by_name END AS t_id, CASE WHEN score >= 0.75 THEN 'similar' WHEN lexical >= 0.95 THEN 'same_name' END AS reason, score, lexical FROM b)"""


@query("c15_duplicates", f"{DUPLICATES} SELECT id, t_id, reason, score, lexical FROM d WHERE reason IS NOT NULL")
def _(t):
    return ops.possible_duplicates(ops.best_pairs(*sides(t), 1, ops.BY_SCORE, ops.BY_NAME))


@query("c16_bands", f"{PAIRS}, m AS (SELECT id, max(score) AS score FROM p GROUP BY id) SELECT CASE WHEN score >= 0.85 THEN 'very high' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM m GROUP BY 1")
def _(t):
    return ops.bands(ops.best_pairs(*sides(t), 1))


@query("c17_family_means", f"{NEAR} SELECT label AS family, count(*) AS n, (sum(CAST((1 - distance) * 1000000 AS BIGINT)) + 50 * count(*)) // (100 * count(*)) / 10000.0 AS mean FROM n JOIN items i ON i.id = n.id WHERE rank = 1 GROUP BY label")
def _(t):
    return ops.family_means(ops.nearest(*sides(t), 1), items(t).select("id", F.col("label").alias("family")))


INHERIT = f"""{PAIRS}, iri AS (SELECT x.id, y.label AS sig FROM items x JOIN items y ON x.id % 100 = 0 AND y.id <> x.id AND x.id % 40 = 0 AND y.id = x.id + 1),
i1 AS (SELECT id, 'iri' AS method, count(DISTINCT sig) AS n, min(sig) AS sig FROM iri GROUP BY id),
i2 AS (SELECT x.id, 'name' AS method, count(DISTINCT y.label) AS n, min(y.label) AS sig FROM items x JOIN items y ON x.norm = y.norm AND x.norm <> '' AND y.id <> x.id AND y.id % 3 = 0 WHERE x.id % 100 = 0 AND x.id NOT IN (SELECT id FROM i1) GROUP BY x.id),
a AS (SELECT * FROM p WHERE (score >= 0.75 OR lexical >= 0.95) AND t_id % 3 = 0 AND id NOT IN (SELECT id FROM i1) AND id NOT IN (SELECT id FROM i2)),
i3 AS (SELECT a.id, 'similarity' AS method, count(DISTINCT y.label) AS n, min(y.label) AS sig FROM a JOIN items y ON y.id = a.t_id WHERE score = (SELECT max(score) FROM a z WHERE z.id = a.id) GROUP BY a.id),
f AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3),
h AS (SELECT x.id, method, CASE WHEN n = 1 THEN sig END AS signature, CASE WHEN n = 1 THEN 'inherited' WHEN n > 1 THEN 'ambiguous' ELSE 'no_match' END AS status FROM items x LEFT JOIN f ON f.id = x.id WHERE x.id % 100 = 0)"""


def inherited(t):
    s, targets = sides(t)
    users = s.withColumn("iri", F.when(F.col("id") % 40 == 0, F.col("id") + 1))
    by_iri = targets.select("id", F.col("id").alias("iri"), F.lit("").alias("norm"), F.col("label").alias("signature"))
    base = targets.where("id % 3 = 0").select("id", F.lit(None).cast("bigint").alias("iri"), "norm", F.col("label").alias("signature"))
    every = by_iri.unionByName(base)
    pairs = all_pairs(t).where("t_id % 3 = 0")
    return ops.inherit(users, every, pairs)


@query("c18_inherit", f"{INHERIT} SELECT id, method, signature, status FROM h")
def _(t):
    return inherited(t)


@query("c19_inherit_summary", f"{INHERIT} SELECT coalesce(method, 'none') AS method, status, count(*) AS n FROM h GROUP BY ALL")
def _(t):
    return ops.inheritance_summary(inherited(t))


@query("c20_same_concepts", f"""{PAIRS}, e AS (SELECT x.id, y.id AS t_id, 2 AS rule FROM items x JOIN items y ON x.norm = y.norm AND x.norm <> '' WHERE x.id % 100 = 0
 UNION ALL SELECT id, t_id, 3 FROM p WHERE score >= 0.75 OR lexical >= 0.95 UNION ALL SELECT x.id, y.id, 1 FROM items x JOIN items y ON x.id % 50 = y.id % 50 WHERE x.id % 100 = 0)
SELECT id, t_id, min(rule) AS rule FROM e WHERE id <> t_id GROUP BY id, t_id""")
def _(t):
    rows = items(t).select("id", (F.col("id") % 50).alias("iri"), "norm")
    return ops.same_concept_pairs(rows.where("id % 100 = 0"), rows, all_pairs(t))


@query("c23_bridge", """
WITH a AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS term FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS b, l_partkey AS term FROM lineitem WHERE l_quantity < 5)
SELECT a, b, string_agg(a.term, ',' ORDER BY a.term) AS terms FROM a JOIN b ON a.term = b.term GROUP BY a, b""")
def _(t):
    own = lambda name, where: t.lineitem.where(where).select(F.col("l_suppkey").alias(name), F.col("l_partkey").alias("term"))
    return ops.bridge(own("a", "l_quantity > 45"), own("b", "l_quantity < 5"))


@query("c25_search", "SELECT key, hit FROM (SELECT *, CASE WHEN contains(lower(name), 'ring') OR contains(lower(label), 'ring') THEN 0 WHEN contains(lower(definition), 'ring') THEN 1 END AS hit FROM concepts) WHERE hit IS NOT NULL ORDER BY hit, seq LIMIT 15")
def _(t):
    return ops.search(t.concepts, "ring")


@query("c25_by_index", "SELECT key, CASE WHEN contains(lower(name), 'ring') OR contains(lower(label), 'ring') THEN 0 ELSE 1 END AS hit FROM concepts WHERE kind = 'class' AND contains(lower(concat_ws(chr(1), name, label, definition)), 'ring') ORDER BY hit, seq LIMIT 15")
def _(t):
    path = scratch(t.spark)
    write_postings(t.concepts, path)
    return search_by_index(t.spark, path, " RiNG ", ["class"])


@query("c25_all_hits", "SELECT key, CASE WHEN contains(lower(name), 'an') OR contains(lower(label), 'an') THEN 0 ELSE 1 END AS hit FROM concepts WHERE contains(lower(concat_ws(chr(1), name, label, definition)), 'an')")
def _(t):
    path = scratch(t.spark)
    write_postings(t.concepts, path)
    return found_by_index(t.spark, path, "an").select("key", "hit")


@query("c26_evidence", f"{NEAR} SELECT id, t_id, 'nearest' AS origin FROM n WHERE rank <= 3 AND distance <= 0.8 AND id % 200 <> 0 UNION ALL SELECT id, id + 1, 'cited' FROM items WHERE id % 200 = 0")
def _(t):
    s, targets = sides(t)
    return ops.select_evidence(ops.nearest(s, targets, 3), s.where("id % 200 = 0").select("id", (F.col("id") + 1).alias("t_id")), 3, 0.8)
