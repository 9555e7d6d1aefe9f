"""Registered queries of the rule and measurement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matching, measure, rules
from tessera.plans.matching import NEAR, items, sides
from tessera.plans.registry import query
from tessera.sources.storage import saved

RAW = "SELECT event_id AS key, CASE event_id % 5 WHEN 0 THEN substr(props, 1, 5) WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('Answer: ', props, ' end') ELSE props END AS raw FROM events"


def answers(t):
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.substring("props", 1, 5)).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Answer: "), "props", F.lit(" end"))).otherwise(F.col("props"))
    return t.events.select(F.col("event_id").alias("key"), raw.alias("raw"))


@query("e01_parse_lines", rf"""
WITH a AS ({RAW}), l AS (SELECT key, unnest(string_split(raw, chr(10))) AS x, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS line FROM a)
SELECT key, CAST(line AS INT) AS line, CAST(nullif(regexp_extract(regexp_extract(x, '\{{.*\}}'), '[0-9]+'), '') AS INT) AS k, regexp_extract(x, '\{{.*\}}') = '' AS bad FROM l WHERE trim(x) <> ''""")
def _(t):
    return rules.parsed_lines(answers(t), "k int")


@query("e02_parse_object", rf"WITH a AS ({RAW}) SELECT key, CAST(nullif(regexp_extract(regexp_extract(raw, '\{{.*\}}'), '[0-9]+'), '') AS INT) AS k FROM a")
def _(t):
    return answers(t).select("key", F.from_json(rules.json_text(F.col("raw")), "k int")["k"].alias("k"))


@query("e03_article_number", "SELECT url, CAST(nullif(regexp_extract(url, '[0-9]+'), '') AS INT) AS article FROM pages")
def _(t):
    return t.pages.select("url", rules.article_number(F.col("url")).alias("article"))


@query("e04_merge", "SELECT arg_min(name, seq) AS name, arg_min(label, seq) AS label, string_agg(DISTINCT seq % 12, ',' ORDER BY seq % 12) AS articles FROM concepts GROUP BY lower(name)")
def _(t):
    rows = t.concepts.select("seq", "name", "label", (F.col("seq") % 12).alias("article"))
    return rules.merged_concepts(rows).withColumn("articles", F.array_join("articles", ","))


CONCEPTS = r"""c AS (SELECT doc_id AS seq, lang AS kind, regexp_extract(text, '^[^\x20\x09-\x0D]*') AS name, string_split(text, chr(10))[1] AS label, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS definition, doc_id % 15 AS article FROM documents),
r AS (SELECT *, list_filter([CASE WHEN article > 12 THEN 'unknown_article' END, CASE WHEN NOT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_-]*') THEN 'bad_name' END, CASE WHEN trim(label) = '' THEN 'no_label' END,
 CASE WHEN length(label) > 150 THEN 'long_label' END, CASE WHEN length(definition) = 0 THEN 'no_definition' END, CASE WHEN length(definition) BETWEEN 1 AND 19 THEN 'short_definition' END, CASE WHEN length(definition) > 600 THEN 'long_definition' END], lambda x: x IS NOT NULL) AS reasons FROM c),
f AS (SELECT *, CASE WHEN len(reasons) = 0 THEN min(seq) OVER (PARTITION BY len(reasons) = 0, kind, lower(label)) END AS first FROM r),
a AS (SELECT seq, array_to_string(reasons, ',') AS reasons, first, article, CASE WHEN first IS NULL THEN 'rejected' WHEN first = seq THEN 'accepted' ELSE 'repeated' END AS status FROM f)"""


def law_concepts(t):
    name = F.regexp_extract("text", "^[^\\x20\\x09-\\x0D]*", 0)
    definition = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))
    own = t.documents.select(F.col("doc_id").alias("seq"), F.col("lang").alias("kind"), name.alias("name"), F.get(F.split("text", "\n"), F.lit(0)).alias("label"), definition.alias("definition"), F.array((F.col("doc_id") % 15).cast("int")).alias("articles"))
    return rules.accepted(own, F.sequence(F.lit(0), F.lit(12)))


@query("e05_acceptance", f"WITH {CONCEPTS} SELECT seq, reasons FROM a")
def _(t):
    return law_concepts(t).select("seq", F.array_join("reasons", ",").alias("reasons"))


@query("e06_repeats", f"WITH {CONCEPTS} SELECT seq, first, status FROM a")
def _(t):
    return law_concepts(t).select("seq", "first", "status")


@query("e06_joined_repeats", f"WITH {CONCEPTS} SELECT first, count(*) AS n, string_agg(DISTINCT article, ',' ORDER BY article) AS articles FROM a WHERE first IS NOT NULL GROUP BY first")
def _(t):
    return rules.joined_repeats(law_concepts(t)).withColumn("articles", F.array_join("articles", ","))


@query("e07_answers", """
WITH c AS (SELECT family AS key, name, key AS term, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY seq) AS rank FROM concepts) WHERE rank <= 5),
n AS (SELECT key, lower(name) AS n, min(term) AS term FROM c GROUP BY ALL),
a AS (SELECT DISTINCT family AS key, CASE WHEN length(family) % 2 = 0 THEN '3' ELSE concat('dpv:', (SELECT name FROM c WHERE c.key = family AND rank = 2)) END AS choice, CASE WHEN length(family) % 2 = 0 THEN 'Alta' ELSE 'unknown' END AS conf FROM concepts)
SELECT a.key, coalesce(n.term, r.term) AS term, CASE WHEN conf = 'Alta' THEN 'high' ELSE 'low' END AS confidence, coalesce(n.term, r.term) IS NOT NULL AS valid
FROM a LEFT JOIN n ON n.key = a.key AND n.n = lower(replace(choice, 'dpv:', '')) LEFT JOIN c r ON r.key = a.key AND CAST(r.rank AS VARCHAR) = choice""")
def _(t):
    from pyspark.sql import Window

    c = t.concepts.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("seq"))).where("rank <= 5")
    c = c.select(F.col("family").alias("key"), "name", F.col("key").alias("term"), "rank")
    second = c.where("rank = 2").select("key", "name")
    even = F.length("key") % 2 == 0
    asked = t.concepts.select(F.col("family").alias("key")).distinct().join(second, "key", "left")
    asked = asked.select("key", F.when(even, "3").otherwise(F.concat(F.lit("dpv:"), "name")).alias("choice"), F.when(even, "Alta").otherwise("unknown").alias("confidence"))
    first = c.groupBy("key", F.lower("name").alias("name")).agg(F.min("term").alias("term")).withColumn("rank", F.lit(None).cast("int"))
    return rules.validated_answers(asked, first.unionByName(c.withColumn("name", F.lit(None).cast("string"))))


DECIDED = "d AS (SELECT key, confidence, score, predicted, toxic = 1 AS is_property, CASE WHEN key % 2 = 0 THEN 'exactMatch' ELSE 'relatedMatch' END AS relation, CASE WHEN key % 9 <> 0 THEN predicted END AS term, key % 9 = 0 AS none, key % 4 <> 1 AS answered FROM gold)"
ACCEPTS = "coalesce(confidence IN ('high', 'medium') AND score >= 0.3 AND NOT is_property AND relation = 'exactMatch', false)"


def decided(t):
    k = F.col("key")
    return t.gold.select("key", "confidence", "score", "predicted", (F.col("toxic") == 1).alias("is_property"), F.when(k % 2 == 0, "exactMatch").otherwise("relatedMatch").alias("relation"), F.when(k % 9 != 0, F.col("predicted")).alias("term"), (k % 9 == 0).alias("none"), (k % 4 != 1).alias("answered"))


def rule():
    return rules.rule_accepts(["high", "medium"], 0.3, ["exactMatch"], [])


@query("e08_fixed_rule", f"WITH {DECIDED} SELECT key FROM d WHERE {ACCEPTS}")
def _(t):
    return decided(t).where(rule()).select("key")


@query("e09_suggested", f"WITH {DECIDED} SELECT key FROM d WHERE confidence IN ('medium', 'low') AND term IS NOT NULL AND NOT {ACCEPTS}")
def _(t):
    own = decided(t)
    return rules.suggested(own, own.where(rule()), ["medium", "low"]).select("key")


ENTRIES = f"{DECIDED}, e AS (SELECT *, CASE WHEN {ACCEPTS} AND term IS NOT NULL THEN 'accepted' WHEN none AND confidence = 'high' THEN 'no_match' WHEN term IS NOT NULL AND answered THEN 'suggested' WHEN NOT answered AND score >= 0.6 AND NOT is_property THEN 'by_rule' ELSE 'undecided' END AS status FROM d)"


@query("e10_entries", f"WITH {ENTRIES} SELECT key, status FROM e")
def _(t):
    return rules.entries(decided(t), rule(), 0.6).select("key", "status")


@query("e11_threshold", "SELECT key, CASE WHEN score < 0.5 THEN 'below' WHEN toxic = 1 THEN 'rejected' ELSE 'proposed' END AS proposal FROM gold")
def _(t):
    return rules.threshold_rule(t.gold.withColumn("flag", F.col("toxic") == 1), 0.5).select("key", "proposal")


@query("e12_pending_items", "SELECT concept_key AS key, min(seq) AS first FROM decisions GROUP BY concept_key HAVING bool_or(relation IS NULL)")
def _(t):
    return rules.pending_items(t.decisions.select(F.col("concept_key").alias("key"), "relation", "seq"))


@query("e13_review_flags", "WITH v AS (SELECT key, CASE WHEN key % 10 = 0 THEN 'what' WHEN toxic = 1 THEN 'incoherent' WHEN quality = 0 THEN 'doubtful' ELSE 'coherent' END AS verdict FROM gold) SELECT key, verdict, verdict <> 'what' AS valid, verdict IN ('incoherent', 'doubtful') AS flagged FROM v")
def _(t):
    verdict = F.when(F.col("key") % 10 == 0, "what").when(F.col("toxic") == 1, "incoherent").when(F.col("quality") == 0, "doubtful").otherwise("coherent")
    return rules.review_flags(t.gold.select("key", verdict.alias("verdict")), ["coherent", "incoherent", "doubtful"])


@query("e14_clean_label", r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(concat('"', split_part(text, chr(10), 1), '"'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^["'']+|["'']+$', '', 'g'), '\.$', '') AS y FROM l)
SELECT doc_id, CASE WHEN y <> '' AND length(y) <= 150 THEN y END AS label FROM b""")
def _(t):
    line = F.concat(F.lit('"'), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('"'))
    return t.documents.select("doc_id", rules.clean_label(line).alias("label"))


@query("e15_definition_answers", "SELECT doc_id, CASE WHEN text = '' OR doc_id % 7 = 0 THEN 'none' WHEN doc_id % 10 > 6 OR length(text) > 600 THEN 'invalid' ELSE 'valid' END AS status FROM documents")
def _(t):
    own = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")).alias("definition"), (F.col("doc_id") % 10).cast("int").alias("article"))
    return own.select("doc_id", rules.definition_status(F.sequence(F.lit(0), F.lit(6))).alias("status"))


@query("e16_definition_gate", "SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE l.doc_id IS NULL) >= 0.1 * count(*) AS asked FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(t):
    return rules.definition_gate(t.documents.join(t.labels.select("doc_id", F.lit("x").alias("definition")), "doc_id", "left"))


@query("e17_doubts", f"""WITH {ENTRIES}, v AS (SELECT key, CASE WHEN toxic = 1 THEN 'incoherent' ELSE 'doubtful' END AS verdict FROM gold WHERE toxic = 1 OR quality = 0),
x AS (SELECT e.key, score, CASE WHEN status = 'accepted' AND verdict = 'incoherent' THEN 'incoherent' WHEN status = 'accepted' AND verdict IS NOT NULL THEN 'reviewed' WHEN status = 'suggested' THEN 'suggested' END AS cause FROM e LEFT JOIN v ON v.key = e.key WHERE e.key % 5 <> 0)
SELECT key, cause, CASE cause WHEN 'incoherent' THEN 0 WHEN 'reviewed' THEN 1 ELSE 2 END AS priority, score FROM x WHERE cause IS NOT NULL""")
def _(t):
    flagged = t.gold.where("toxic = 1 or quality = 0").select("key", F.when(F.col("toxic") == 1, "incoherent").otherwise("doubtful").alias("verdict"))
    return rules.doubts(rules.entries(decided(t), rule(), 0.6), flagged, t.gold.where("key % 5 = 0"))


@query("f01_sample", "SELECT key, term, n FROM (SELECT key, term, row_number() OVER (PARTITION BY term ORDER BY md5(concat('7|', key)), key) AS n FROM gold) WHERE n <= 10")
def _(t):
    return measure.stratified_sample(t.gold.select("key", "term"), "term", 10, "7")


@query("f02_confusion", "SELECT term AS gold, predicted, count(*) AS n FROM gold GROUP BY ALL")
def _(t):
    return measure.confusion(t.gold.select(F.col("term").alias("gold"), "predicted"))


def card(rows: str, groups: str = "") -> str:
    head = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    return f"""k AS (SELECT {head}count(*) AS n, count(*) FILTER (WHERE status = 'aligned') AS aligned, count(proposed) AS proposals, count(*) FILTER (WHERE status = 'aligned' AND proposed = term) AS correct,
 count(*) FILTER (WHERE status <> 'aligned' AND proposed IS NOT NULL) AS on_no_match FROM ({rows}){by}),
p AS (SELECT *, round(correct / nullif(proposals, 0), 4) AS precision, round(correct / nullif(aligned, 0), 4) AS coverage FROM k),
card AS (SELECT *, CASE WHEN precision > 0 AND coverage > 0 THEN round(2 * precision * coverage / (precision + coverage), 4) END AS f1 FROM p)"""


@query("f04_score_card", f"WITH {card("SELECT *, CASE WHEN score >= 0.4 THEN predicted END AS proposed FROM gold")} SELECT * FROM card")
def _(t):
    return measure.score_card(t.gold.withColumn("proposed", F.when(F.col("score") >= 0.4, F.col("predicted"))))


@query("f05_agreement", "SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS same, round(count(*) FILTER (WHERE quality = toxic) / count(*), 4) AS share FROM labels")
def _(t):
    return measure.agreement(t.labels, "quality", "toxic")


GOLD_PAIRS = "g AS (SELECT x.id, y.id AS t_id FROM items x JOIN items y ON x.label = y.label AND x.kind = y.kind AND x.id % 100 = 0 AND y.id <> x.id)"


def gold_pairs(t):
    s, targets = sides(t)
    return s.select("id", "label").join(targets.select(F.col("id").alias("t_id"), "label"), "label").where("id <> t_id").select("id", "t_id")


def right_among(t, lists):
    """What gold_pairs says of the listed pairs and of their sources."""
    return measure.right_among(lists, *[side.select("id", F.col("label").alias("class")) for side in sides(t)])


@query("f06_hits", f"{NEAR}, {GOLD_PAIRS}, b AS (SELECT g.id, min(rank) AS best FROM g LEFT JOIN n ON n.id = g.id AND n.t_id = g.t_id AND rank <= 10 GROUP BY g.id) SELECT count(*) AS n, count(*) FILTER (WHERE best <= 1) AS hit_1, count(*) FILTER (WHERE best <= 3) AS hit_3, count(*) FILTER (WHERE best <= 10) AS hit_10, count(*) FILTER (WHERE best IS NULL) AS missing FROM b")
def _(t):
    near = saved(matching.nearest(*sides(t), 10))
    return measure.hits(near, right_among(t, near))


THRESHOLDS = "SELECT g.*, round(0.1 * i, 1) AS threshold, CASE WHEN score >= round(0.1 * i, 1) THEN predicted END AS proposed FROM gold g, range(1, 10) r(i)"


def thresholds(t):
    return t.spark.range(1, 10).select(F.round(0.1 * F.col("id"), 1).alias("threshold"))


@query("f07_sweep", f"WITH {card(THRESHOLDS, 'threshold')} SELECT * REPLACE (CAST(threshold AS DOUBLE) AS threshold) FROM card")
def _(t):
    return measure.sweep(t.gold, thresholds(t))


@query("f08_choose_threshold", f"WITH {card(THRESHOLDS, 'threshold')} SELECT CAST(min(threshold) FILTER (WHERE precision >= 0.6 AND proposals >= 10) AS DOUBLE) AS threshold FROM card")
def _(t):
    return measure.choose_threshold(measure.sweep(t.gold, thresholds(t)), 0.6)


RULES_SQL = """rl AS (SELECT concat(l.name, '-', CAST(m.i AS VARCHAR)) AS rule, l.levels, len(l.levels) AS n_levels, CAST(round(0.2 * m.i, 1) AS DOUBLE) AS min_score
 FROM (VALUES ('h', ['high']), ('hm', ['high', 'medium']), ('hml', ['high', 'medium', 'low'])) l(name, levels), range(0, 4) m(i))"""


def rule_grid(t):
    levels = t.spark.createDataFrame([("h", ["high"]), ("hm", ["high", "medium"]), ("hml", ["high", "medium", "low"])], "name string, levels array<string>")
    grid = levels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return grid.select(F.concat_ws("-", "name", F.col("i").cast("string")).alias("rule"), "levels", F.size("levels").alias("n_levels"), F.round(0.2 * F.col("i"), 1).alias("min_score"))


TAKEN = "CASE WHEN list_contains(levels, confidence) AND score >= min_score THEN predicted END AS proposed"
GRID = card(f"SELECT gold.*, rule, n_levels, min_score, {TAKEN} FROM gold, rl", "rule, n_levels, min_score")


@query("f09_rule_table", f"WITH {RULES_SQL}, {GRID} SELECT * FROM card")
def _(t):
    return measure.rule_table(t.gold, rule_grid(t))


@query("f10_choose_rule", f"WITH {RULES_SQL}, {GRID} SELECT * FROM card WHERE precision >= 0.5 AND proposals >= 10 ORDER BY coverage DESC, n_levels, min_score DESC, precision DESC, rule LIMIT 1")
def _(t):
    return measure.choose_rule(measure.rule_table(t.gold, rule_grid(t)), 0.5, 10)


CV = card(f"SELECT gold.*, rep AS repeat, CASE WHEN substr(md5(concat_ws('|', rep, key)), 1, 1) < '8' THEN 0 ELSE 1 END AS half, rule, n_levels, min_score, {TAKEN} FROM gold, rl, range(0, 10) r(rep)", "repeat, half, rule, n_levels, min_score")
CHOSEN = f"{RULES_SQL}, {CV}, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repeat, half ORDER BY coverage DESC, n_levels, min_score DESC, precision DESC, rule) AS z FROM card WHERE precision >= 0.5 AND proposals >= 10) WHERE z = 1), cv AS (SELECT ch.repeat, ch.half, ch.rule, o.precision, o.coverage FROM ch JOIN card o ON o.repeat = ch.repeat AND o.half = 1 - ch.half AND o.rule = ch.rule)"


def validated(t):
    return measure.cross_validated(t.gold, rule_grid(t), t.spark.range(10).select(F.col("id").alias("repeat")), 0.5, 10)


@query("f11_cross_validate", f"WITH {CHOSEN} SELECT * FROM cv")
def _(t):
    return validated(t)


@query("f11_summary", f"WITH {CHOSEN} SELECT count(*) AS n, (2 * sum(CAST(precision * 10000 AS BIGINT)) + count(*)) // (2 * count(*)) / 10000.0 AS mean, quantile_disc(precision, 0.1) AS p10, quantile_disc(precision, 0.9) AS p90, (2 * sum(CAST(coverage * 10000 AS BIGINT)) + count(*)) // (2 * count(*)) / 10000.0 AS coverage FROM cv")
def _(t):
    return measure.validation_summary(validated(t))


@query("f12_evidence_grid", f"""{NEAR}, {GOLD_PAIRS}, gr AS (SELECT k, CAST(d AS DOUBLE) AS max_distance FROM (VALUES (1), (3), (5)) a(k), (VALUES (0.7), (0.8), (1.0)) b(d)),
h AS (SELECT n.*, g.id IS NOT NULL AS ok FROM n LEFT JOIN g ON g.id = n.id AND g.t_id = n.t_id WHERE rank <= 5)
SELECT k, max_distance, count(*) AS links, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 4) AS precision, count(DISTINCT id) FILTER (WHERE ok) AS covered,
 round(count(DISTINCT id) FILTER (WHERE ok) / (SELECT count(DISTINCT id) FROM g), 4) AS coverage FROM h JOIN gr ON rank <= k AND distance <= max_distance GROUP BY k, max_distance""")
def _(t):
    grid = t.spark.createDataFrame([(k, d) for k in (1, 3, 5) for d in (0.7, 0.8, 1.0)], "k int, max_distance double")
    return measure.evidence_grid(matching.nearest(*sides(t), 5), gold_pairs(t), grid)


@query("f13_halves", """WITH s AS (SELECT status, toxic, count(*) AS size FROM gold GROUP BY ALL), c AS (SELECT status, toxic, size // 2 + size % 2 * (sum(size % 2) OVER (ORDER BY status, toxic) % 2) AS cut FROM s)
SELECT key, g.status, g.toxic, CASE WHEN row_number() OVER (PARTITION BY g.status, g.toxic ORDER BY md5(concat('3|', key)), key) <= cut THEN 0 ELSE 1 END AS half FROM gold g JOIN c ON c.status = g.status AND c.toxic = g.toxic""")
def _(t):
    return measure.halves(t.gold, ["status", "toxic"], "3")


@query("f14_error_classes", f"""WITH d AS (SELECT *, CASE WHEN key % 9 <> 0 THEN predicted END AS proposed, score > 0.4 AS accepted, key % 10 <> 3 AS answered FROM gold)
SELECT CASE WHEN NOT answered THEN 'invalid' WHEN proposed IS NULL AND status = 'aligned' THEN 'none_wrong' WHEN proposed IS NULL THEN 'none_right' WHEN status <> 'aligned' THEN 'term_on_none' WHEN proposed <> term AND accepted THEN 'accepted_wrong'
 WHEN proposed <> term THEN 'other_term' WHEN accepted THEN 'right' ELSE 'right_not_accepted' END AS class, count(*) AS n FROM d GROUP BY 1""")
def _(t):
    k = F.col("key")
    rows = t.gold.withColumns({"proposed": F.when(k % 9 != 0, F.col("predicted")), "accepted": F.col("score") > 0.4, "answered": k % 10 != 3})
    return rows.groupBy(measure.error_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_flag_value", """
WITH k AS (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE predicted = term) AS correct, count(*) FILTER (WHERE predicted <> term AND toxic = 1) AS caught, count(*) FILTER (WHERE predicted = term AND toxic = 1) AS lost, count(*) FILTER (WHERE toxic <> 1) AS "left" FROM gold GROUP BY confidence),
r AS (SELECT *, round(correct / n, 4) AS before, round((correct - lost) / nullif("left", 0), 4) AS after FROM k) SELECT *, coalesce(after - before >= 0.05 AND lost <= 0.1 * correct, false) AS adopted FROM r""")
def _(t):
    rows = t.gold.select("confidence", F.col("predicted").alias("proposed"), "term", (F.col("toxic") == 1).alias("flag"))
    return measure.flag_value(rows, "confidence")
