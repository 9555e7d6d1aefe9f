"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, conversations, decontaminate, html_text, line_dedup, merkle, pii, quality_model, quality_rules, secrets, simhash, suffix_dedup, vector_links
from tessera.llm.manifest_sql import manifest_sql

#: Name of the public vocabulary file for op6 and the last stage of the pipeline.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("w")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "w.n_words", F.round("w.similarity", 6).alias("similarity"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lowered()).drop("path")


def op12_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_model": op3_quality_model,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_secrets": op10_secrets,
    "op11_merkle": op11_merkle,
    "op12_vector_links": op12_vector_links,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": """
WITH ws AS (SELECT doc_id AS id, 0 AS kind, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL
            SELECT item_id, 1, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
g AS (SELECT id, kind, len(w) AS n,
             CASE WHEN len(w) < 5 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS sh FROM ws),
s AS (SELECT id, kind, unnest(sh) AS h, generate_subscripts(sh, 1) - 1 AS pos FROM g),
p AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM s d JOIN s b ON d.h = b.h AND d.kind = 0 AND b.kind = 1),
q AS (SELECT p.*, b.n, len(b.sh) AS total, least(len(b.sh), len(d.sh)) AS size, len(d.sh) AS ds FROM p
      JOIN g b ON b.kind = 1 AND b.id = item_id JOIN g d ON d.kind = 0 AND d.id = doc_id),
t AS (SELECT *, unnest(range(0, ds - size + 1)) AS start FROM q),
c AS (SELECT t.doc_id, t.item_id, t.start, any_value(t.n) AS n, any_value(t.total) AS total, any_value(t.size) AS size, s.h, count(*) AS c
      FROM t JOIN s ON s.kind = 0 AND s.id = t.doc_id AND s.pos BETWEEN t.start AND t.start + t.size - 1 GROUP BY ALL),
i AS (SELECT id AS item_id, h, count(*) AS ic FROM s WHERE kind = 1 GROUP BY ALL),
z AS (SELECT doc_id, item_id, start, any_value(n) AS n, sum(least(c, ic)) / (any_value(total) + any_value(size) - sum(least(c, ic))) AS sim
      FROM c JOIN i USING (item_id, h) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS k FROM z WHERE sim >= 0.8)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_words, round(sim, 6) AS similarity FROM r WHERE k = 1""",
    "op7_quality_rules": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
n AS (SELECT *, CASE WHEN len(ws) < 8 THEN CAST([] AS VARCHAR[])
                ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) END AS win FROM w),
u AS (SELECT doc_id, unnest(win) AS g, generate_subscripts(win, 1) AS i FROM n),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM r WHERE c > 1),
k AS (SELECT doc_id, sum(least(8, i - coalesce(b, i - 8))) AS n FROM p GROUP BY doc_id),
m AS (SELECT n.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words,
             len(regexp_extract_all(t, '[A-Z]')) AS caps, len(string_split(t, chr(10))) AS n_lines,
             len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter
      FROM n LEFT JOIN k USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * caps > word_chars OR (n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutter > 30 * n_words
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept FROM b""",
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM k),
g AS (SELECT *, length(key) >= 10 AND doc_id > first AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""",
    "op11_merkle": manifest_sql(),
    "op12_vector_links": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.label = y.label AND len(x.e) = len(y.e) AND x.r <> y.r AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
c AS (SELECT r, r AS m FROM v UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.m),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a),
g AS (SELECT c.r, min(vec_id) AS component_id FROM c JOIN v ON v.r = c.m GROUP BY c.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN g ON g.r = v.r LEFT JOIN n ON n.r = v.r""",
}
