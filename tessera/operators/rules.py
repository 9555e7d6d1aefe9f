"""Rules over answers: parsing, acceptance, the fixed decision rule, entries and doubts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = "^[A-Za-z][A-Za-z0-9_-]*$"
LABEL_MAX, DEFINITION_MIN, DEFINITION_MAX = 150, 20, 600
CONFIDENCE = {"alta": "high", "high": "high", "media": "medium", "medium": "medium", "baja": "low", "low": "low"}


def json_text(raw: Column) -> Column:
    """The object in an answer that may be fenced or have text around it; '' if there is none."""
    return F.regexp_extract(F.regexp_replace(raw, "```(json)?", ""), "(?s)\\{.*\\}", 0)


def parsed_lines(answers: DataFrame, schema: str) -> DataFrame:
    """key, line, the fields of schema, bad: the objects of JSON-lines answers; a damaged line is kept as bad."""
    lines = answers.select("key", F.posexplode(F.split("raw", "\n")).alias("line", "text")).where(F.btrim("text") != "")
    read = lines.withColumn("x", F.from_json(json_text(F.col("text")), schema))
    bad = F.col("x").isNull() | (json_text(F.col("text")) == "")
    return read.select("key", "line", "x.*", bad.alias("bad"))


def article_number(value: Column) -> Column:
    """First whole number in a value, null if it has none."""
    return F.when(value.rlike("[0-9]"), F.regexp_extract(value, "[0-9]+", 0).try_cast("int"))


def merged_concepts(rows: DataFrame) -> DataFrame:
    """name, label, articles: rows of the same name in lower case as one, the first row's texts, all articles in order."""
    one = rows.groupBy(F.lower("name").alias("folded")).agg(
        F.min_by(F.struct("name", "label"), "seq").alias("x"), F.array_sort(F.collect_set("article")).alias("articles")
    )
    return one.select("x.name", "x.label", "articles")


def acceptance_reasons(law_articles: Column | None = None) -> Column:
    """Codes of everything that is wrong with a concept (name, label, definition, articles)."""
    known = F.size(F.array_except("articles", law_articles)) > 0 if law_articles is not None else F.lit(False)
    size = F.char_length(F.coalesce("definition", F.lit("")))
    checks = [
        (F.size(F.coalesce("articles", F.array().cast("array<int>"))) == 0, "no_article"), (known, "unknown_article"), (~F.col("name").rlike(NAME), "bad_name"),
        (F.btrim(F.coalesce("label", F.lit(""))) == "", "no_label"), (F.char_length("label") > LABEL_MAX, "long_label"),
        (size == 0, "no_definition"), ((size > 0) & (size < DEFINITION_MIN), "short_definition"), (size > DEFINITION_MAX, "long_definition"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for bad, code in checks]), lambda x: x.isNotNull())


def accepted(concepts: DataFrame, law_articles: Column | None = None) -> DataFrame:
    """seq, status, reasons, first: accepted, rejected, or repeated (of the first accepted one of its kind and label)."""
    checked = concepts.withColumn("reasons", acceptance_reasons(law_articles)).withColumn("good", F.size("reasons") == 0)
    key = Window.partitionBy("good", "kind", F.lower("label"))
    first = F.when(F.col("good"), F.min("seq").over(key))
    status = F.when(~F.col("good"), "rejected").when(first == F.col("seq"), "accepted").otherwise("repeated")
    return checked.select("seq", "kind", "label", "articles", "reasons", first.alias("first"), status.alias("status"))


def joined_repeats(found: DataFrame) -> DataFrame:
    """first, n, articles: accepted concepts with the articles of their repeats."""
    return found.where("first is not null").groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("articles")))).alias("articles"))


def validated_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, term, confidence, valid: the chosen term by name (prefix and case ignored) or by its number in the list."""
    chosen = F.lower(F.regexp_replace("choice", "^[a-z]+:", ""))
    names = candidates.select(F.col("key").alias("n_key"), F.lower("name").alias("n_name"), F.col("term").alias("by_name"))
    ranks = candidates.select(F.col("key").alias("r_key"), F.col("rank").cast("string").alias("n_rank"), F.col("term").alias("by_rank"))
    both = answers.withColumn("chosen", chosen).join(names, (F.col("key") == F.col("n_key")) & (F.col("chosen") == F.col("n_name")), "left")
    both = both.join(ranks, (F.col("key") == F.col("r_key")) & (F.col("chosen") == F.col("n_rank")), "left")
    term = F.coalesce("by_name", "by_rank")
    level = F.coalesce(*[F.when(F.lower("confidence") == a, b) for a, b in CONFIDENCE.items()], F.lit("low"))
    return both.select("key", term.alias("term"), level.alias("confidence"), (term.isNotNull() | (F.col("chosen") == "none")).alias("valid"))


def rule_accepts(accept: list[str], min_score: float, relations: list[str] | None = None, property_relations: list[str] | None = None) -> Column:
    """The fixed rule over confidence, score, relation, is_property. None: any relation; []: never."""

    def allowed(names: list[str] | None) -> Column:
        return F.lit(True) if names is None else (F.coalesce(F.col("relation").isin(names), F.lit(False)) if names else F.lit(False))

    relation = F.when(F.col("is_property"), allowed(property_relations)).otherwise(allowed(relations))
    return F.coalesce(F.col("confidence").isin(accept) & (F.col("score") >= min_score) & relation, F.lit(False))


def suggested(decided: DataFrame, automatic: DataFrame, levels: list[str]) -> DataFrame:
    return decided.where(F.col("confidence").isin(levels) & F.col("term").isNotNull()).join(automatic.select("key"), "key", "left_anti")


def entries(decided: DataFrame, accepts: Column, threshold: float) -> DataFrame:
    """key, status: accepted, no_match, suggested, by_rule (no answer, best candidate from the threshold on), undecided."""
    status = (
        F.when(accepts & F.col("term").isNotNull(), "accepted").when(F.col("none") & (F.col("confidence") == "high"), "no_match").when(F.col("term").isNotNull() & F.col("answered"), "suggested")
        .when(~F.col("answered") & (F.col("score") >= threshold) & ~F.col("is_property"), "by_rule").otherwise("undecided")
    )
    return decided.withColumn("status", status)


def threshold_rule(best: DataFrame, threshold: float) -> DataFrame:
    """Rank-1 rows: below, rejected by the reviewer, or proposed."""
    state = F.when(F.col("score") < threshold, "below").when(F.col("flag"), "rejected").otherwise("proposed")
    return best.withColumn("proposal", state)


def pending_items(rows: DataFrame) -> DataFrame:
    """key, first: concepts with a row that has no relation yet, by their first row."""
    return rows.groupBy("key").agg(F.bool_or(F.col("relation").isNull()).alias("open"), F.min("seq").alias("first")).where("open").select("key", "first")


def review_flags(reviews: DataFrame, verdicts: list[str]) -> DataFrame:
    """verdict outside the list is invalid; incoherent and doubtful are flagged."""
    valid = F.coalesce(F.col("verdict").isin(verdicts), F.lit(False))
    return reviews.withColumns({"valid": valid, "flagged": valid & F.col("verdict").isin("incoherent", "doubtful")})


def clean_label(value: Column) -> Column:
    """One line without quotes and final period, at most LABEL_MAX characters; else null."""
    line = F.btrim(F.regexp_replace(value, "[\\x20\\x09-\\x0D]+", " "))
    bare = F.regexp_replace(F.regexp_replace(line, "^[\"']+|[\"']+$", ""), "\\.$", "")
    return F.when((bare != "") & (F.char_length(bare) <= LABEL_MAX), bare)


def definition_status(shown: Column) -> Column:
    """none (empty), invalid (article not among the shown, or too long), else valid."""
    return F.when(F.coalesce("definition", F.lit("")) == "", "none").when(~F.array_contains(shown, F.col("article")) | (F.char_length("definition") > DEFINITION_MAX), "invalid").otherwise("valid")


def definition_gate(concepts: DataFrame, share: float = 0.1) -> DataFrame:
    """n, missing, asked: definitions are asked for only if this share or more is missing."""
    one = concepts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("definition").isNull()).alias("missing"))
    return one.withColumn("asked", F.col("missing") >= share * F.col("n"))


def doubts(found: DataFrame, flagged: DataFrame, decided: DataFrame) -> DataFrame:
    """key, cause, priority: suggested entries, and accepted ones with a flag, less those already decided."""
    own = found.join(flagged.select("key", "verdict"), "key", "left").join(decided.select("key"), "key", "left_anti")
    cause = F.when((F.col("status") == "accepted") & (F.col("verdict") == "incoherent"), "incoherent").when((F.col("status") == "accepted") & F.col("verdict").isNotNull(), "reviewed").when(F.col("status") == "suggested", "suggested")
    rank = F.when(F.col("cause") == "incoherent", 0).when(F.col("cause") == "reviewed", 1).otherwise(2)
    return own.withColumn("cause", cause).where("cause is not null").select("key", "cause", rank.alias("priority"), "score")
