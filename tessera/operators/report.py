"""Report tables and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS_ORDER = ["inherited", "accepted", "suggested", "no_match", "undecided"]


def concept_rows(inherited: DataFrame, decided: DataFrame, labels: DataFrame) -> DataFrame:
    """key, status, term, who, label of inherited and decided concepts. Both: key, status, term."""
    both = inherited.select("key", "status", "term", F.lit("base").alias("who")).unionByName(decided.select("key", "status", "term", F.lit("rule").alias("who")))
    return both.join(labels.select("key", "label"), "key", "left")


def summary(rows: DataFrame) -> DataFrame:
    """status, concepts, mappings: a concept counts under its first status in the report's order."""
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(STATUS_ORDER)], F.lit(len(STATUS_ORDER)))
    one = rows.groupBy("key").agg(F.min_by("status", rank).alias("status"), F.count("term").alias("mappings"))
    return one.groupBy("status").agg(F.count(F.lit(1)).alias("concepts"), F.sum("mappings").alias("mappings"))


def evidence_text(rows: DataFrame) -> DataFrame:
    """key, text: 'art. 17 (0,32); art. 4 (cited)' in rank order. rows: key, rank, article, distance (null: cited)."""
    note = F.when(F.col("distance").isNull(), "cited").otherwise(F.replace(F.format_number("distance", 2), F.lit("."), F.lit(",")))
    one = F.concat(F.lit("art. "), F.col("article").cast("string"), F.lit(" ("), note, F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("t"))))
    return rows.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "; ").alias("text"))


def filtered(rows: DataFrame, origin: str | None = None, kinds: list[str] | None = None, text: str | None = None, best_only: bool = False) -> DataFrame:
    if origin is not None:
        rows = rows.where(F.col("origin") == origin)
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds))
    if text:
        rows = rows.where(F.lower(F.concat_ws(" ", "name", "label", "definition")).contains(text.lower()))
    return rows.where("rank = 1") if best_only else rows


def first_evidence(rows: DataFrame) -> DataFrame:
    """The first row of each key that has a definition or an article."""
    order = Window.partitionBy("key").orderBy("seq")
    return rows.where("definition is not null or article is not null").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def module_structure(entities: DataFrame) -> DataFrame:
    """module, class, property (counts), families. entities: module, kind, family."""
    one = entities.groupBy("module").agg(F.count_if(F.col("kind") == "class").alias("class"), F.count_if(F.col("kind") == "property").alias("property"), F.sort_array(F.collect_set("family")).alias("f"))
    return one.select("module", "class", "property", F.array_join("f", ",").alias("families"))


def ranking_summary(candidates: DataFrame) -> DataFrame:
    """kind, n, mean of the best scores, in decimals: the same in whatever order they are added."""
    best = candidates.groupBy("id", "kind").agg(F.max("score").cast("decimal(18,4)").alias("best"))
    mean = F.round(F.sum("best") / F.count(F.lit(1)), 4).cast("double")
    return best.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"))


def readiness(statuses: DataFrame, reported: DataFrame) -> DataFrame:
    """pending, stale: is anything pending; does the report (status, n) differ from the present counts?"""
    now = statuses.groupBy("status").agg(F.count(F.lit(1)).alias("now"))
    both = now.join(reported, "status", "full")
    return both.agg(F.coalesce(F.max(F.when(F.col("status") == "pending", F.col("now"))), F.lit(0)).alias("pending"), F.bool_or(~F.col("now").eqNullSafe(F.col("n"))).alias("stale"))
