"""Questions and their outcomes: elements, options, catalogues, statuses, simulated reviewers, drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import rounded
from tessera.operators.measure import ratio
from tessera.operators.provenance import single_reasons


def over_sets(sets: dict[str, DataFrame], queries: dict) -> DataFrame:
    """set_id, qid, n: every query on every dataset; queries take a graph and give rows."""
    parts = [q(g).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("set_id"), F.lit(i).alias("qid"), "n") for s, g in sets.items() for i, q in queries.items()]
    return reduce(DataFrame.unionByName, parts)


def elements_found(elements: DataFrame, answers: DataFrame) -> DataFrame:
    """qid, element, found: by its words as whole words of an answer, or by an article only it has.

    elements: qid, element, words, article; answers: qid, text, article. Joined on qid and the first word.
    """
    alone = elements.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("qid", "article")) == 1)
    words = answers.select("qid", F.explode(F.array_distinct(F.split("text", " "))).alias("w"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("hay"))
    by_word = alone.withColumn("w", F.substring_index("words", " ", 1)).join(words, ["qid", "w"]).where(F.contains(F.col("hay"), F.concat(F.lit(" "), "words", F.lit(" ")))).select("qid", "element")
    by_article = alone.where("own").join(answers.select("qid", "article").distinct(), ["qid", "article"]).select("qid", "element")
    hit = by_word.unionByName(by_article).distinct().withColumn("found", F.lit(True))
    return elements.select("qid", "element").distinct().join(hit, ["qid", "element"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def judged_elements(found: DataFrame) -> DataFrame:
    """qid, every, some."""
    return found.groupBy("qid").agg(F.bool_and("found").alias("every"), F.bool_or("found").alias("some"))


def status_summary(results: DataFrame) -> DataFrame:
    """green, yellow, grey, status: green only if all applicable results are."""
    of = lambda c: F.count_if(F.col("color") == c).alias(c)
    one = results.agg(of("green"), of("yellow"), of("grey"))
    return one.withColumn("status", F.when((F.col("yellow") == 0) & (F.col("grey") == 0), "green").when(F.col("grey") == 0, "yellow").otherwise("grey"))


def catalogue_problems(catalogue: DataFrame) -> DataFrame:
    """id, problem: ids that repeat, missing groups, missing criteria."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    problem = F.when(F.col("id").isNull(), "no id").when(n > 1, "id repeats").when(F.coalesce("grp", F.lit("")) == "", "no group").when(F.coalesce("criterion", F.lit("")) == "", "no criterion")
    return catalogue.withColumn("problem", problem).where("problem is not null").select("id", "problem").distinct()


def questions_with_options(doubts: DataFrame, options: DataFrame, state: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """key, part, options, status: one question per doubt in priority order, with those of its options that can be made.

    doubts: key, kind, part, priority, score; options: key, rank, dpv_iri, relation, replaces. An option is tested by itself
    against the state, as change requests are. Without one left a doubt is `no option` and takes no place among those asked;
    beyond the limit, what one session asks of a part, it is `over limit`. All doubts are returned.
    """
    asked = options.join(doubts.select("key", "kind"), "key").withColumnRenamed("key", "concept_key")
    fit = single_reasons(asked, state, terms).where("reason is null")
    term = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dpv_iri"))), lambda x: x["dpv_iri"])
    listed = fit.groupBy(F.col("concept_key").alias("key")).agg(F.array_join(term, ",").alias("options"))
    whole = doubts.join(listed, "key", "left")
    turn = F.row_number().over(Window.partitionBy("part", F.col("options").isNull()).orderBy("priority", F.desc("score"), "key"))
    return whole.select("key", "part", "options", F.when(F.col("options").isNull(), "no option").when(turn > limit, "over limit").otherwise("asked").alias("status"))


def citations_valid(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """key, valid: every cited row id was shown."""
    known = shown.select("key", "row_id").distinct().withColumn("there", F.lit(True))
    return answers.select("key", F.explode_outer("cited").alias("row_id")).join(known, ["key", "row_id"], "left").groupBy("key").agg(F.bool_and(F.col("row_id").isNull() | F.coalesce("there", F.lit(False))).alias("valid"))


def simulated_reviewer(options: DataFrame) -> DataFrame:
    """question, option, value: the option of greatest summed value, the recommended one unless another is better."""
    summed = options.groupBy("question", "option", "recommended").agg(F.sum("value").alias("value"))
    best = summed.groupBy("question").agg(F.max_by(F.struct("option", "value"), F.struct("value", "recommended", "option")).alias("x"))
    return best.select("question", "x.option", "x.value")


def known_answers(known: DataFrame, entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """key, method, verdict of concepts solved again: hit, wrong, lost (by threshold, rank, answer), abstain_ok.

    known: key, method, term (null: none); entries: key, term, score; ranks: key, rank of the known term.
    """
    both = known.withColumnRenamed("term", "right").join(entries.select("key", "term", "score"), "key", "left").join(ranks, "key", "left")
    verdict = (
        F.when(F.col("right").isNull() & F.col("term").isNull(), "abstain_ok").when(F.col("term") == F.col("right"), "hit").when(F.col("term").isNotNull(), "wrong")
        .when(F.col("rank").isNull(), "lost_by_rank").when(F.col("score") < 0.5, "lost_by_threshold").otherwise("lost_by_answer")
    )
    return both.select("key", "method", verdict.alias("verdict"))


def known_summary(verdicts: DataFrame) -> DataFrame:
    """method (null: all), n, hits, share, for every method and overall."""
    return verdicts.groupingSets([["method"], []], "method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "hit").alias("hits")).withColumn("share", ratio(F.col("hits"), F.col("n")))


def draft_outcomes(reference: DataFrame, draft: DataFrame, catalogue: DataFrame) -> DataFrame:
    """grp, same, other, none per group and in all (grp null): drafts that give the reference's rows. Rows: qid, row_key."""
    digest = lambda df, name: df.groupBy("qid").agg(F.sum(F.xxhash64("row_key").cast("decimal(38,0)")).alias(f"{name}_sum"), F.count_distinct("row_key").alias(f"{name}_n"))
    both = catalogue.join(digest(reference.distinct(), "r"), "qid", "left").join(digest(draft.distinct(), "d"), "qid", "left")
    state = F.when(F.col("d_n").isNull(), "none").when(F.col("r_sum").eqNullSafe(F.col("d_sum")) & F.col("r_n").eqNullSafe(F.col("d_n")), "same").otherwise("other")
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return both.withColumn("state", state).groupingSets([["grp"], []], "grp").agg(of("same"), of("other"), of("none"))


def explanation_right(results: DataFrame, reference: DataFrame) -> DataFrame:
    """qid, right: every missing element's words are named. results: qid, text; reference: qid, word."""
    both = reference.join(results, "qid", "left")
    return both.groupBy("qid").agg(F.bool_and(F.coalesce(F.contains(F.lower("text"), F.lower("word")), F.lit(False))).alias("right"))


def weight_sweep(pairs: DataFrame, weights: DataFrame, gold: DataFrame) -> DataFrame:
    """w, hit_1, hit_3: hits of the hybrid ranking for each lexical weight (a fixed grid of a few rows). pairs: all, or those that hold each weight's three best."""
    scored = pairs.join(F.broadcast(weights)).withColumn("s", rounded(F.col("w") * F.col("lexical") + (1 - F.col("w")) * F.col("semantic"), 4))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("w", "id").orderBy(F.desc("s"), F.desc("lexical"), "t_id"))).where("rank <= 3")
    best = ranked.join(gold, ["id", "t_id"], "left_semi").groupBy("w", "id").agg(F.min("rank").alias("rank"))
    return best.groupBy("w").agg(F.count_if(F.col("rank") == 1).alias("hit_1"), F.count(F.lit(1)).alias("hit_3"))
