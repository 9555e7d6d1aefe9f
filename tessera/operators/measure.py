"""Precision, coverage, grids, cross-validation. Ratios have four digits and are null where the denominator is 0.

Random orders are by md5 of a seed and the key: the same in every run and engine. Grids of rules are sums over one histogram of the
rows by level and score step, so the shuffled rows don't grow with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 4)


def shuffled(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def stratified_sample(rows: DataFrame, stratum: str, size: int, seed: str) -> DataFrame:
    """`size` rows of each stratum in random order; n is the place. A sampling operator: its limit is its purpose."""
    order = Window.partitionBy(stratum).orderBy(shuffled(seed, F.col("key")), "key")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)


def hits(lists: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """n, hit_<k>, missing: sources whose right target is among the first k. lists: id, t_id, rank; gold: id, t_id."""
    rank = gold.join(lists, ["id", "t_id"], "left").groupBy("id").agg(F.min("rank").alias("best"))
    return rank.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("best") <= k).alias(f"hit_{k}") for k in at], F.count_if(F.col("best").isNull()).alias("missing"))


def right_among(lists: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """id, t_id: the right ones among the listed, and for each source that has any right target, listed or not, a row without a target.

    Right is every other row of a source's class. As gold of lists this says what all pairs of a class would, which grow with the square
    of its rows and are not made. lists: id, t_id; sources, targets: id, class.
    """
    listed = lists.select("id", "t_id").distinct().join(sources.select("id", F.col("class").alias("own")), "id").join(targets.select(F.col("id").alias("t_id"), "class"), "t_id")
    right = listed.where("own = class and id <> t_id").select("id", "t_id").distinct()
    ends = targets.groupBy("class").agg(F.min("id").alias("least"), F.max("id").alias("greatest"))
    some = sources.join(ends, "class").where("least <> id or greatest <> id").select("id", F.lit(None).cast(right.schema["t_id"].dataType).alias("t_id")).distinct()
    return right.unionByName(some)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def tallied(proposed: Column) -> list[Column]:
    """The counts of a score card over rows of status, term, predicted; proposed: does the row's proposal count?"""
    aligned = F.col("status") == "aligned"
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(aligned).alias("aligned"), F.count_if(proposed).alias("proposals"),
        F.count_if(proposed & aligned & (F.col("predicted") == F.col("term"))).alias("correct"), F.count_if(proposed & ~aligned).alias("on_no_match"),
    ]


def with_ratios(counts: DataFrame) -> DataFrame:
    """Counts with precision, coverage, f1."""
    one = counts.withColumns({"precision": ratio(F.col("correct"), F.col("proposals")), "coverage": ratio(F.col("correct"), F.col("aligned"))})
    good = (F.col("precision") > 0) & (F.col("coverage") > 0)
    return one.withColumn("f1", F.when(good, F.round(2 * F.col("precision") * F.col("coverage") / (F.col("precision") + F.col("coverage")), 4)))


def score_card(rows: DataFrame, *groups: str) -> DataFrame:
    """Per group: n, proposals, correct, on_no_match, precision, coverage, f1. rows: status, term, proposed (null: none)."""
    return with_ratios(rows.withColumn("predicted", F.col("proposed")).groupBy(*groups).agg(*tallied(F.col("proposed").isNotNull())))


def histogram(rows: DataFrame, steps: DataFrame, *groups: str) -> DataFrame:
    """groups, confidence, step and the counts of the rows there: step is the number of thresholds that the score reaches.

    steps: one row with the sorted array `edges`. All rules of a grid are sums over this table, which is as large as the grid and
    the groups, not as the rows.
    """
    reached = F.size(F.filter("edges", lambda e: F.coalesce(F.col("score") >= e, F.lit(False))))
    own = rows.join(F.broadcast(steps)).withColumn("step", reached)  # one row
    return own.groupBy(*groups, "confidence", "step").agg(*tallied(F.col("predicted").isNotNull()))


COUNTS = ("n", "aligned", "proposals", "correct", "on_no_match")


def from_histogram(counts: DataFrame, rules: DataFrame, *groups: str) -> DataFrame:
    """The score card for each rule and group out of a histogram. rules: rule, levels (null: all), n_levels, min_score, at (the edge's place from 1)."""
    both = counts.join(F.broadcast(rules))  # the grid: a fixed number of rules
    in_rule = (F.col("step") >= F.col("at")) & F.coalesce(F.array_contains("levels", F.col("confidence")), F.col("levels").isNull())
    some = {c: F.sum(F.when(in_rule, F.col(c)).otherwise(0)) for c in ("proposals", "correct", "on_no_match")} | {c: F.sum(c) for c in ("n", "aligned")}
    one = both.groupBy(*groups, "rule", "n_levels", "min_score").agg(*[some[c].alias(c) for c in COUNTS])
    return with_ratios(one)


def edges_of(rules: DataFrame) -> DataFrame:
    return rules.agg(F.sort_array(F.collect_set("min_score")).alias("edges"))


def at_edges(rules: DataFrame, steps: DataFrame) -> DataFrame:
    return rules.join(F.broadcast(steps)).withColumn("at", F.array_position("edges", F.col("min_score")).cast("int")).drop("edges")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    one = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    return one.withColumn("share", ratio(F.col("same"), F.col("n")))


def sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The score card for each threshold: a proposal counts from the threshold on. Out of one histogram of the scores."""
    rules = thresholds.select(F.col("threshold").cast("string").alias("rule"), F.lit(None).cast("array<string>").alias("levels"), F.lit(0).alias("n_levels"), F.col("threshold").alias("min_score"))
    steps = edges_of(rules)
    counts = histogram(rows.withColumn("confidence", F.lit(None).cast("string")), steps)
    return from_histogram(counts, at_edges(rules, steps)).drop("rule", "n_levels").withColumnRenamed("min_score", "threshold")


def choose_threshold(table: DataFrame, min_precision: float, min_proposals: int = 10) -> DataFrame:
    fit = (F.col("precision") >= min_precision) & (F.col("proposals") >= min_proposals)
    return table.agg(F.min(F.when(fit, F.col("threshold"))).alias("threshold"))


def rule_table(rows: DataFrame, rules: DataFrame, *groups: str) -> DataFrame:
    """The score card for each rule (rule, levels, n_levels, min_score), out of one histogram by group, level and score step."""
    steps = edges_of(rules)
    return from_histogram(histogram(rows, steps, *groups), at_edges(rules, steps), *groups)


def choose_rule(table: DataFrame, min_precision: float, min_proposals: int, *groups: str) -> DataFrame:
    """Per group the rule of highest coverage that meets the floor; ties: fewer levels, higher score, precision, first."""
    fit = table.where((F.col("precision") >= min_precision) & (F.col("proposals") >= min_proposals))
    order = [F.desc("coverage"), "n_levels", F.desc("min_score"), F.desc("precision"), "rule"]
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    return fit.withColumn("k", F.row_number().over(part.orderBy(*order))).where("k = 1").drop("k")


def cross_validated(rows: DataFrame, rules: DataFrame, repeats: DataFrame, min_precision: float, min_proposals: int) -> DataFrame:
    """repeat, half, rule, precision, coverage: the rule chosen on one random half, measured on the other, both ways."""
    split = rows.join(F.broadcast(repeats))  # repeats: a few rows
    half = F.when(F.substring(F.md5(F.concat_ws("|", F.col("repeat").cast("string"), F.col("key").cast("string"))), 1, 1) < "8", 0).otherwise(1)
    tables = rule_table(split.withColumn("half", half), rules, "repeat", "half")
    chosen = choose_rule(tables, min_precision, min_proposals, "repeat", "half").select("repeat", "half", "rule")
    other = tables.select("repeat", (1 - F.col("half")).alias("half"), "rule", "precision", "coverage")
    return chosen.join(other, ["repeat", "half", "rule"])


def validation_summary(found: DataFrame) -> DataFrame:
    """n, mean, p10 and p90 of the precision (nearest rank), the most chosen rule."""
    mean = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,4)")) / F.count(c), 4).cast("double")  # noqa: E731  in decimals: the same in any order
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY precision)")
    return found.agg(F.count(F.lit(1)).alias("n"), mean("precision").alias("mean"), rank(0.1).alias("p10"), rank(0.9).alias("p90"), mean("coverage").alias("coverage"))


def evidence_grid(near: DataFrame, gold: DataFrame, grid: DataFrame) -> DataFrame:
    """k, max_distance, links, correct, precision, covered, coverage. near: id, t_id, rank, distance; gold: id, t_id."""
    right = near.join(gold.withColumn("right", F.lit(1)), ["id", "t_id"], "left")
    at = right.join(F.broadcast(grid), (F.col("rank") <= F.col("k")) & (F.col("distance") <= F.col("max_distance")))  # a fixed grid
    one = at.groupBy("k", "max_distance").agg(F.count(F.lit(1)).alias("links"), F.count("right").alias("correct"), F.count_distinct(F.when(F.col("right") == 1, F.col("id"))).alias("covered"))
    total = gold.agg(F.count_distinct("id").alias("total"))
    return one.join(F.broadcast(total)).select("k", "max_distance", "links", "correct", ratio(F.col("correct"), F.col("links")).alias("precision"), "covered", ratio(F.col("covered"), F.col("total")).alias("coverage"))


def halves(rows: DataFrame, strata: list[str], seed: str) -> DataFrame:
    """key, half: two halves of equal mix in each stratum; of the strata of odd size, in order, each other one gives half 0 the row more.

    The place of a row among its stratum's is that among the rows of the same first two hash digits, after the counts of the
    digits before: no stratum is sorted in one task.
    """
    order = shuffled(seed, F.col("key"))
    placed = rows.select("key", *strata, order.alias("order"), F.substring(order, 1, 2).alias("part"))
    parts = placed.groupBy(*strata, "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(*[F.col(c).alias(f"b_{c}") for c in strata], F.col("part").alias("b_part"), (F.sum("n").over(Window.partitionBy(*strata).orderBy("part")) - F.col("n")).alias("before"))
    sizes = parts.groupBy(*strata).agg(F.sum("n").alias("size"))
    odd = F.sum(F.col("size") % 2).over(Window.orderBy(*[F.asc_nulls_first(c) for c in strata]))  # one row a stratum
    cuts = sizes.select(*[F.col(c).alias(f"c_{c}") for c in strata], (F.floor(F.col("size") / 2) + (F.col("size") % 2) * (odd % 2)).alias("cut"))
    same = lambda mark: [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in strata]
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy(*strata, "part").orderBy("order", "key")))
    whole = ranked.join(before, [F.col("part") == F.col("b_part"), *same("b")]).join(cuts, same("c"))
    return whole.select("key", *strata, F.when(F.col("k") + F.col("before") <= F.col("cut"), 0).otherwise(1).alias("half"))


def error_class() -> Column:
    """Of status, term, proposed, accepted, answered."""
    aligned, term = F.col("status") == "aligned", F.col("proposed").isNotNull()
    right = aligned & (F.col("proposed") == F.col("term"))
    return (
        F.when(~F.col("answered"), "invalid").when(~term & aligned, "none_wrong").when(~term, "none_right").when(~aligned, "term_on_none").when(~right & F.col("accepted"), "accepted_wrong")
        .when(~right, "other_term").when(F.col("accepted"), "right").otherwise("right_not_accepted")
    )


def flag_value(rows: DataFrame, by: str) -> DataFrame:
    """Effect of dropping flagged proposals: caught, lost, precision before and after, adopted."""
    right = F.col("proposed") == F.col("term")
    one = rows.where("proposed is not null").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.count_if(~right & F.col("flag")).alias("caught"), F.count_if(right & F.col("flag")).alias("lost"), F.count_if(~F.col("flag")).alias("left")
    )
    one = one.withColumns({"before": ratio(F.col("correct"), F.col("n")), "after": ratio(F.col("correct") - F.col("lost"), F.col("left"))})
    return one.withColumn("adopted", F.coalesce((F.col("after") - F.col("before") >= 0.05) & (F.col("lost") <= 0.1 * F.col("correct")), F.lit(False)))


def verdicts(current: DataFrame, candidate: DataFrame, min_precision: float, min_gain: float) -> DataFrame:
    """half, adopted: the candidate meets the precision floor and gains enough F1. Both: half, precision, f1."""
    new = candidate.select("half", F.col("precision").alias("p"), F.col("f1").alias("f"))
    return current.join(new, "half").select("half", F.coalesce((F.col("p") >= min_precision) & (F.col("f") - F.col("f1") >= min_gain), F.lit(False)).alias("adopted"))
