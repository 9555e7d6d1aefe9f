"""Hierarchies, closures and graph questions over edges (child, parent) and statements.

Fixpoints double the distance that they know with each round; rounds are written to the shared folder, so the plan stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import Rounds, saved

MATCHES = ["skos:exactMatch", "skos:closeMatch", "skos:broadMatch"]


class Steps:
    """An index of edges for reachability: relations of exactly 1, 2, 4, ... steps, each the join of the one before with itself.

    A relation is made when it is first asked for and written once. Any number of steps below 2 ** j is a sum of different powers, so
    what a set of roots reaches takes a join a power: rounds grow with the logarithm of the depth, and one set of roots
    serves any number of questions. On a hierarchy each power has at most a row for each node and way up.
    """

    def __init__(self, edges: DataFrame):
        self.powers = [saved(edges.select("child", "parent").distinct())]

    def power(self, j: int) -> DataFrame:
        while len(self.powers) <= j:
            last = self.powers[-1]
            up = last.select(F.col("child").alias("mid"), F.col("parent").alias("above"))
            self.powers.append(saved(last.join(up, F.col("parent") == F.col("mid")).select("child", F.col("above").alias("parent")).distinct()))
        return self.powers[j]

    def below(self, roots: DataFrame) -> DataFrame:
        """root, node: each root (node) and all below it. Ends when as many steps as all so far together lead to nothing new."""
        reached, j = saved(roots.select(F.col("node").alias("root"), "node").distinct()), 0
        while True:
            step = self.power(j)
            found = reached.join(step, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
            new = saved(found.join(reached, ["root", "node"], "left_anti"))
            if new.isEmpty():
                return reached
            reached, j = saved(reached.unionByName(new)), j + 1


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """child, parent: all pairs that one or more edges connect (with reflexive: and every node with itself); cycles end.

    By doubling: a round joins the newest pairs with all known ones, so pairs up to twice as far are known after it.
    """
    rounds = Rounds(edges.select("child", "parent").distinct())
    while not rounds.newest.isEmpty():
        known = rounds.known()
        far = known.select(F.col("child").alias("mid"), F.col("parent").alias("above"))
        newest = rounds.newest.select("child", F.col("parent").alias("reached"))
        found = newest.join(far, F.col("reached") == F.col("mid")).select("child", F.col("above").alias("parent")).distinct()
        rounds.add(found.join(known, ["child", "parent"], "left_anti"))
    known = rounds.known()
    if reflexive:
        nodes = edges.select(F.explode(F.array("child", "parent")).alias("child")).distinct()
        known = known.unionByName(nodes.select("child", F.col("child").alias("parent"))).distinct()
    return known


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots (node) and all below them, whatever root leads there."""
    reached, steps, j = saved(roots.select("node").distinct()), Steps(edges), 0
    while True:
        found = steps.power(j).join(reached, F.col("parent") == F.col("node")).select(F.col("child").alias("node")).distinct()
        new = saved(found.join(reached, "node", "left_anti"))
        if new.isEmpty():
            return reached
        reached, j = saved(reached.unionByName(new)), j + 1


def first_parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.min("parent").alias("parent"))


def ancestry(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """child, family, depth: up the first parents until a node of stops (node) or a root; depth counts the hops to the top.

    A walk that would come to a node it has been at (a cycle, entered from outside or not) ends there; a row carries its walk,
    which is as long as the hierarchy is deep.
    """
    up = first_parents(edges).select(F.col("child").alias("at"), F.col("parent").alias("above"))
    marks = stops.select(F.col("node").alias("mark"), F.lit(True).alias("stop"))
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("child")).distinct()
    walk = nodes.select("child", F.col("child").alias("at"), F.lit(None).cast("bigint").alias("family"), F.lit(0).alias("depth"), F.array("child").alias("been"))
    done = []
    while True:
        seen = walk.join(marks, F.col("at") == F.col("mark"), "left").withColumn("family", F.coalesce("family", F.when(F.col("stop"), F.col("at")))).drop("mark", "stop")
        stepped = saved(seen.join(up, "at", "left"))
        ends = F.col("above").isNull() | F.array_contains("been", F.coalesce("above", "at"))
        done.append(stepped.where(ends).select("child", "family", "depth"))
        walk = stepped.where(~ends).select("child", F.col("above").alias("at"), "family", (F.col("depth") + 1).alias("depth"), F.array_append("been", F.col("above")).alias("been"))
        if not walk.take(1):
            return reduce(DataFrame.unionByName, done)


def moved(references: DataFrame, modules: DataFrame, source: str = "core", target: str = "profile") -> DataFrame:
    """node, module after every node of source that reaches one of target has moved there. references: child, parent."""
    start = modules.where(F.col("module") == target).select("node")
    inner = references.join(modules.where(F.col("module") == source).select(F.col("node").alias("child")), "child", "left_semi")
    reached = descendants(inner, start).withColumn("reached", F.lit(True))
    return modules.join(reached, "node", "left").select("node", F.when(F.col("reached"), target).otherwise(F.col("module")).alias("module"))


def cross_references(references: DataFrame, modules: DataFrame, a: str = "core", b: str = "profile") -> DataFrame:
    """References from module a to module b."""
    left = modules.where(F.col("module") == a).select(F.col("node").alias("child"))
    right = modules.where(F.col("module") == b).select(F.col("node").alias("parent"))
    return references.join(left, "child", "left_semi").join(right, "parent", "left_semi").select("child", "parent")


def individuals_module(types: DataFrame, modules: DataFrame) -> DataFrame:
    """s, module: of its types' modules profile wins."""
    both = types.join(modules, types["o"] == modules["node"])
    return both.groupBy("s").agg(F.when(F.bool_or(F.col("module") == "profile"), "profile").otherwise("core").alias("module"))


def double_typed(graph: DataFrame) -> DataFrame:
    """s, kind: properties typed both ways become data if all their values are literals (or there are none), else object."""
    kinds = graph.where("p = 'rdf:type' and o in ('owl:ObjectProperty', 'owl:DatatypeProperty')").groupBy("s").agg(F.count_distinct("o").alias("n")).where("n = 2")
    uses = graph.groupBy(F.col("p").alias("s")).agg(F.bool_and(F.col("o_kind") == "literal").alias("literal"))
    return kinds.join(uses, "s", "left").select("s", F.when(F.coalesce("literal", F.lit(True)), "data").otherwise("object").alias("kind"))


def union_domains(graph: DataFrame, predicate: str) -> DataFrame:
    """s, node, members: subjects with several objects of the predicate, as one union node with a stable name."""
    own = graph.where(F.col("p") == predicate).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("m")).where(F.size("m") > 1)
    members = F.array_join("m", " ")
    return own.select("s", F.concat(F.lit("union-"), F.substring(F.sha2(members, 256), 1, 12)).alias("node"), members.alias("members"))


def bounded_description(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """All statements of the seeds (s) and of the blank nodes they lead to."""
    links = graph.where("o_kind = 'bnode'").select(F.col("o").alias("child"), F.col("s").alias("parent"))
    nodes = descendants(links, seeds.select(F.col("s").alias("node")))
    return graph.join(nodes, graph["s"] == nodes["node"], "left_semi")


def aligned(graph: DataFrame, vocabulary: str) -> DataFrame:
    """Concepts with a match to a term of the vocabulary that are not of it themselves."""
    match = graph.where(F.col("p").isin(MATCHES) & F.col("o").startswith(vocabulary) & ~F.col("s").startswith(vocabulary))
    return match.select("s").distinct()


def aligned_under(matches: DataFrame, steps: Steps, roots: DataFrame) -> DataFrame:
    """root, concept, term of the matches whose term is one of the roots (node) or below it; all roots in one run."""
    return matches.join(steps.below(roots), F.col("term") == F.col("node")).select("root", "concept", "term")


def citing(graph: DataFrame, text: str) -> DataFrame:
    return graph.where((F.col("o_kind") == "literal") & F.lower("o").contains(text.lower())).select("s", "o")


def answer_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A canonical key of each answer row: local names of IRIs, the text of literals."""
    from tessera.functions.text import local_name

    cells = [F.when(F.col(c).rlike("^https?://"), local_name(F.col(c))).otherwise(F.col(c)) for c in columns]
    return rows.withColumn("row_key", F.concat_ws(" ", *cells))


def judged_value(answers: DataFrame) -> DataFrame:
    """qid, green: is the expected number among the numbers of the answer's text?"""
    numbers = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    return answers.groupBy("qid").agg(F.bool_or(F.array_contains(numbers, F.col("expected"))).alias("green"))


def judged_count(answers: DataFrame, at_least: int) -> DataFrame:
    return answers.groupBy("qid").agg(F.count_distinct("concept").alias("n")).withColumn("green", F.col("n") >= at_least)


def compared(one: DataFrame, other: DataFrame) -> DataFrame:
    """qid, only_one, only_other: answer rows (qid, row_key) of one dataset alone."""
    a, b = one.select("qid", "row_key").distinct(), other.select("qid", "row_key").distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["qid", "row_key"], "full")
    return both.groupBy("qid").agg(F.count_if(F.col("y").isNull()).alias("only_one"), F.count_if(F.col("x").isNull()).alias("only_other"))
