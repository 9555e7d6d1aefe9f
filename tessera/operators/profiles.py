"""Law profiles, module split and the remaining joins around matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import descendants, first_parents

DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of the words' crc32 modulo the dimensions, of unit length: a vector where no model supplies one."""
    slots = F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: (F.crc32(w.cast("binary")) % dimensions).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, F.round(x / norm, 6)).otherwise(0.0))


def vectors_of(rows: DataFrame, column: str) -> DataFrame:
    """rows with a vector; each distinct text is embedded once."""
    distinct = rows.select(column).distinct().withColumn("vector", hashed_vector(F.col(column)))
    return rows.join(distinct, column)


def core_match(entries: DataFrame, core: DataFrame, similar: DataFrame) -> DataFrame:
    """key, status: reused (a core concept of the same name), linked (similar to one), new."""
    names = core.select(F.lower("name").alias("folded")).distinct().withColumn("same", F.lit(True))
    near = similar.select("key").distinct().withColumn("near", F.lit(True))
    both = entries.join(names, F.lower("name") == F.col("folded"), "left").join(near, "key", "left")
    return both.select("key", F.when(F.col("same"), "reused").when(F.col("near"), "linked").otherwise("new").alias("status"))


def matched_definitions(concepts: DataFrame, law: DataFrame) -> DataFrame:
    """key, definition of law concepts of the same name; definitions that disagree are no match."""
    hits = concepts.select("key", F.lower("name").alias("n")).join(law.select(F.lower("name").alias("n"), "definition").distinct(), "n")
    return hits.groupBy("key").agg(F.count_distinct("definition").alias("k"), F.min("definition").alias("definition")).where("k = 1").select("key", "definition")


def review_items(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b with both sides' labels (id, label)."""
    return pairs.join(left.toDF("a", "a_label"), "a", "left").join(right.toDF("b", "b_label"), "b", "left")


def evidence(own: DataFrame, near: DataFrame) -> DataFrame:
    """key, article, origin: the row's own article if it has one, else the nearest."""
    both = own.join(near.select("key", F.col("article").alias("near")), "key", "left")
    return both.select("key", F.coalesce("article", "near").alias("article"), F.when(F.col("article").isNotNull(), "own").when(F.col("near").isNotNull(), "nearest").otherwise("none").alias("origin"))


#: A profile's entity this near to the vocabulary, or a core one this far from it, is shown for review.
NEAR, FAR = 0.75, 0.35


def module_assignment(classes: DataFrame, properties: DataFrame, edges: DataFrame, scores: DataFrame, profile: list[str], core: list[str], hint: str) -> DataFrame:
    """id, module, reason, flags of classes (id, name, family) and of properties that are no class (id, name, family, domain).

    Classes by family; those of a core family at or below a name with the hint, up the first parents of edges (child, parent),
    are of the profile; without a family they are core. Properties follow their domain where it is a class, else their family,
    else they are core, for review. scores: id, score of an entity's nearest term; one without has no flag for it.
    """
    hinted = descendants(first_parents(edges), classes.unionByName(properties.select("id", "name", "family")).where(F.lower("name").contains(hint)).select(F.col("id").alias("node")))
    marked = classes.join(hinted.select(F.col("node").alias("id"), F.lit(True).alias("hinted")), "id", "left")
    family = F.when(F.col("family").isin(profile), "profile").when(F.col("family").isin(core), "core")
    module = F.when(F.col("hinted") & (family == "core"), "profile").otherwise(F.coalesce(family, F.lit("core")))
    reason = F.when(F.col("hinted") & (family == "core"), "hint").when(family.isNotNull(), "family").otherwise("default")
    own = marked.select("id", "family", module.alias("module"), reason.alias("reason"))
    domains = own.select(F.col("id").alias("domain"), F.col("module").alias("followed"))
    pure = properties.join(classes.select("id"), "id", "left_anti").join(domains, "domain", "left")
    why = F.when(F.col("followed").isNotNull(), "domain").when(family.isNotNull(), "family").otherwise("default")
    every = own.unionByName(pure.select("id", "family", F.coalesce("followed", family, F.lit("core")).alias("module"), why.alias("reason")).withColumn("pure", F.lit(True)), allowMissingColumns=True)
    near, far = (F.col("module") == "profile") & (F.col("score") >= NEAR), (F.col("module") == "core") & (F.col("score") < FAR)
    flags = F.concat_ws("|", F.when(F.col("pure") & (F.col("reason") == "default"), "no domain"), F.when(F.col("family").isNull(), "no family"), F.when(near, "near").when(far, "far"))
    return every.join(scores.groupBy("id").agg(F.max("score").alias("score")), "id", "left").select("id", "module", "reason", flags.alias("flags"))


def module_counts(graph: DataFrame, modules: DataFrame) -> DataFrame:
    """module, statements, subjects of the split dataset (s, module)."""
    return graph.join(modules, "s").groupBy("module").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("s").alias("subjects"))


def preview(nodes: DataFrame, edges: DataFrame, aligned: int = 10, most: int = 16) -> DataFrame:
    """child, parent of the edges inside a preview: the first aligned nodes, then the others, to `most` (a top-k report)."""
    first = F.row_number().over(Window.partitionBy("aligned").orderBy("node"))
    ordered = nodes.withColumn("turn", F.when(F.col("aligned") & (first <= aligned), 0).otherwise(1)).orderBy("turn", "node").limit(most)
    ends = ordered.select("node")
    return edges.join(ends, edges["child"] == ends["node"], "left_semi").join(ends, edges["parent"] == ends["node"], "left_semi").select("child", "parent")
