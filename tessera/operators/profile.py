"""Projections, predicates and entity profiles over statements (s, p, o, o_kind, dt, lang) and concept tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import BORROWED, local_name, namespace, primary_language, semantic_text

STATEMENT = ["s", "p", "o", "dt", "lang"]
#: Which term kinds a concept kind may match.
MATCHES = {"class": "class", "individual": "class", "property": "property", "object_property": "property", "data_property": "property"}


def graph_union(*graphs: DataFrame) -> DataFrame:
    """Statements of several graphs as one set."""
    return reduce(DataFrame.unionByName, graphs).dropDuplicates(STATEMENT)


def match(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Statements with the given subject, predicate and object; None matches all."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            graph = graph.where(F.col(column) == value)
    return graph


def first_literal(graph: DataFrame, predicates: list[str]) -> DataFrame:
    """s, o: the literal of the first of these predicates a subject has; of several the least text."""
    rank = F.coalesce(*[F.when(F.col("p") == p, i) for i, p in enumerate(predicates)])
    own = graph.where(F.col("p").isin(predicates) & (F.col("o_kind") == "literal"))
    return own.groupBy("s").agg(F.min(F.struct(rank.alias("r"), "o")).alias("x")).select("s", "x.o")


def literal_by_language(graph: DataFrame, predicate: str, languages: list[str]) -> DataFrame:
    """s, o, lang: the literal in the first of these languages, else in any; ties by text."""
    tag = primary_language(F.col("lang"))
    rank = F.coalesce(*[F.when(tag == x, i) for i, x in enumerate(languages)], F.lit(len(languages)))
    best = match(graph, p=predicate).groupBy("s").agg(F.min(F.struct(rank.alias("r"), "o", "lang")).alias("x"))
    return best.select("s", "x.o", "x.lang")


def is_borrowed(iri):
    return reduce(lambda a, b: a | b, [iri.startswith(x) for x in BORROWED])


def kinds_of(graph: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """s, kinds: the sorted kinds of every subject that has one of these types (several: punning)."""
    kind = F.coalesce(*[F.when(F.col("o") == t, k) for t, k in kinds.items()])
    typed = match(graph, p="rdf:type").where(F.col("o").isin(list(kinds)))
    return typed.groupBy("s").agg(F.sort_array(F.collect_set(kind)).alias("kinds"))


def undeclared_properties(graph: DataFrame, types: list[str]) -> DataFrame:
    """s: predicates in use that no statement types as a property."""
    declared = match(graph, p="rdf:type").where(F.col("o").isin(types)).select(F.col("s").alias("p"))
    return graph.select("p").distinct().join(declared, "p", "left_anti").withColumnRenamed("p", "s")


def dataset_profile(graph: DataFrame) -> DataFrame:
    """One row: statements, classes, object and data properties, properties of both, and the flavour that follows."""
    of = lambda t: F.count_distinct(F.when((F.col("p") == "rdf:type") & (F.col("o") == t), F.col("s")))
    counts = graph.agg(F.count(F.lit(1)).alias("n_statements"), of("owl:Class").alias("n_classes"), of("owl:ObjectProperty").alias("n_object"), of("owl:DatatypeProperty").alias("n_data"))
    kinds = kinds_of(graph, {"owl:ObjectProperty": "object", "owl:DatatypeProperty": "data"})
    both = kinds.agg(F.count_if(F.size("kinds") > 1).alias("n_both"))
    flavour = F.when(F.col("n_both") > 0, "owl-full").when(F.col("n_object") + F.col("n_data") > 0, "dl-compatible").when(F.col("n_classes") > 0, "rdfs").otherwise("unknown")
    return counts.crossJoin(both).withColumn("flavour", flavour)  # one row each


def concept_table(entities: DataFrame) -> DataFrame:
    """origin counts of the concepts that are not borrowed, per kind; entities: iri, kind, origin."""
    own = entities.where(~is_borrowed(F.col("iri")))
    return own.groupBy("origin", "kind").agg(F.count_distinct("iri").alias("n"))


def proposed_concepts(rows: DataFrame) -> DataFrame:
    """name, kind, seq: the first row of each name in lower case; a lower-case initial makes a property."""
    first = rows.groupBy(F.lower("name").alias("folded")).agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    initial = F.substring("name", 1, 1)
    lower = (F.lower(initial) == initial) & (F.upper(initial) != initial)
    return first.select("name", F.when(lower, "property").otherwise("class").alias("kind"), "seq")


def target_terms(terms: DataFrame) -> DataFrame:
    """iri, kind, parents, n_children of a term table with one parent a row."""
    parents = terms.groupBy("iri", "kind").agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    children = terms.where("parent <> iri").groupBy(F.col("parent").alias("iri")).agg(F.count(F.lit(1)).alias("n_children"))
    return parents.join(children, "iri", "left").na.fill(0, ["n_children"])


def compatible_pairs(concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """Concepts joined with the terms whose kind theirs may match: an equi-join on the allowed kind."""
    allowed = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in MATCHES.items()])
    return concepts.withColumn("allowed", allowed).join(terms.withColumnsRenamed({c: f"t_{c}" for c in terms.columns}), F.col("allowed") == F.col("t_kind")).drop("allowed")


def with_semantic_text(concepts: DataFrame) -> DataFrame:
    return concepts.withColumn("semantic", semantic_text(F.col("name"), F.col("label"), F.col("definition")))


def used_namespaces(graph: DataFrame) -> DataFrame:
    """namespace, n of all IRIs in use."""
    iris = graph.select(F.explode(F.array("s", F.when(F.col("o_kind") == "iri", F.col("o")))).alias("iri")).where(F.col("iri").rlike("^https?://"))
    return iris.select(namespace(F.col("iri")).alias("namespace")).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def predicate_summary(graph: DataFrame) -> DataFrame:
    """p, uses, subjects, literals, languages (sorted) per predicate."""
    return graph.groupBy("p").agg(
        F.count(F.lit(1)).alias("uses"), F.count_distinct("s").alias("subjects"), F.count_if(F.col("o_kind") == "literal").alias("literals"),
        F.array_join(F.sort_array(F.collect_set(primary_language(F.col("lang")))), ",").alias("languages"),
    )


def label_inventory(labels: DataFrame, wanted: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """s, languages, n_untagged, missing: languages of the non-blank labels; which of the wanted ones are missing."""
    own = labels.where(F.btrim("o") != "").withColumn("tag", primary_language(F.col("lang")))
    found = own.groupBy("s").agg(F.sort_array(F.collect_set("tag")).alias("langs"), F.count_if(F.col("tag").isNull()).alias("n_untagged"))
    missing = F.array_except(F.array(*map(F.lit, wanted)), "langs")
    return found.select("s", F.array_join("langs", ",").alias("languages"), "n_untagged", F.array_join(missing, ",").alias("missing"))


def final_labels(existing: DataFrame, added: DataFrame) -> DataFrame:
    """s, label, status: the existing label, else the added one, else none (pending)."""
    both = existing.withColumnRenamed("o", "had").join(added.withColumnRenamed("o", "new"), "s", "full")
    status = F.when(F.col("had").isNotNull(), "existing").when(F.col("new").isNotNull(), "added").otherwise("pending")
    return both.select("s", F.coalesce("had", "new").alias("label"), status.alias("status"))


def glossary(rows: DataFrame) -> DataFrame:
    """key, names: the sorted distinct names of each key."""
    return rows.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("names"))


def article_links(iris: DataFrame, pattern: str = "#article(\\d+)\\b") -> DataFrame:
    """iri, article: the number in the IRI, where it has one."""
    return iris.select("iri", F.regexp_extract("iri", pattern, 1).alias("article")).where("article <> ''").select("iri", F.col("article").cast("int"))


def localized(graph: DataFrame) -> DataFrame:
    """iri, local, namespace of every subject."""
    return graph.select(F.col("s").alias("iri")).distinct().select("iri", local_name(F.col("iri")).alias("local"), namespace(F.col("iri")).alias("namespace"))
