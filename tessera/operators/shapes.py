"""Data-quality shapes, consistency rules and dataset comparison: each gives findings (rule, severity, focus, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISJOINT = [("exactMatch", "broadMatch"), ("exactMatch", "narrowMatch"), ("exactMatch", "relatedMatch"), ("relatedMatch", "broadMatch"), ("relatedMatch", "narrowMatch")]


def findings(rows: DataFrame, rule: str, severity: str, focus: str, value: Column | None = None) -> DataFrame:
    text = (value if value is not None else F.lit(None)).cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(focus).cast("string").alias("focus"), text.alias("value"))


def term_exists(mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """Mappings (s, o) to a term that is not defined."""
    return findings(mappings.join(terms.select("o"), "o", "left_anti"), "term_exists", "violation", "s", F.col("o"))


def mapping_conflict(mappings: DataFrame) -> DataFrame:
    """Pairs that hold two relations which exclude each other. mappings: s, o, relation."""
    held = mappings.groupBy("s", "o").agg(F.collect_set("relation").alias("r"))
    both = reduce(lambda a, b: a | b, [F.array_contains("r", x) & F.array_contains("r", y) for x, y in DISJOINT])
    return findings(held.where(both), "mapping_conflict", "violation", "s", F.col("o"))


def declared(mappings: DataFrame, typed: DataFrame) -> DataFrame:
    """Subjects of a mapping that have no type."""
    return findings(mappings.select("s").distinct().join(typed.select("s"), "s", "left_anti"), "declared", "violation", "s")


def annotation_complete(annotations: DataFrame, mappings: DataFrame, deciders: list[str]) -> DataFrame:
    """Annotations without their statement, with an unknown decider, or without a version."""
    known = mappings.select("s", "o").distinct().withColumn("there", F.lit(True))
    reason = F.when(F.col("there").isNull(), "no statement").when(~F.coalesce(F.col("decided_by").isin(deciders), F.lit(False)), "decider").when(F.col("version").isNull(), "version")
    joined = annotations.join(known, ["s", "o"], "left").withColumn("reason", reason).where("reason is not null")
    return findings(joined, "annotation_complete", "violation", "s", F.col("reason"))


def text_with_language(literals: DataFrame, rule: str) -> DataFrame:
    """Literals without a language or without text."""
    return findings(literals.where(F.col("lang").isNull() | (F.btrim("o") == "")), rule, "violation", "s", F.col("o"))


def cites_article(definitions: DataFrame, pattern: str) -> DataFrame:
    """Subjects none of whose sources cites an article, or with several definitions."""
    one = definitions.groupBy("s").agg(F.bool_or(F.col("source").rlike(pattern)).alias("cites"), F.count_distinct("o").alias("n"))
    return findings(one.where("not coalesce(cites, false) or n > 1"), "cites_article", "violation", "s", F.col("n"))


def untagged_langstring(graph: DataFrame) -> DataFrame:
    """Literals typed as language text without a language."""
    return findings(graph.where("dt = 'rdf:langString' and coalesce(lang, '') = ''"), "untagged_langstring", "violation", "s", F.col("o"))


def imports_resolved(imports: DataFrame, ontologies: DataFrame) -> DataFrame:
    """Imports (s, o) of what is neither an ontology nor a version (o)."""
    return findings(imports.join(ontologies.select("o"), "o", "left_anti"), "imports_resolved", "violation", "s", F.col("o"))


def has_label(entities: DataFrame, labels: DataFrame, language: str) -> DataFrame:
    """Entities (s) without a non-blank label of the language."""
    own = labels.where((F.lower(F.substring_index("lang", "-", 1)) == language) & (F.btrim("o") != "")).select("s")
    return findings(entities.select("s").distinct().join(own, "s", "left_anti"), f"label_{language}", "warning", "s")


def has_definition(entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """Entities without a non-blank definition."""
    return findings(entities.select("s").distinct().join(definitions.where(F.btrim("o") != "").select("s"), "s", "left_anti"), "definition", "warning", "s")


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


LABEL, DEFINITION, TYPE, VERSION, IMPORTS = "rdfs:label", "skos:definition", "rdf:type", "owl:versionInfo", "owl:imports"
RELATION_PREFIX = "skos:"


def every_shape(graph: DataFrame, vocabulary: str, terms: DataFrame, deciders: list[str], article: str = r"art\. ?[0-9]+") -> DataFrame:
    """The twelve shapes over one graph (s, p, o, o_kind, dt, lang), as one table of findings.

    Mappings are relation statements to terms of the vocabulary; terms: o, what it defines. Annotations are nodes with owl:annotatedSource,
    owl:annotatedTarget, decidedBy and owl:versionInfo; sources of definitions are dct:source of their subject. Shapes that look at one
    statement at a time are one pass over the graph; the others group by subject.
    """
    names = sorted({x for pair in DISJOINT for x in pair} | {"closeMatch"})
    mapped = graph.where(F.col("p").isin([RELATION_PREFIX + n for n in names]) & F.col("o").startswith(vocabulary))
    mappings = mapped.select("s", "o", F.substring_index("p", ":", -1).alias("relation"))
    typed = graph.where(F.col("p") == TYPE).select("s", "o")
    ontologies = typed.where("o = 'owl:Ontology'").select("s")
    entities = typed.where("o in ('owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty')").select("s").distinct()

    bad_text = F.col("lang").isNull() | (F.btrim("o") == "")
    rule = F.when((F.col("p") == LABEL) & bad_text, "label_language").when((F.col("p") == DEFINITION) & bad_text, "definition_language")
    untagged = F.when(F.expr("dt = 'rdf:langString' and coalesce(lang, '') = ''"), "untagged_langstring")
    one_pass = graph.where("o_kind = 'literal'").select("s", "o", F.explode(F.array_compact(F.array(rule, untagged))).alias("rule"))
    one_pass = one_pass.select("rule", F.lit("violation").alias("severity"), F.col("s").cast("string").alias("focus"), F.col("o").alias("value"))

    parts = {"owl:annotatedSource": "s", "owl:annotatedTarget": "o", "decidedBy": "decided_by", VERSION: "version"}
    nodes = graph.where(F.col("p").isin(list(parts))).groupBy(F.col("s").alias("node")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in parts.items()])
    annotations = nodes.where("s is not null and o is not null")
    sources = graph.where("p = 'dct:source'").select("s", F.col("o").alias("source"))
    definitions = graph.where(F.col("p") == DEFINITION).select("s", "o")
    imports = graph.where(F.col("p") == IMPORTS).select("s", "o")
    known = ontologies.select(F.col("s").alias("o")).unionByName(graph.where("p = 'owl:versionIRI'").select("o"))
    labels, texts = graph.where(F.col("p") == LABEL), graph.where(F.col("p") == DEFINITION)
    return all_findings(
        term_exists(mappings, terms), mapping_conflict(mappings), declared(mappings, typed), annotation_complete(annotations, mappings, deciders), one_pass,
        cites_article(definitions.join(sources, "s", "left"), article), imports_resolved(imports, known), has_label(entities, labels, "es"), has_label(entities, labels, "en"), has_definition(entities, texts),
    )


def origins(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Focus, rule, origin: new if some evidence statement is only the system's, else ontology, else base."""
    own = evidence.groupBy("focus").agg(F.bool_or(F.col("only_system")).alias("new"), F.bool_or(F.col("in_ontology")).alias("ontology"))
    joined = found.join(own, "focus", "left")
    return joined.select("focus", "rule", F.when(F.col("new"), "new").when(F.col("ontology"), "ontology").otherwise("base").alias("origin"))


def completeness_of(found: DataFrame, entities: DataFrame) -> DataFrame:
    """rule, severity, n, complete: as completeness, of the given entities (s) alone: findings on others don't lower it."""
    own = found.join(entities.select(F.col("s").alias("focus"), F.lit(True).alias("own")), "focus", "left")
    one = own.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("own"), F.col("focus"))).alias("failing"))
    total = entities.agg(F.count(F.lit(1)).alias("total"))
    return one.join(F.broadcast(total)).select("rule", "severity", "n", (F.col("total") - F.col("failing")).alias("complete"))  # total: one row


def completeness(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Rule, severity, n, complete: findings per rule, and how many entities are free of them."""
    total = entities.agg(F.count_distinct("s").alias("total"))
    one = found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("focus").alias("failing"))
    return one.join(F.broadcast(total)).select("rule", "severity", "n", (F.col("total") - F.col("failing")).alias("complete"))  # total: one row


def disjoint_classes(types: DataFrame, above: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Individuals in two disjoint classes. types: s, o; above: child, parent (reflexive closure); disjoint: a, b."""
    every = types.join(above, types["o"] == above["child"]).select("s", F.col("parent").alias("class")).distinct()
    left = every.join(disjoint, every["class"] == disjoint["a"]).select("s", "a", "b")
    right = every.select(F.col("s").alias("s2"), F.col("class").alias("b2"))
    both = left.join(right, (F.col("s") == F.col("s2")) & (F.col("b") == F.col("b2")))
    return findings(both, "disjoint_classes", "violation", "s", F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")))


def wrong_object_kind(graph: DataFrame, properties: DataFrame, kind: str) -> DataFrame:
    """V17 (data): resources of a data property; V18 (object): literals of an object property. properties: p, kind."""
    own = graph.join(properties.where(F.col("kind") == kind).select("p"), "p", "left_semi")
    wrong = own.where("o_kind <> 'literal'" if kind == "data" else "o_kind = 'literal'")
    return findings(wrong, f"{kind}_property_value", "violation", "s", F.col("o"))


def datatype_mismatch(literals: DataFrame) -> DataFrame:
    """Literals (s, o, dt) that their datatype can't be read from."""
    ok = F.when(F.col("dt") == "xsd:integer", F.col("o").try_cast("bigint").isNotNull()).when(F.col("dt") == "xsd:decimal", F.col("o").try_cast("double").isNotNull()).when(F.col("dt") == "xsd:boolean", F.col("o").isin("true", "false", "1", "0")).otherwise(True)
    return findings(literals.where(~ok), "datatype", "violation", "s", F.col("o"))


def new_findings(found: DataFrame, inherited: DataFrame) -> DataFrame:
    """Findings with new = not among the inherited ones; names of blank nodes don't count."""
    masked = F.regexp_replace(F.concat_ws("|", "rule", "focus", F.coalesce("value", F.lit(""))), "_:[A-Za-z0-9]+", "_:x")
    known = inherited.select(masked.alias("key")).distinct().withColumn("old", F.lit(True))
    return found.withColumn("key", masked).join(known, "key", "left").select("rule", "focus", "value", F.col("old").isNull().alias("new"))


def overall(statuses: DataFrame) -> DataFrame:
    """The worst of red, yellow (failed counts as yellow), green."""
    rank = F.when(F.col("status") == "red", 2).when(F.col("status").isin("yellow", "failed"), 1).otherwise(0)
    return statuses.agg(F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("status"))


def dataset_diff(original: DataFrame, result: DataFrame) -> DataFrame:
    """Missing, extra, same: ground statements compared, statements with blank nodes only counted."""
    ground = lambda g: g.where("o_kind <> 'bnode'").select("s", "p", "o", "dt", "lang")
    a, b = ground(original), ground(result)
    one = a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra")))  # one row each
    return one.withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))
