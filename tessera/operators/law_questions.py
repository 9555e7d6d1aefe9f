"""The questions on what a law's dataset says: unions of branches over statements (s, p, o, o_kind), with optional columns.

A branch gives concepts, or concepts with a value. Each optional column is a left join: a concept with two labels and two
sources has four rows, as in a graph query; equal rows are one. An empty graph answers nothing; a null object is no answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import MATCHES, descendants


@dataclass(frozen=True)
class Question:
    """below: strictly under this class. members: (type, property): what a subject of the type names. values: (type or None,
    property): subjects with their value. flag: such subjects have this property true. matched: aligned with a root or below
    it. articles: with a source that ends in one of these articles. optional: of label, match, source, type."""

    below: str | None = None
    members: tuple[tuple[str, str], ...] = ()
    values: tuple[tuple[str | None, str], ...] = ()
    flag: str | None = None
    matched: tuple[str, ...] = ()
    articles: tuple[int, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def cited(self) -> str:
        return f"art\\. ({'|'.join(map(str, self.articles))})$"

    @property
    def columns(self) -> list[str]:
        return ["concept", *(["value"] if self.values else []), *self.optional]


#: The vocabulary and the articles of the published questions.
QUESTIONS = {
    "l01_rights": Question(below="onto:Rights", members=(("onto:Rights", "onto:are_constituted_of"),), matched=("dpv:DataSubjectRight",), articles=(12, 13, 14, 15, 16, 17, 19, 20, 21, 22, 23), optional=("label", "match", "source")),
    "l02_cases": Question(values=((None, "onto:conditions_for_legitimate_treatment"),), matched=("dpv:LegalBasis",), articles=(7,), optional=("label", "match", "source")),
    "l03_principles": Question(below="onto:Principles", members=(("onto:Principles", "onto:are_composed_of"),), matched=("dpv:Principle",), articles=(10,), optional=("label", "match", "source")),
    "l04_categories": Question(below="onto:Special_personal_data_categories", members=(("onto:Special_personal_data_categories", "onto:special_categories_of_personal_data_are_composed_of"),), matched=("dpv:SpecialCategoryPersonalData",), articles=(25,), optional=("label", "match", "source")),
    "l05_deadlines": Question(values=((None, "onto:deadline_in_days_for_the_right_of_access"), (None, "op:right_of_access_time"))),
    "l06_notice": Question(values=(("op:Notification", "op:Security_notification_of_infringement"),)),
    "l07_measures": Question(values=(("onto:Corrective_measures", "onto:what_will_be_the_corrective_measures"),), below="op:Corrective_measures", articles=(65,), optional=("label", "source")),
    "l08_infringements": Question(members=(("onto:Violations", "onto:are_comprised_of"),), below="onto:Sanctions", articles=(67, 68, 69, 70), optional=("label", "source", "type")),
    "l09_transfers": Question(below="op:Transfer_or_communication", matched=("dpv:DataTransferLegalBasis", "dpv:SafeguardForDataTransfer"), articles=(56, 57, 58, 59, 60), optional=("label", "match", "source")),
    "l10_sensitive": Question(values=(("onto:Sensitive_data", "onto:data_related_to"),), matched=("dpv:SensitivePersonalData",), articles=(4,), optional=("label", "match", "source")),
    "k01_person_notice": Question(values=(("op:Notification", "op:time_of_a_vulnerability_notification"),)),
    "k02_consent": Question(values=(("onto:Consent", "onto:valid"),)),
    "k03_members": Question(members=(("onto:Members_of_the_personal_data_protection_system", "onto:are_composed_of"),), optional=("type", "match")),
    "k04_ensures": Question(members=(("onto:Rights", "onto:responsable_de_canalizar_el_ejercicio_de_derechos"), ("onto:Right_of_access", "onto:right_account_encumbered")), optional=("type",)),
    "k05_age": Question(values=((None, "onto:age"),), flag="onto:can_give_explicit_consent_to_treatment"),
}


def strictly_below(graph: DataFrame, root: str) -> DataFrame:
    """concept: under the root by one subclass step or more; the root itself only where it stands on a cycle."""
    edges = graph.where("p = 'rdfs:subClassOf'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    return descendants(edges, edges.where(F.col("parent") == root).select(F.col("child").alias("node"))).select(F.col("node").alias("concept"))


def matched_under(graph: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """concept: aligned with one of the roots or with a term below it."""
    edges = graph.where("p in ('rdfs:subClassOf', 'skos:broader')").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    start = graph.sparkSession.createDataFrame([(r,) for r in roots], "node string")
    matches = graph.where(F.col("p").isin(MATCHES))
    terms = descendants(edges, start)
    return matches.join(terms, matches["o"] == terms["node"], "left_semi").select(F.col("s").alias("concept"))


def with_property(graph: DataFrame, type_: str | None, property_: str) -> DataFrame:
    """s, o of a property, on subjects of the type if there is one."""
    own = graph.where(F.col("p") == property_).select("s", "o")
    return own if type_ is None else own.join(graph.where((F.col("p") == "rdf:type") & (F.col("o") == type_)).select("s"), "s", "left_semi")


def optional_column(graph: DataFrame, name: str) -> DataFrame:
    """concept, <name>."""
    which = {"label": F.col("p") == "rdfs:label", "match": F.col("p").isin(MATCHES), "source": F.col("p") == "dct:source", "type": (F.col("p") == "rdf:type") & (F.col("o") != "owl:NamedIndividual")}
    return graph.where(which[name]).select(F.col("s").alias("concept"), F.col("o").alias(name)).distinct()


def answered(graph: DataFrame, question: Question) -> DataFrame:
    """The distinct rows (question.columns) that answer the question."""
    branches = [with_property(graph, t, p).select(F.col("o").alias("concept")) for t, p in question.members]
    if question.below:
        branches.append(strictly_below(graph, question.below))
    if question.matched:
        branches.append(matched_under(graph, question.matched))
    if question.articles:
        branches.append(graph.where((F.col("p") == "dct:source") & F.col("o").rlike(question.cited)).select(F.col("s").alias("concept")))
    branches = [b.withColumn("value", F.lit(None).cast("string")) for b in branches]
    for type_, property_ in question.values:
        own = with_property(graph, type_, property_).where("o is not null")
        if question.flag:
            own = own.join(graph.where((F.col("p") == question.flag) & F.col("o").isin("true", "1")).select("s"), "s", "left_semi")
        branches.append(own.toDF("concept", "value"))
    rows = reduce(DataFrame.unionByName, branches).where("concept is not null").distinct()
    for name in question.optional:
        rows = rows.join(optional_column(graph, name), "concept", "left")
    return rows.select(*question.columns).distinct()
