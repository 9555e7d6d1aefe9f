"""Provenance records of decisions, their queries, and batches of changes checked as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import decisions


def batch_report(rows: DataFrame) -> DataFrame:
    """action, n, bad, written: an edited batch; one bad row and nothing of the batch is written."""
    checked = decisions.validated(rows)
    bad = checked.agg(F.count("reason").alias("total_bad"))
    counted = checked.groupBy(F.col("decision").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("bad"))
    return counted.join(F.broadcast(bad)).select("action", "n", "bad", (F.col("total_bad") == 0).alias("written"))  # bad: one row


def single_reasons(requests: DataFrame, state: DataFrame, terms: DataFrame) -> DataFrame:
    """The requests (concept_key, kind, dpv_iri, replaces, relation) with the reason against each by itself, null where there is none."""
    own = state.groupBy("concept_key").agg(F.collect_set("dpv_iri").alias("held"))
    joined = requests.join(own, "concept_key", "left").join(terms.select(F.col("iri").alias("dpv_iri"), F.col("kind").alias("t_kind")), "dpv_iri", "left")
    held = F.coalesce("held", F.array().cast("array<string>"))
    reason = (
        F.when(F.col("t_kind").isNull(), "unknown term").when(F.col("t_kind") != F.col("kind"), "incompatible kind").when(~F.col("relation").isin(decisions.RELATIONS), "unknown relation")
        .when((F.size(held) > 1) & F.col("replaces").isNull(), "which mapping").when(F.array_contains(held, F.col("dpv_iri")), "no change")
    )
    return joined.select(*requests.columns, reason.alias("reason"))


def change_reasons(requests: DataFrame, state: DataFrame, terms: DataFrame) -> DataFrame:
    """seq, reason of change requests: null for those that can be made.

    Only one change a concept counts, the first that is valid otherwise.
    """
    found = single_reasons(requests, state, terms)
    order = Window.partitionBy("concept_key", F.col("reason").isNull()).orderBy("seq")
    return found.withColumn("turn", F.row_number().over(order)).select("seq", F.when(F.col("reason").isNull() & (F.col("turn") > 1), "one change a concept").otherwise(F.col("reason")).alias("reason"))


def records(current: DataFrame, ended: DataFrame) -> DataFrame:
    """id, activity, subject, who, seq: a record per standing decision and per ended approval."""
    row = lambda df, activity, who: df.select(
        decisions.record_id(F.lit(activity), F.col("concept_key"), F.col("dpv_iri"), F.col("seq").cast("string")).alias("id"), F.lit(activity).alias("activity"), F.col("concept_key").alias("subject"), who.alias("who"), "seq"
    )
    mapping = row(current.where("decision = 'approved'"), "mapping", F.col("reviewer"))
    none = row(current.where("decision = 'no_match'"), "no_match", F.col("reviewer"))
    past = row(ended.where("until is not null"), "ended", F.lit(None).cast("string"))
    return mapping.unionByName(none).unionByName(past)


def marked_current(records_: DataFrame, final: DataFrame) -> DataFrame:
    """records (subject, dpv_iri, relation) with current: are they in the final state?"""
    state = final.select(F.col("concept_key").alias("subject"), "dpv_iri", "relation").distinct().withColumn("there", F.lit(True))
    return records_.join(state, ["subject", "dpv_iri", "relation"], "left").withColumn("current", F.coalesce("there", F.lit(False))).drop("there")


def activity_records(parts: dict[str, DataFrame]) -> DataFrame:
    """activity, subject, id of the other activities: each part has a column subject."""
    out = None
    for activity, rows in sorted(parts.items()):
        own = rows.select(F.lit(activity).alias("activity"), F.col("subject").cast("string").alias("subject"))
        own = own.withColumn("id", decisions.record_id(F.col("activity"), F.col("subject")))
        out = own if out is None else out.unionByName(own)
    return out


def records_of(records_: DataFrame, notes: DataFrame, subject: str) -> DataFrame:
    """activity, who, seq, notes of one subject's records; its notes (id, note) joined in order."""
    own = records_.where(F.col("subject") == subject)
    texts = notes.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("note")), "; ").alias("notes"))
    return own.join(texts, "id", "left").select("activity", "who", "seq", "notes")


def bridge_statements(pairs: DataFrame) -> DataFrame:
    """s, p, o: a closeMatch per pair, and a node with the terms that chain it. pairs: a, b, terms (joined by ',')."""
    node = F.concat(F.lit("_:pair"), F.substring(F.sha2(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 24))
    row = lambda s, p, o: F.struct(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    match = F.array(row(F.col("a"), "skos:closeMatch", F.col("b")))
    said = F.transform(F.split("terms", ","), lambda t: F.struct(node.alias("s"), F.lit("via").alias("p"), t.alias("o")))
    return pairs.select(F.explode(F.concat(match, said)).alias("x")).select("x.*")


def profile_statements(entries: DataFrame, core: DataFrame) -> DataFrame:
    """s, p, o: type and label of new and linked concepts; reused ones copy the core's types. entries: s, status, label."""
    own = entries.where("status <> 'reused'").select("s", F.explode(F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o")), F.struct(F.lit("rdfs:label").alias("p"), F.col("label").alias("o")))).alias("x")).select("s", "x.*")
    types = core.where("p = 'rdf:type'").join(entries.where("status = 'reused'").select("s"), "s", "left_semi").select("s", "p", "o")
    return own.unionByName(types)


def alignment_module(approved: DataFrame, duplicates: DataFrame) -> DataFrame:
    """s, p, o: approved mappings and the articles of each concept; those of a duplicate move to what it duplicates.

    approved: s, relation, o, articles; duplicates: s, same_as.
    """
    moved = approved.join(duplicates, "s", "left")
    sources = moved.select(F.coalesce("same_as", "s").alias("s"), F.lit("dct:source").alias("p"), F.explode("articles").alias("a")).select("s", "p", F.concat(F.lit("art. "), F.col("a").cast("string")).alias("o")).distinct()
    return moved.where("same_as is null").select("s", F.col("relation").alias("p"), "o").unionByName(sources)


def written_counts(statements: DataFrame, current: DataFrame) -> DataFrame:
    """written, logged, same: mapping statements against approvals in the log."""
    w = statements.where(F.col("p").isin(decisions.RELATIONS)).agg(F.count(F.lit(1)).alias("written"))
    n = current.where("decision = 'approved'").agg(F.count(F.lit(1)).alias("logged"))
    return w.crossJoin(n).withColumn("same", F.col("written") == F.col("logged"))  # one row each
