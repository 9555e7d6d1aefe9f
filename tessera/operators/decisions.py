"""The append-only decision log: latest state, replay, versions, progress, caches and fingerprints.

"Latest" is last in the log (seq), never the greatest time. A key is (source_id, target, concept_key, dpv_iri).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.digests import digest_of

KEY = ["source_id", "target", "concept_key", "dpv_iri"]
CODES = ["approved", "rejected", "no_match", "pending"]
RELATIONS = ["exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch"]
#: The codes of a decision on a mapping and on a proposed concept; the kinds of entity that a concept is approved as.
ALLOWED = {"concept": ["approved", "rejected", "duplicate", "pending"], "mapping": CODES}
ENTITY_KINDS = ["class", "object_property", "datatype_property"]
#: A record of the log. snapshot says freely how the proposal came about; it is kept as it is and read by path (variant_get).
RECORD = (
    "seq bigint, source_id string, target string, concept_key string, dpv_iri string, decision string, relation string, entity_kind string, same_as string, "
    "reviewer string, decided_at timestamp, note string, snapshot variant"
)


def validation_reason(columns: list[str]) -> Column:
    """The first rule that a record breaks; null for a good record. Columns that a log doesn't have are taken as empty (target: mapping)."""
    text = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) if c in columns else F.lit("")
    is_ = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False)) if c in columns else F.lit(False)
    target = F.coalesce(F.col("target"), F.lit("")) if "target" in columns else F.lit("mapping")
    concept, approved, decision = target == "concept", text("decision") == "approved", text("decision")
    term, relation, kind, same = text("dpv_iri") != "", text("relation") != "", text("entity_kind") != "", text("same_as") != ""
    known = F.when(concept, is_("decision", ALLOWED["concept"])).otherwise(is_("decision", ALLOWED["mapping"]))
    rules = [
        (text("reviewer") == "", "no reviewer"),
        (text("source_id") == "" if "source_id" in columns else F.lit(False), "no source"),
        (text("concept_key") == "", "no concept"),
        (~target.isin(list(ALLOWED)), "unknown target"),
        (~known, "unknown decision"),
        (concept & term, "concept with a term"),
        (concept & relation, "concept with a relation"),
        (concept & approved & ~is_("entity_kind", ENTITY_KINDS), "approved without an entity kind"),
        (concept & ~approved & kind, "entity kind without approval"),
        (concept & (decision == "duplicate") & ~same, "duplicate of nothing"),
        (concept & (decision != "duplicate") & same, "same entity without duplicate"),
        (~concept & kind, "mapping with an entity kind"),
        (~concept & same, "mapping with a same entity"),
        (~concept & (decision == "no_match") & (term | relation), "no_match with a term or relation"),
        (~concept & ~term & ~decision.isin("no_match", "pending"), "no term"),
        (~concept & approved & ~is_("relation", RELATIONS), "approved without a known relation"),
        (~concept & ~approved & relation, "relation without approval"),
    ]
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])


def validated(log: DataFrame) -> DataFrame:
    return log.withColumn("reason", validation_reason(log.columns))


def latest(log: DataFrame) -> DataFrame:
    """Last decision of each key; a key whose last decision is pending is withdrawn."""
    rest = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return last.select(*KEY, "x.*").where("decision <> 'pending'").select(*log.columns)


def counts(current: DataFrame) -> DataFrame:
    """target and one count per code, zero-filled."""
    return current.groupBy("target").pivot("decision", CODES).count().na.fill(0)


def concept_status(current: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept_key, status: aligned if any approval stands, no_match if that stands, else pending."""
    own = current.groupBy("concept_key").agg(F.bool_or(F.col("decision") == "approved").alias("a"), F.bool_or(F.col("decision") == "no_match").alias("n"))
    status = F.when(F.col("a"), "aligned").when(F.col("n"), "no_match").otherwise("pending")
    return concepts.select("concept_key").join(own, "concept_key", "left").select("concept_key", status.alias("status"))


def progress(statuses: DataFrame, origins: DataFrame) -> DataFrame:
    """origin, aligned, no_match, pending."""
    return statuses.join(origins, "concept_key").groupBy("origin").pivot("status", ["aligned", "no_match", "pending"]).count().na.fill(0)


def approved_mappings(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Approved rows with the rank of their candidate; found by search where there is none."""
    own = current.where("decision = 'approved'").select("source_id", "concept_key", "dpv_iri", "relation")
    joined = own.join(candidates.select("concept_key", "dpv_iri", "rank"), ["concept_key", "dpv_iri"], "left")
    return joined.withColumn("found_by", F.when(F.col("rank").isNotNull(), "candidates").otherwise("search"))


def row_states(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Every candidate with its state, and decided terms that were no candidates."""
    own = current.where("dpv_iri <> ''").groupBy("concept_key", "dpv_iri").agg(F.max_by("decision", "seq").alias("decision"))
    both = candidates.select("concept_key", "dpv_iri", "rank").join(own, ["concept_key", "dpv_iri"], "full")
    return both.select("concept_key", "dpv_iri", "rank", F.coalesce("decision", F.lit("open")).alias("state"))


def next_pending(statuses: DataFrame) -> DataFrame:
    """concept_key, next: the next pending concept in key order, wrapping round to the first."""
    key = F.when(F.col("status") == "pending", F.col("concept_key"))
    buckets = statuses.select("concept_key", key.alias("p"), F.substring("concept_key", 1, 2).alias("part"))
    # within a part by a window; beyond it by the first pending key of the next part that has one
    firsts = buckets.groupBy("part").agg(F.min("p").alias("first"))
    # looked at from the end, what follows is a running last value: linear in the rows
    before = (Window.unboundedPreceding, -1)
    parts = Window.orderBy(F.desc("part"))  # one row a part: two characters of a key
    after = firsts.select("part", F.last("first", True).over(parts.rowsBetween(*before)).alias("after"), F.min("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("overall"))
    within = F.last("p", True).over(Window.partitionBy("part").orderBy(F.desc("concept_key")).rowsBetween(*before))
    return buckets.withColumn("within", within).join(after, "part").select("concept_key", F.coalesce("within", "after", "overall").alias("next"))


def agreement(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """n, same, share: approved rows whose relation is the proposed one."""
    both = current.where("decision = 'approved'").join(proposals.select("concept_key", "dpv_iri", F.col("relation").alias("proposed")), ["concept_key", "dpv_iri"])
    one = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == F.col("proposed")).alias("same"))
    return one.withColumn("share", F.round(F.try_divide("same", "n"), 4))


def open_proposals(proposals: DataFrame, statuses: DataFrame) -> DataFrame:
    """Proposals of concepts that are still pending."""
    return proposals.join(statuses.where("status = 'pending'").select("concept_key"), "concept_key", "left_semi")


def best_with_clash(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """key, name, clash: the row of lowest rank per key; clash if an entity has the name in lower case."""
    best = rows.groupBy("key").agg(F.min_by("name", "rank").alias("name"))
    names = entities.select(F.lower("name").alias("folded")).distinct().withColumn("clash", F.lit(True))
    return best.join(names, F.lower("name") == F.col("folded"), "left").select("key", "name", F.coalesce("clash", F.lit(False)).alias("clash"))


def excluded(current: DataFrame) -> DataFrame:
    """Concepts with a rejection and no approval."""
    rejected = current.where("decision = 'rejected'").select("concept_key").distinct()
    return rejected.join(current.where("decision = 'approved'").select("concept_key"), "concept_key", "left_anti")


def approvals(log: DataFrame) -> DataFrame:
    """concept_key, dpv_iri, relation, seq, until, version of every approval.

    An approval ends at the next decision on its concept and term; approving again with the same relation changes nothing;
    the version is 1 + the concept's approvals that had ended before.
    """
    own = Window.partitionBy("source_id", "concept_key", "dpv_iri").orderBy("seq")
    again = (F.col("decision") == "approved") & (F.lag("decision").over(own) == "approved") & F.lag("relation").over(own).eqNullSafe(F.col("relation"))
    steps = log.where("dpv_iri <> ''").withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    found = steps.withColumn("until", F.lead("seq").over(own)).where("decision = 'approved'")
    found = found.select("source_id", "concept_key", "dpv_iri", "relation", "seq", "until")
    # starts and ends of a concept in order: the ends met so far are the ended approvals
    moments = found.select("source_id", "concept_key", F.explode(F.array(F.struct(F.col("seq").alias("at"), F.lit(0).alias("ended")), F.struct(F.col("until").alias("at"), F.lit(1).alias("ended")))).alias("m"))
    moments = moments.select("source_id", "concept_key", "m.*").where("at is not null")
    so_far = F.sum("ended").over(Window.partitionBy("source_id", "concept_key").orderBy("at", "ended").rowsBetween(Window.unboundedPreceding, 0))
    versions = moments.withColumn("version", 1 + so_far).where("ended = 0").select("source_id", "concept_key", F.col("at").alias("seq"), "version")
    return found.join(versions, ["source_id", "concept_key", "seq"])


def replay(base: DataFrame, log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """concept_key, dpv_iri, relation, origin after the log: approvals set, rejections remove, no_match clears the concept.

    keep: further columns of the deciding record, such as its snapshot; null for rows of the base.
    """
    clears = log.where("decision = 'no_match'").groupBy("concept_key").agg(F.max("seq").alias("cleared"))
    events = log.where("dpv_iri <> ''").groupBy("concept_key", "dpv_iri").agg(F.max_by(F.struct("decision", "relation", *keep), "seq").alias("x"), F.max("seq").alias("seq"))
    events = events.join(clears, "concept_key", "left")
    alive = events.where("x.decision = 'approved' and (cleared is null or seq > cleared)").select("concept_key", "dpv_iri", "x.relation", F.lit("user").alias("origin"), *[f"x.{c}" for c in keep])
    kept = base.join(clears, "concept_key", "left_anti").join(events.select("concept_key", "dpv_iri"), ["concept_key", "dpv_iri"], "left_anti")
    none = [F.lit(None).cast(alive.schema[c].dataType).alias(c) for c in keep]
    return kept.select("concept_key", "dpv_iri", "relation", F.lit("base").alias("origin"), *none).unionByName(alive)


def overlay(base: DataFrame, log: DataFrame) -> DataFrame:
    """Base rows of untouched concepts, the replayed rows of touched ones, and a no_match row where nothing is left."""
    touched = log.select("concept_key").distinct()
    after = replay(base, log).join(touched, "concept_key", "left_semi")
    none = touched.join(after.select("concept_key"), "concept_key", "left_anti").select("concept_key", F.lit("").alias("dpv_iri"), F.lit(None).cast("string").alias("relation"), F.lit("no_match").alias("origin"))
    rest = base.join(touched, "concept_key", "left_anti").select("concept_key", "dpv_iri", "relation", F.lit("base").alias("origin"))
    return rest.unionByName(after).unionByName(none)


def change_rows(requests: DataFrame) -> DataFrame:
    """Requests (concept_key, replaces, dpv_iri, action) as log rows: a replacement is a rejection and an approval."""
    row = lambda decision, term: F.struct(F.lit(decision).alias("decision"), term.alias("dpv_iri"))
    approve, reject = row("approved", F.col("dpv_iri")), row("rejected", F.col("replaces"))
    clear = row("no_match", F.lit(""))
    rows = F.when(F.col("action") == "replace", F.array(reject, approve)).when(F.col("action") == "add", F.array(approve)).when(F.col("replaces").isNotNull(), F.array(reject)).otherwise(F.array(clear))
    return requests.select("seq", "concept_key", F.posexplode(rows).alias("step", "r")).select("seq", "concept_key", "step", "r.*")


def version_validity(log: DataFrame) -> DataFrame:
    """concept_key, version, seq, until: every change of a concept opens a version that ends at the next."""
    own = Window.partitionBy("source_id", "concept_key").orderBy("seq")
    return log.select("source_id", "concept_key", F.row_number().over(own).alias("version"), "seq", F.lead("seq").over(own).alias("until"))


def is_current(saved: DataFrame, now: DataFrame) -> DataFrame:
    """name, current: saved and present manifests (name, n, digest) agree."""
    other = now.select("name", F.col("n").alias("n_now"), F.col("digest").alias("digest_now"))
    return saved.join(other, "name", "full").select("name", (F.col("n").eqNullSafe(F.col("n_now")) & F.col("digest").eqNullSafe(F.col("digest_now"))).alias("current"))


def cache_key(*parts: Column) -> Column:
    """Of the parts in order; a null is a part like any other."""
    return digest_of(*parts)


def cache_split(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """The asked rows with hit: is there an answer under their key?"""
    known = cache.select("cache_key").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "cache_key", "left").withColumn("hit", F.coalesce("known", F.lit(False))).drop("known")


def cache_merge(shared: DataFrame, *others: DataFrame) -> DataFrame:
    """The shared cache and the new keys of the others, the first cache's answer for each."""
    every = reduce(DataFrame.unionByName, [o.withColumn("turn", F.lit(i)) for i, o in enumerate((shared, *others))])
    rest = [c for c in shared.columns if c != "cache_key"]
    return every.groupBy("cache_key").agg(F.min_by(F.struct(*rest), F.struct("turn", *rest)).alias("x")).select("cache_key", "x.*")


def canonical_names(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """column by the alias table (alias, person), itself where there is none."""
    return rows.join(aliases, F.col(column) == F.col("alias"), "left").withColumn(column, F.coalesce("person", column)).drop("alias", "person")


def record_id(*parts: Column) -> Column:
    """16 hexadecimal digits of the sha256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(" ", *parts), 256), 1, 16)


def unattributed(statements: DataFrame, records: DataFrame) -> DataFrame:
    """Statements (concept_key, dpv_iri) that no record accounts for."""
    return statements.select("concept_key", "dpv_iri").distinct().join(records.select("concept_key", "dpv_iri"), ["concept_key", "dpv_iri"], "left_anti")


def in_force(records: DataFrame) -> DataFrame:
    """A mapping is in force while current; a no_match one while no mapping of its concept is."""
    mapping = F.col("decision") == "approved"
    any_current = F.bool_or(mapping & F.col("current")).over(Window.partitionBy("concept_key"))
    return records.withColumn("in_force", F.when(mapping, F.col("current")).otherwise(F.col("current") & ~any_current))


def content_ids(rows: DataFrame, kind: str, column: str) -> DataFrame:
    """id, n: the content-addressed id (kind and bytes) and how many rows share it."""
    return rows.select(F.sha2(F.concat(F.lit(kind + "\n"), F.coalesce(F.col(column), F.lit(""))), 256).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
