"""The log operators as streams: what a batch gives is the change it makes, never the whole table again.

Files that come late or in any order do no harm: an event counts by its seq. Each change row carries the seq of the event that made
it, so the state at any time is the last change of each key, and changes may be stored and merged in any order, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.decisions import KEY
from tessera.sources.storage import scratch

LOG = "seq bigint, source_id string, target string, concept_key string, dpv_iri string, decision string, relation string"
CHANGES = "concept_key string, dpv_iri string, relation string, seq bigint, in_force boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_stream(spark: SparkSession, path: str, schema: str = LOG, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk, as keyed state asks for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def finished(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, mode: str = "update") -> DataFrame:
    """Runs what is there through the stream and gives all changes so far; each batch is a folder of its own, so a batch that is
    done again after a failure replaces itself. With the same out and checkpoint a later call goes on where this one ended."""
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark), checkpoint or scratch(spark)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")

    with keyed_state(spark):
        query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(spark, out, stream.schema)


def stored(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of all batches; none before the first."""
    try:
        return spark.read.schema(schema).parquet(f"{out}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest_changes(stream: DataFrame) -> DataFrame:
    """Last decision so far of each key that a batch touches. The state has a row a key."""
    rest = [c for c in stream.columns if c not in KEY]
    return stream.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(*KEY, "x.*")


def latest_of(changes: DataFrame) -> DataFrame:
    """The last decision of each key out of its changes."""
    rest = [c for c in changes.columns if c not in KEY]
    return changes.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(*KEY, "x.*")


class Replay(StatefulProcessor):
    """State of a concept: for each term its last event, and when the concept was last cleared. Events that a clear has overtaken are
    taken out of the state and later ones of theirs are not let in, so it never has more than a row a term."""

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "dpv_iri string", "seq bigint, decision string, relation string", self.expire_ms)
        self.cleared = handle.getValueState("cleared", "seq bigint", self.expire_ms)

    def handleInputRows(self, key, rows, timer_values=None) -> Iterator[Row]:
        held = self.cleared.get()
        before = held[0] if held is not None else None
        cleared, newest = before, {}
        for row in rows:
            if row.decision == "no_match":
                cleared = row.seq if cleared is None else max(cleared, row.seq)
            elif row.dpv_iri and (row.dpv_iri not in newest or row.seq > newest[row.dpv_iri][0]):
                newest[row.dpv_iri] = (row.seq, row.decision, row.relation)
        if cleared != before:
            self.cleared.update((cleared,))
            overtaken = [(term[0], tuple(value)) for term, value in self.terms.iterator() if value[0] < cleared]
            for term, (_, decision, relation) in overtaken:
                self.terms.removeKey((term,))
                if decision == "approved":
                    yield Row(concept_key=key[0], dpv_iri=term, relation=relation, seq=cleared, in_force=False)
        for term, event in newest.items():
            if cleared is not None and event[0] < cleared:
                continue
            last = self.terms.getValue((term,))
            if last is not None and event[0] < last[0]:
                continue
            self.terms.updateValue((term,), event)
            if event[1] == "approved" or (last is not None and last[1] == "approved"):
                yield Row(concept_key=key[0], dpv_iri=term, relation=event[2], seq=event[0], in_force=event[1] == "approved")

    def close(self) -> None:
        pass


def replay_changes(stream: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """CHANGES: what comes into force or goes out of it with each batch. expire_ms: state untouched for so long is forgotten; events
    that come later than that are then judged without it."""
    own = stream.select("concept_key", "dpv_iri", "seq", "decision", "relation")
    return own.groupBy("concept_key").transformWithState(Replay(expire_ms), CHANGES, "Update", "ProcessingTime" if expire_ms else "None")


def in_force(changes: DataFrame) -> DataFrame:
    """concept_key, dpv_iri, relation of the mappings whose last change put them in force."""
    last = changes.groupBy("concept_key", "dpv_iri").agg(F.max_by(F.struct("relation", "in_force"), "seq").alias("x"))
    return last.where("x.in_force").select("concept_key", "dpv_iri", "x.relation")


def take_in(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, key: str = "cache_key") -> DataFrame:
    """Rows of keys that are not in the store yet, one a key, exactly once. The store itself is what is remembered: a batch is held against
    it, so the stream has no state that grows."""
    spark, schema = stream.sparkSession, stream.schema
    out, checkpoint = out or scratch(spark), checkpoint or scratch(spark)

    def put(batch: DataFrame, epoch: int) -> None:
        # a batch that is done again must not meet its own rows
        known = stored(spark, out, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, epoch bigint").where(F.col("epoch") != epoch)
        rest = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, "x.*") if rest else batch.select(key).distinct()
        new = one.join(known.select(key), key, "left_anti").select(*batch.columns).withColumn("epoch", F.lit(epoch).cast("bigint"))
        new.write.mode("overwrite").parquet(f"{out}/{epoch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(spark, out, schema)
