"""Line dedup over the whole corpus by levelled sorted runs of line hashes.

Documents come in batches by rising doc_id. A run is a bucketed, sorted table of the line hashes that one or more batches
were the first to hold; runs never share a hash. A batch looks its hashes up in every run by a merge join on the common
buckets (the runs are neither shuffled nor sorted again), loses what an earlier document holds, and adds the hashes no run
has as a new run. When a level has FANOUT runs, they are merged, bucket by bucket, to one run of the next level, so a batch
meets few runs.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. A key of at least MIN_CHARS
code points that two or more documents hold keeps its lines in the smallest doc_id only (all of them there).

Defined cases: a null or empty text is one empty line, which is too short to be dropped; rows that repeat a doc_id are one
document; a null doc_id never holds a line first, and loses the lines that another document has; an empty table gives an
empty result; all other columns are passed on by `drop_repeated_lines`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, ascii_lower, let, saved, text_of

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: A line's identity: two independent 64-bit hashes of its key.
KEY = ["h1", "h2"]
#: Spark's setting to take a bucket of one file as sorted as it was written.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: h1, h2, doc_id, row, pos."""
    lines = docs.select("doc_id", row_key(text_of()).alias("row"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos")


class Runs:
    """The levels of runs; each run is a table of hashes, bucketed and sorted by KEY."""

    def __init__(self, spark, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]

    def store(self, hashes: DataFrame) -> str:
        """Rows of a bucket must be in one partition, so that a bucket is one sorted file."""
        name = f"tessera_run_{uuid.uuid4().hex}"
        hashes.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        return name

    def merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, by merge joins of their buckets: they share no hash, so each row has its key from one side."""
        return reduce(lambda a, b: a.hint("merge").join(b, KEY, "full"), [self.spark.table(name) for name in names])

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, hashes: DataFrame) -> None:
        self.levels[0].append(self.store(hashes.repartition(self.buckets, *KEY)))
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self.store(self.merged(level)))
            self.drop(level)
            level.clear()

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, row and the array of line positions that are dropped, for documents that lose a line."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", shares, 0.01)) if shares else set()
    number = sum(((F.col("doc_id") > c).cast("int") for c in sorted(cuts)), F.lit(0))
    # rows without doc_id go with the last batch: all others come before them
    lines = saved(hashed_lines(docs, min_chars).withColumn("batch", F.coalesce(number, F.lit(len(cuts)))), "batch")
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    dropped, before = [], spark.conf.get(SORTED_BUCKETS)
    spark.conf.set(SORTED_BUCKETS, "true")
    try:
        for batch in range(len(cuts) + 1):
            own = lines.where(F.col("batch") == batch).drop("batch")
            keys = own.groupBy(*KEY).agg(
                F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless")
            )
            keys = keys.withColumn("old", F.lit(False))
            for run in runs.tables():
                keys = keys.join(run.withColumn("held", F.lit(True)), KEY, "left").withColumn("old", F.col("old") | F.col("held").isNotNull()).drop("held")
            keys = saved(keys)
            hot = keys.where(F.col("old") | (F.col("first") < F.col("last")) | (F.col("nameless") & F.col("first").isNotNull()))
            late = F.col("old") | F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))
            dropped.append(saved(own.join(hot, KEY).where(late).select("doc_id", "row", "pos")))
            runs.add(keys.where(~F.col("old") & F.col("first").isNotNull()).select(*KEY))
    finally:
        spark.conf.set(SORTED_BUCKETS, before)
        for level in runs.levels:
            runs.drop(level)
    every = reduce(DataFrame.unionByName, dropped)
    return every.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))


def without_lines(text: Column, drops: Column) -> Column:
    """The text less the lines at these positions."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(drops.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines gone from text; n_lines, n_dropped (long) are added under these names, last."""
    names = docs.columns
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"in_{i}" for i, c in enumerate(names)])
    keyed = own.withColumns({"_text": text_of(), "_row": row_key(text_of())})
    drops = repeated_lines(docs.select("doc_id", "text"), **options).withColumnsRenamed({"doc_id": "d_id", "row": "d_row"})
    joined = keyed.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("_row") == F.col("d_row")), "left")
    return joined.select(
        *[
            (without_lines(F.col("_text"), F.col("drops")) if c == "text" else F.col(own.columns[i])).alias(c)
            for i, c in enumerate(names)
        ],
        F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
