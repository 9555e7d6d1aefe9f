"""Vector collections: stored tables by id that are read while they are written, and a manifest that says what they hold.

A stored collection is a folder. A build writes all rows as a base; an upsert writes the rows that it changes as a delta; both are
dealt into buckets by a hash of the id, as folders. A manifest row (JSON lines) names the version, its base, its deltas in order, the count
and the fingerprint of the inputs. It is written last, so what breaks off is never read, and a reader that has its
manifest row goes on with that version whatever is written meanwhile. Reading merges: of an id the newest delta counts, then the
base. When deltas pile up a new base is written (compaction); older versions stay readable until drop_unused takes them away.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.digests import summed_digest

MANIFEST = "version bigint, items bigint, fingerprint string, base bigint, deltas array<bigint>, buckets int"
#: Folders that a version's rows are dealt into, by default; deltas that are merged when read at most.
BUCKETS, MOST_DELTAS = 16, 8


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new, by id: doing it again changes nothing."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def selected(rows: DataFrame, ids: list[int] | None = None, **where: list) -> DataFrame:
    """Rows by ids and metadata values."""
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    for column, values in where.items():
        rows = rows.where(F.col(column).isin(values))
    return rows


def manifest(rows: DataFrame, name: str) -> DataFrame:
    """name, n, n_ids, digest."""
    return rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), summed_digest(F.col("id"), F.col("document")).alias("digest"))


def rebuild_status(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, status of wanted manifests: duplicate ids, missing, incomplete, stale or current."""
    have = stored.select("name", F.col("n").alias("n_have"), F.col("digest").alias("digest_have"))
    status = F.when(F.col("n") != F.col("n_ids"), "duplicate_ids").when(F.col("n_have").isNull(), "missing").when(F.col("n_have") != F.col("n"), "incomplete").when(F.col("digest_have") != F.col("digest"), "stale").otherwise("current")
    return wanted.join(have, "name", "left").select("name", status.alias("status"))


def term_records(terms: DataFrame) -> DataFrame:
    """id, document, kind of each term, as the collection wants it."""
    return terms.select(F.col("iri").alias("id"), F.concat_ws(". ", "name", "label").alias("document"), "kind", F.array("parent").alias("parents"))


def decision_records(current: DataFrame) -> DataFrame:
    """id, mappings, n of each decided concept."""
    one = F.concat_ws(" ", "relation", "dpv_iri")
    return current.where("decision = 'approved'").groupBy(F.col("concept_key").alias("id")).agg(F.sort_array(F.collect_set(one)).alias("mappings"), F.count(F.lit(1)).alias("n"))


def article_records(articles: DataFrame) -> DataFrame:
    """id, document, start, stop: one record per article."""
    return articles.select(F.concat(F.col("law").cast("string"), F.lit("/art-"), F.col("number").cast("string")).alias("id"), F.col("body").alias("document"), "start", "stop")


def newest(spark: SparkSession, path: str) -> Row | None:
    """The last manifest row of a stored collection; none: it isn't there."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("version")).first()


def bucket_of(ids, buckets: int):
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str, version: int, buckets: int) -> None:
    """One folder a bucket; the rows of a bucket come from all tasks that have some, so a large one is many files."""
    dealt = rows.withColumn("bucket", bucket_of(F.col("id"), buckets))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{version}")  # over what a broken build has left


def _record(spark: SparkSession, path: str, version: int, items: int, fingerprint: str, base: int, deltas: list[int], buckets: int) -> None:
    spark.createDataFrame([(version, items, fingerprint, base, deltas, buckets)], MANIFEST).write.mode("append").json(f"{path}/manifest")


def read_version(spark: SparkSession, path: str, at: Row, ids: list | None = None) -> DataFrame:
    """The rows of a manifest row's version. ids: only these, out of their buckets' folders."""
    base = spark.read.parquet(f"{path}/{at.base}")
    id_type = base.schema["id"].dataType
    deltas = [spark.read.schema(base.schema).parquet(f"{path}/{v}").withColumn("_version", F.lit(v)) for v in at.deltas]
    if ids is not None:
        wanted = spark.createDataFrame([(i,) for i in ids], f"id {id_type.simpleString()}")
        buckets = [r[0] for r in wanted.select(bucket_of(F.col("id"), at.buckets)).distinct().collect()]
        chosen = lambda rows: rows.where(F.col("bucket").isin(buckets) & F.col("id").isin(ids))
        base, deltas = chosen(base), [chosen(d) for d in deltas]
    base = base.drop("bucket")
    if not deltas:
        return base
    every = deltas[0]
    for delta in deltas[1:]:
        every = every.unionByName(delta)
    rest = [c for c in base.columns if c != "id"]
    last = every.groupBy("id").agg(F.max_by(F.struct(*rest), "_version").alias("x")).select("id", "x.*") if rest else every.select("id").distinct()
    return base.join(last.select("id"), "id", "left_anti").unionByName(last)


def read_collection(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    return read_version(spark, path, newest(spark, path), ids)


def _no_id_twice(rows: DataFrame) -> None:
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"an id stands more than once, such as {twice['id']}")


def build_collection(rows: DataFrame, path: str, fingerprint: str, buckets: int = BUCKETS) -> int:
    """Writes the rows as the collection's next base; an id twice is an error and nothing is written. Returns the count."""
    _no_id_twice(rows)
    spark, last = rows.sparkSession, newest(rows.sparkSession, path)
    version = 1 if last is None else last.version + 1
    _put(rows, path, version, buckets)
    items = spark.read.parquet(f"{path}/{version}").count()
    _record(spark, path, version, items, fingerprint, version, [], buckets)
    return items


def upsert_collection(rows: DataFrame, path: str) -> int:
    """Puts these rows in by id and returns the count of the collection. Only rows that differ from those stored are written, as a delta;
    the same rows again write nothing."""
    spark, last = rows.sparkSession, newest(rows.sparkSession, path)
    if last is None:
        return build_collection(rows, path, "")
    _no_id_twice(rows)
    held = read_version(spark, path, last)
    now = held.select(*[F.col(c).alias(f"_{c}") for c in held.columns])
    rows = rows.select(*held.columns)
    both = rows.join(now, F.col("id") == F.col("_id"), "left")
    same = F.lit(True)
    for c in held.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    version = last.version + 1
    _put(both.where(~same).withColumn("_new", F.col("_id").isNull()).select(*held.columns, "_new"), path, version, last.buckets)
    written = spark.read.schema(f"_new boolean, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in held.schema)}").parquet(f"{path}/{version}")
    changed, new = written.agg(F.count(F.lit(1)), F.count_if("_new")).first()
    if changed:
        _record(spark, path, version, last.items + new, last.fingerprint, last.base, [*last.deltas, version], last.buckets)
        if len(last.deltas) + 1 > MOST_DELTAS:
            compact_collection(spark, path)
    return last.items + new


def compact_collection(spark: SparkSession, path: str) -> None:
    """Base and deltas as one new base. Readers of the versions before are not touched."""
    last = newest(spark, path)
    if last.deltas:
        _put(read_version(spark, path, last), path, last.version + 1, last.buckets)
        _record(spark, path, last.version + 1, last.items, last.fingerprint, last.version + 1, [], last.buckets)


def drop_unused(spark: SparkSession, path: str) -> list[int]:
    """Removes the folders that the newest version doesn't need, and names them; no reader of an older version may be left."""
    last = newest(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit() and int(f.getPath().getName()) not in (last.base, *last.deltas))
    for version in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}"), True)
    return gone


def collection_state(spark: SparkSession, path: str, fingerprint: str) -> str:
    """missing, stale (of other inputs), incomplete (not the count of the manifest) or current."""
    last = newest(spark, path)
    if last is None:
        return "missing"
    if last.fingerprint != fingerprint:
        return "stale"
    return "current" if read_collection(spark, path).count() == last.items else "incomplete"


def ensure_collection(rows: DataFrame, path: str, fingerprint: str) -> str:
    """Builds the collection unless it is current; rows are computed only then. Returns the state before."""
    state = collection_state(rows.sparkSession, path, fingerprint)
    if state != "current":
        build_collection(rows, path, fingerprint)
    return state
