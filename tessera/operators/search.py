"""Search for a part of a text by an index of trigrams with their positions.

A posting is a trigram, a row's key, a field and the places where the trigram stands there, in lower case. A search reads the
postings of its own trigrams alone, shifts their places by the trigram's place in the searched text, and keeps the places that all have:
there the text stands, so no text is read again. Postings lie in folders by a hash of the trigram. A search of one or two
characters has no trigram; for it the texts' ends are padded and all trigrams that begin with it are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAM = 64, 3
PAD = "\x00" * (GRAM - 1)
#: Fields by the class of a hit: names and labels come before definitions.
FIELDS = {"name": 0, "label": 0, "definition": 1}


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, fields: dict[str, int] | None = None, keep: tuple[str, ...] = ("seq", "kind")) -> DataFrame:
    """gram, key, hit, field, places (from 0) and the columns `keep` of rows (key, the fields)."""
    fields = fields or FIELDS
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(hit).alias("hit"), F.lower(F.col(f)).alias("text")) for f, hit in fields.items()])
    own = rows.select("key", *keep, F.inline(texts)).where("text <> ''")
    places = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.struct(i.alias("at"), F.substring(F.concat("text", F.lit(PAD)), i + 1, F.lit(GRAM)).alias("gram")))
    grams = own.withColumn("places", places).select("key", *keep, "field", "hit", F.inline("places"))
    return grams.groupBy("gram", "key", *keep, "field", "hit").agg(F.sort_array(F.collect_list("at")).alias("places"))


def write_postings(rows: DataFrame, path: str, fields: dict[str, int] | None = None, keep: tuple[str, ...] = ("seq", "kind")) -> None:
    found = postings(rows, fields, keep).withColumn("bucket", _bucket(F.col("gram")))
    found.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read_grams(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The postings that a search reads, with shift: the trigram's place in the text."""
    text, index = text.lower(), spark.read.parquet(path)
    if len(text) < GRAM:
        return index.where(F.col("gram").startswith(text)).withColumn("shift", F.lit(0))
    grams = [(text[i : i + GRAM], i) for i in range(len(text) - GRAM + 1)]
    named = spark.createDataFrame(grams, "gram string, shift int")
    buckets = [r[0] for r in named.select(_bucket(F.col("gram"))).distinct().collect()]
    return index.where(F.col("bucket").isin(buckets) & F.col("gram").isin([g for g, _ in grams])).join(F.broadcast(named), "gram")  # a row a trigram of the searched text


def found_by_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """key, hit, seq, kind of all rows that hold the text (in any case of letters); hit: the least class of a field that does."""
    text = text.strip()
    read = read_grams(spark, path, text)
    starts = read.select("key", "seq", "kind", "field", "hit", F.explode(F.transform("places", lambda x: x - F.col("shift"))).alias("start"))
    needed = max(1, len(text) - GRAM + 1)
    at = starts.groupBy("key", "seq", "kind", "field", "hit", "start").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= needed) & (F.lit(text) != ""))
    return at.groupBy("key", "seq", "kind").agg(F.min("hit").alias("hit"))


def search_by_index(spark: SparkSession, path: str, text: str, kinds: list[str] | None = None, limit: int = 15) -> DataFrame:
    """key, hit of the first `limit` matches: in name or label first, then in the definition, each by position. A top-k report."""
    found = found_by_index(spark, path, text)
    if kinds is not None:
        found = found.where(F.col("kind").isin(kinds))
    return found.orderBy("hit", "seq").limit(limit).select("key", "hit")
