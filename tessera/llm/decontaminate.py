"""Benchmark decontamination in DataFrame functions only.

A document leaks an item if one of its item-sized windows (as many words as the item; the whole document if it is shorter)
has a weighted-shingle similarity of SIMILARITY or more with it: over five-word shingles with their multiplicities, the sum
of the smaller counts by the sum of the larger. Words are split at ASCII white space, A-Z lower-cased.

1. Windows. Similar windows hold at least (total + size) SIMILARITY / (1 + SIMILARITY) shingles of the item, so a window of
   the size of some items is a candidate if that many of its shingles are in the benchmark's table of (shingle, item size).
   Which item it may be is not asked: a template that all items share costs a row per item size, not per item. Only
   windows that begin at such a shingle (or end the document) are taken; any other shares no more with an item than the next
   one that does.
2. SimHash of 128 bits of each candidate window and each item. A similarity of 0.8 moves 19 bits on average (deviation 4: the longer the
   fingerprint, the smaller the share of it that the deviation is).
3. Multi-index Hamming blocks. A fingerprint is cut into eight blocks of 16 bits. Items stand in a table under their size, each block and all values within
   RADIUS // 8 bits of the block's own; fingerprints within RADIUS bits differ by that much at most in one block, so a window that
   looks up its own eight values meets all items within the radius. The balls are written for items, which are few, and a window asks eight
   times whatever the radius; of unlike items of its size it meets one in twelve. Pairs beyond the radius are dropped.
4. The exact similarity decides between what is fetched.
5. The radius covers the similarity 0.8 with three deviations. A window that no item within it leaks into is compared by its shingles, so
   it isn't lost to the fourth; these windows are few, as a window has enough shingles of items of its size to begin with.

Defined cases: a null or empty document has no leak; an item without words is never leaked; an item of under five words is
one shingle; rows that repeat a doc_id give one result a doc_id and item; a null doc_id stays null; empty tables give an
empty result; other columns are passed on untouched by `without_leaks`.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, let, saved, text_of, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 31
#: Blocks of a fingerprint and bits of each.
BLOCKS, WIDTH = 8, 16
#: The benchmark's shingles are broadcast up to this number (24 MB); beyond it they are shuffled.
BROADCAST_SHINGLES = 1_000_000


def shingles(text: Column, k: int) -> Column:
    """Hashes of all runs of k words, repeats included, in order; empty if there are fewer words."""

    def runs(hashes: Column) -> Column:
        return F.when(
            F.size(hashes) >= k,
            F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)), runs)


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp (two longs) from rows of keys and a shingle hash h, one row an occurrence. Each sum counts two bits, 32 apart."""
    low, both = 0xFFFFFFFF, F.lit((1 << 32) + 1)
    rows = rows.withColumn("h2", F.xxhash64("h"))
    lanes = [F.sum(F.shiftright(h, b).bitwiseAND(both)).alias(f"{h}_{b}") for h in ("h", "h2") for b in range(32)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_h"), *lanes)
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
    none = F.lit(0).cast("bigint")

    def fold(counts: Column, n: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(31)),
            none,
            lambda acc, b: acc.bitwiseOR(F.when(2 * F.get(counts, b).bitwiseAND(F.lit(low)) > n, one(b)).otherwise(none)).bitwiseOR(
                F.when(2 * F.shiftrightunsigned(F.get(counts, b), 32) > n, one(b + 32)).otherwise(none)
            ),
        )

    packed = sums.select(*keys, "n_h", *[F.array(*[f"{h}_{b}" for b in range(32)]).alias(f"c_{h}") for h in ("h", "h2")])
    return packed.select(*keys, F.array(fold(F.col("c_h"), F.col("n_h")), fold(F.col("c_h2"), F.col("n_h"))).alias("fp"))


def blocks(fp: Column) -> Column:
    """array of (block, value): the fingerprint's blocks."""
    per_long = 64 // WIDTH
    value = lambda i: F.shiftrightunsigned(F.get(fp, F.lit(i // per_long)), WIDTH * (i % per_long)).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("block"), value(i).alias("value")) for i in range(BLOCKS)])


def ball(spark, radius: int) -> DataFrame:
    """mask: all ways to flip up to `radius` of a block's bits; 697 rows at radius 3."""
    masks = [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in combinations(range(WIDTH), r)]
    return spark.createDataFrame([(m,) for m in masks], "mask int")


def distance_of(one: str, other: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(2)])


def met_by_blocks(prints: DataFrame, item_prints: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """keys, item, distance of all windows and items of one size that stand under one block's value; a pair stands once for each such block."""
    entry = ["k", "total", "block", "value"]
    asked = prints.select(*keys, "fp", F.inline(blocks(F.col("fp"))))
    table = item_prints.select("item", "k", "total", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"))))
    near = table.join(F.broadcast(ball(prints.sparkSession, radius // BLOCKS))).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    return asked.join(near, entry).select(*keys, "item", distance_of("fp", "item_fp").alias("distance"))


def items_of(benchmark: DataFrame, shingle: int) -> DataFrame:
    """item_id, n, k, total, hashes of every item with a word."""
    items = benchmark.select(F.col("item_id"), ascii_lower(text_of()).alias("text")).withColumn("n", F.size(words_of(F.col("text")))).where("n > 0")
    by_size = reduce(lambda c, k: c.when(F.least("n", F.lit(shingle)) == k, shingles(F.col("text"), k)), range(1, shingle + 1), F)
    return items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "n", F.least("n", F.lit(shingle)).alias("k"), by_size.alias("hashes")
    ).withColumn("total", F.size("hashes"))


def nothing_found(docs: DataFrame) -> DataFrame:
    empty = "doc_id bigint, row bigint, item_id bigint, start_word int, n_words int, similarity double, distance int"
    return docs.sparkSession.createDataFrame([], empty)


def candidate_windows(docs: DataFrame, items: DataFrame, ks: list[int], small: bool, similarity: float) -> DataFrame:
    """doc_id, row, k, total, start, window (its hashes): the windows that may be similar to an item of k and total."""
    seeds = items.select("k", "total", F.explode("hashes").alias("h")).distinct()
    seeds = F.broadcast(seeds) if small else seeds
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    hits = [rows.select("doc_id", "row", F.posexplode(shingles(F.col("text"), k)).alias("pos", "h")).join(seeds.where(F.col("k") == k), "h") for k in ks]
    hits = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "row", "k", "total").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # a document shorter than the item has `at` within its own length; the bound for its size is checked below
    enough = saved(hits.where(F.size("at") >= F.col("total") * similarity - 1e-6))

    wanted = enough.select(F.col("doc_id").alias("d_id"), F.col("row").alias("d_row"), "k", "total", "at").hint("shuffle_hash")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row") == F.col("d_row")))
    by_size = reduce(lambda c, k: c.when(F.col("k") == k, shingles(F.col("text"), k)), ks, F)
    cut = texts.select("doc_id", "row", "k", "total", "at", by_size.alias("hashes")).dropDuplicates(["doc_id", "row", "k", "total"])
    cut = cut.withColumn("size", F.least("total", F.size("hashes")))
    cut = cut.withColumn("need", F.ceil((F.col("total") + F.col("size")) * similarity / (1 + similarity) - 1e-6).cast("int"))
    # the window from the i-th hit (or from the last possible start) holds `need` hits if the hit need - 1 further on is within it
    last = F.size("hashes") - F.col("size")
    starts = F.transform("at", lambda x, i: F.when(F.get("at", F.greatest(i, i + F.col("need") - 1)) < F.least(x, last) + F.col("size"), F.least(x, last)))
    ends = F.size(F.filter("at", lambda x: x >= last)) >= F.col("need")
    starts = F.array_distinct(F.array_compact(F.concat(starts, F.array(F.when(ends, last)))))
    cut = cut.select("doc_id", "row", "k", "total", "size", "hashes", F.explode(starts).alias("start"))
    return cut.select("doc_id", "row", "k", "total", "start", F.expr("slice(hashes, start + 1, size)").alias("window"))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """doc_id, row, item_id, start_word, n_words, similarity, distance: the best window (the first of equals) of each leak.

    With a radius only those whose fingerprints are within it; without, RADIUS is taken and what lies beyond it is compared, too (distance null).
    """
    items = saved(items_of(benchmark, shingle))
    counted = items.groupBy("k").agg(F.sum("total").alias("n")).collect()  # a row for each k, at most `shingle`
    if not counted:
        return nothing_found(docs)
    small = sum(r.n for r in counted) <= BROADCAST_SHINGLES
    windows = saved(candidate_windows(docs, items, sorted(r.k for r in counted), small, similarity))

    # fingerprints within the radius, by blocks; a shared template that many items of one size hold is dealt out by AQE
    keys = ["doc_id", "row", "k", "total", "start"]
    occurrences = windows.select(*keys, F.explode("window").alias("h"))
    item_rows = items.select("item", "k", "total", F.explode("hashes").alias("h"))
    fetched = met_by_blocks(saved(simhash(occurrences, keys)), saved(simhash(item_rows, ["item", "k", "total"])), keys, RADIUS if radius is None else radius)
    near = fetched.where(F.col("distance") <= (RADIUS if radius is None else radius)).distinct()

    # the exact similarity of what was fetched
    named = {key: f"s_{key}" for key in keys}
    on = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(other)) if key == "doc_id" else F.col(key) == F.col(other) for key, other in named.items()])
    pairs = windows.join(near.withColumnsRenamed(named), on).select(*keys, "item", "distance", "window")
    item_counts = saved(item_rows.groupBy("item", "k", "total", "h").agg(F.count(F.lit(1)).alias("item_c")))
    scored = saved(scored_pairs(pairs, keys, item_counts, ["item", "h"], similarity))

    # windows without a leak so far may lie just beyond the radius: theirs is compared by shingles with the items that share some
    found = scored.select(*[F.col(key).alias(other) for key, other in named.items()]).distinct()
    if radius is None:
        rest = windows.join(found, on, "left_anti").select(*keys, F.lit(None).cast("int").alias("distance"), "window")
        scored = scored.unionByName(scored_pairs(rest, keys, item_counts, ["k", "total", "h"], similarity))
    best = F.max_by(F.struct("start", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("w")
    kept = scored.groupBy("doc_id", "row", "item").agg(best)
    known = items.select("item", "item_id", F.col("n").cast("int").alias("n_words"))
    return kept.join(F.broadcast(known) if small else known, "item").select("doc_id", "row", "item_id", F.col("w.start").alias("start_word"), "n_words", "w.similarity", "w.distance")


def scored_pairs(pairs: DataFrame, keys: list[str], item_counts: DataFrame, met: list[str], similarity: float) -> DataFrame:
    """keys, item, distance, similarity of the windows and items that are similar enough. met: with the item, pairs are given; without it, items that share a shingle."""
    own = [*keys, *(["item"] if "item" in met else []), "distance"]
    counts = pairs.select(*own, F.size("window").alias("size"), F.explode("window").alias("h")).groupBy(*own, "size", "h").agg(F.count(F.lit(1)).alias("c"))
    table = item_counts.drop(*[c for c in ("k", "total") if c not in met])
    shared = counts.join(table, met).groupBy(*keys, "item", "distance", "size").agg(F.sum(F.least("c", "item_c")).alias("shared"))
    score = F.col("shared") / (F.col("total") + F.col("size") - F.col("shared"))
    return shared.select(*keys, "item", "distance", score.alias("similarity")).where(F.col("similarity") >= similarity)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs less the rows that leak an item."""
    found = leaks(docs.select("doc_id", "text"), benchmark, **options)
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct().hint("shuffle_hash")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text) == gone["gone_row"])
    return docs.join(gone, same, "left_anti")
