"""All pairs of texts whose word-shingle sets have a Jaccard similarity of at least a given value, and their components.

1. SimHash with multi-index hashing. Each text's fingerprint is made of its shingles' hashes, as op8's of repeats: 64 bits that
   are compared, and SEGMENTS segments of as many bits as the number of texts makes selective. A text stands in one table per
   segment, under the segment's value, with its 64 bits; texts that meet there and are within radius_of bits of each other have
   their similarity computed. In an entry of up to DENSE texts all meet; in a denser one each meets the text that is in most
   dense entries' company (the text that a group's copies come from).
2. What fingerprints miss: a pair right at the threshold has a part of its bits in no common segment. So components of step 1 are
   held against each other by multi-index hashing over the shingle sets themselves, which misses nothing (below).

In step 2 a set is the fingerprint, the hash space of the
shingles is cut into parts, and a text is written to a table once for every part, keyed by the part and what the set holds
of it. Sets of similarity s and sizes up to u differ in at most radius = 2u(1 - s)/(1 + s) shingles, and a differing shingle
changes one part; with radius + spare parts at least `spare` parts are therefore equal, and no pair is missed. Empty parts
are only written by texts with `spare` empty parts or more: a pair that shares nothing else has that many on both sides.
Sizes are cut into levels of ratio s, so partners are in one level or in neighbouring ones, and a text is written to its own
level and, where it can have a partner there, to the next.

Entries of texts of one component need nothing more. The others are verified in two steps, neither of which makes all pairs of
an entry:

a. Stars. In each entry the member whose entries are shared most (the hub) is paired
   with the others. Pairs are counted over their entries, and those with as many as `spare` guarantees are verified.
b. The rest. Texts that still share enough entries with texts of other components are open. Their shingles are ordered by the
   number of open texts that hold them, rarest first. Of a similar pair, one of the smaller text's first (1 - 2s / (1 + s)) n + 1
   shingles is one of the larger text's first (1 - s) n + 1; pairs that meet so, of different components, at places that leave
   enough shingles to share, are verified. A copy too far from the hub has more shingles of its own than it looks up, so a
   large group of copies brings few such pairs.

No step loses a pair of the threshold between different components. The similarity is computed from the texts' words.

Texts are known by their 64-bit hash (exact but for a collision). Fewer words than a shingle make one shingle of them all;
texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, text_of
from tessera.llm.simhash import _LOWER, SEED, components

SHINGLE = 5
SIMILARITY = 0.8
#: Segments of a fingerprint; each has a table.
SEGMENTS = 32
#: Texts of one table entry that all meet; in denser entries they meet one.
DENSE = 16
#: Bits of a set's entry: a set more under an entry by chance is only one more to verify.
ENTRY_BITS = 48
#: Times that texts without enough shared entries are taken off before the rest is looked at.
PEELS = 2


def shingle_set(text: str, shingle: int) -> set[bytes]:
    words = text.encode().translate(_LOWER).split()
    k = min(shingle, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(x: set[bytes], y: set[bytes], least: Fraction) -> bool:
    shared = len(x & y)
    union = len(x) + len(y) - shared
    return shared * least.denominator >= union * least.numerator


@cache
def levels_of(size: int, least: Fraction) -> tuple[tuple[int, int, int], ...]:
    """(level's first size, parts, spare) of each level that a set of this size is written to."""
    low = 1
    while size > low / least:
        low = low * least.denominator // least.numerator + 1
    found = []
    for first in (low, low * least.denominator // least.numerator + 1):
        if size >= first * least:
            top = first * least.denominator // least.numerator
            radius = int(2 * top * (1 - least) / (1 + least))
            spare = 3 + radius // 8 if radius else 1
            found.append((first, radius + spare, spare))
    return tuple(found)


def mixed(x: np.ndarray) -> np.ndarray:
    """Of unsigned 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def width_of(texts: int) -> int:
    """Bits of a segment: an entry holds four texts by chance at most, however many there are."""
    return min(max(texts.bit_length() - 2, 8), 32)


def radius_of(similarity: float) -> int:
    """Of 64 bits, as many as a pair of this similarity has different, and 3.5 deviations more."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(64 * share + 3.5 * (64 * share * (1 - share)) ** 0.5)


def fingerprint_of(hashes: np.ndarray, width: int) -> tuple[int, np.ndarray]:
    """The 64 bits that are compared (signed) and the segments' values. A bit is 1 if it is set in over half of the hashes."""
    words = -(-SEGMENTS * width // 64)
    steps = np.arange(words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros((words + 1) * 64, np.int64)
    for at in range(0, len(hashes), 1024):
        block = mixed(hashes[at : at + 1024, None] + steps)
        counts += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    ones = 2 * counts > len(hashes)
    values = ones[64 : 64 + SEGMENTS * width].reshape(SEGMENTS, width) @ (1 << np.arange(width, dtype=np.int64))
    return int(np.packbits(ones[:64], bitorder="little").view(np.int64)[0]), values


def hashes_of(shingles: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def segment_tables(texts: DataFrame, shingle: int, width: int) -> DataFrame:
    """node, n (shingles), word (the 64 bits), entry (segment and its value) from node, text: a row a segment."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = np.arange(SEGMENTS, dtype=np.int64) << width
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in piece.column(1)]
                words, values = zip(*(fingerprint_of(hashes_of(s), width) for s in sets), strict=True)
                columns = [piece.column(0).to_numpy(), np.array([len(s) for s in sets], np.int32), np.array(words, np.int64)]
                arrays = [pa.array(np.repeat(c, SEGMENTS)) for c in columns] + [pa.array(np.concatenate([segments + v for v in values]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "word", "entry"])

    return texts.select("node", "text").mapInArrow(batches, "node bigint, n int, word bigint, entry bigint")


def fetched(tables: DataFrame, similarity: float, dense: int = DENSE) -> DataFrame:
    """a, b: texts of one table entry whose sizes and 64 bits allow a similar pair; from dense entries stars."""

    def near(x, y):
        sized = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * similarity - 1e-6
        return sized & (F.bit_count(x["word"].bitwiseXOR(y["word"])) <= radius_of(similarity))

    row = F.struct("node", "n", "word")
    entry = Window.partitionBy("entry")
    after = F.collect_list(row).over(entry.orderBy("node").rowsBetween(1, dense - 1))
    met = tables.withColumns({"held": F.count(F.lit(1)).over(entry), "after": after}).where("held > 1")
    met = met.withColumn("after", F.when(F.col("held") <= dense, F.filter("after", lambda y: near(row, y))).otherwise(F.array().cast("array<struct<node:bigint,n:int,word:bigint>>")))
    met = saved(met.where((F.col("held") > dense) | (F.size("after") > 0)))
    pairs = met.select(F.col("node").alias("a"), F.explode("after.node").alias("b"))

    crowded = met.where(F.col("held") > dense).select("entry", row.alias("x"), "held")
    company = crowded.groupBy("x").agg(F.sum("held").alias("company"))
    centres = crowded.join(company, "x").groupBy("entry").agg(F.max(F.struct("company", "x")).getField("x").alias("y"))
    stars = crowded.join(centres, "entry").where((F.col("x.node") != F.col("y.node")) & near(F.col("x"), F.col("y"))).select("x.node", "y.node").toDF("a", "b")
    return pairs.unionByName(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def entries_of(shingles: set[bytes], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the table entries of a set; with each the number of entries that it shares with any similar set at least."""
    if not shingles:
        return np.zeros(1, np.uint64), np.ones(1, np.int32)
    hashes = hashes_of(shingles)
    spread, keys, needs = mixed(hashes), [], []
    for first, parts, spare in levels_of(len(shingles), least):
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, starts = np.unique(part[order], return_index=True)
        held = np.zeros(parts, np.uint64)
        held[used] = mixed(np.add.reduceat(spread[order], starts))
        names = mixed(np.arange(parts, dtype=np.uint64) + np.uint64(first << 32))
        empty = parts - len(used)
        written = np.arange(parts) if empty >= spare else used
        keys.append(mixed(held[written] + names[written]) >> np.uint64(64 - ENTRY_BITS))
        needs.append(np.full(len(written), spare if empty >= spare else spare - empty, np.int32))
    return np.concatenate(keys), np.concatenate(needs)


def entries(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, n (shingles), need (shared entries of a similar pair), entry from node, text."""
    least = Fraction(str(similarity))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sets = [shingle_set(t, shingle) for t in piece.column(1).to_pylist()]
                keys, needs = zip(*(entries_of(s, least) for s in sets), strict=True)
                counts = [len(k) for k in keys]
                nodes = np.repeat(piece.column(0).to_numpy(), counts)
                sizes = np.repeat(np.array([len(s) for s in sets], np.int32), counts)
                arrays = [pa.array(nodes), pa.array(sizes), pa.array(np.concatenate(needs)), pa.array(np.concatenate(keys).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "need", "entry"])

    return texts.select("node", "text").mapInArrow(batches, "node bigint, n int, need int, entry bigint")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts are similar enough."""
    least = Fraction(str(similarity))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            last, held, keep = None, set(), []
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for b, x, y in zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if b != last:
                        last, held = b, shingle_set(y, shingle)
                    keep.append(alike(shingle_set(x, shingle), held, least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(batches, "a bigint, b bigint")


def node_of(text):
    return F.xxhash64(text)


def starred(met: DataFrame, similarity: float) -> DataFrame:
    """a, b: members of entries (entry, node, n, need, hub) with their hubs, where sizes and shared entries allow a similar pair."""
    member = F.struct("node", "n", "need")
    centre = F.min(F.struct(-F.col("hub"), member.alias("of"))).over(Window.partitionBy("entry")).getField("of")
    pairs = met.select(member.alias("x"), centre.alias("y")).where("x.node <> y.node")
    sized = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-6
    shared = pairs.where(sized).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    counted = shared.agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x.need", "y.need")).alias("need"))
    return counted.where("shared >= need").select("a", "b")


def between(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with each member's root, only entries of several components."""
    same = Window.partitionBy("entry")
    met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return met.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same)}).where("low <> high").drop("low", "high")


def opened(met: DataFrame, roots: DataFrame) -> DataFrame:
    """node, n, root of the texts with as many entries as a similar pair shares, counting entries of several components only."""
    same = Window.partitionBy("entry")
    met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(PEELS):
        met = met.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same)}).where("low <> high").drop("low", "high")
        of_node = Window.partitionBy("node")
        met = saved(met.withColumns({"has": F.count(F.lit(1)).over(of_node), "least": F.min("need").over(of_node)}).where("has >= least").drop("has", "least"))
    return met.select("node", "n", "root").distinct()


def hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """node, h: the hashes of each text's shingles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                found = [hashes_of(shingle_set(t, shingle)) for t in piece.column(1).to_pylist()]
                nodes = np.repeat(piece.column(0).to_numpy(), [len(h) for h in found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found).view(np.int64))], names=["node", "h"])

    return texts.select("node", "text").mapInArrow(batches, "node bigint, h bigint")


def rest(open_: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b of different components that may be similar, by their rarest shingles."""
    rows = saved(hashed(texts.join(open_.select("node"), "node", "left_semi"), shingle))
    often = saved(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ordered = rows.join(often, "h", "left").join(open_, "node").withColumn("df", F.coalesce("df", F.lit(1)))
    ordered = ordered.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "h")))
    first = saved(ordered.where((F.col("df") > 1) & (F.col("place") <= F.floor((1 - similarity) * F.col("n") + 1e-6) + 1)).select("h", "node", "n", "root", "place"))
    one = first.where(F.col("place") <= F.floor((1 - 2 * similarity / (1 + similarity)) * F.col("n") + 1e-6) + 1)
    one, other = one.select("h", F.struct("node", "n", "root", "place").alias("x")), first.select("h", F.struct("node", "n", "root", "place").alias("y"))
    ordered_pair = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    sized = F.col("x.n") >= F.col("y.n") * similarity - 1e-6
    left = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = left >= (F.col("x.n") + F.col("y.n")) * similarity / (1 + similarity) - 1e-6
    met = one.join(other, "h").where(ordered_pair & (F.col("x.root") != F.col("y.root")) & sized & enough)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def edges_of(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def fingerprint_pairs(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b of the different texts (node, text) that fingerprints bring together, to be verified."""
    return saved(fetched(segment_tables(texts, shingle, width_of(texts.count())), similarity))


def similar_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node (node_of the text), root for every different text of docs that has a near copy."""
    text = text_of()
    texts = saved(docs.select(node_of(text).alias("node"), text.alias("text")).dropDuplicates(["node"]))
    pairs = fingerprint_pairs(texts, shingle, similarity)
    met = entries(texts, shingle, similarity).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("entry")))
    met = saved(met.where("held > 1").drop("held"))
    # every similar pair shares entries, so the others' texts are not read again
    texts = saved(texts.join(met.select("node").distinct(), "node", "left_semi"))
    roots = components(verified(pairs, texts, shingle, similarity))

    met = saved(between(met, roots))
    texts = saved(texts.join(met.select("node").distinct(), "node", "left_semi"))
    hubs = met.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("entry"))).groupBy("node").agg(F.sum("held").alias("hub"))
    stars = verified(saved(starred(met.drop("root").join(hubs, "node"), similarity)), texts, shingle, similarity)
    roots = components(edges_of(roots).unionByName(stars))
    more = verified(saved(rest(saved(opened(met.drop("root"), roots)), texts, shingle, similarity)), texts, shingle, similarity)
    return components(edges_of(roots).unionByName(more))
