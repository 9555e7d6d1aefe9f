"""SimHash near-dedup: fingerprints, multi-index hashing for all links, components.

Fingerprints are made text by text in Arrow batches. Exact copies are one fingerprint throughout. Links (at most `radius`
differing bits) come from multi-index hashing: a fingerprint is cut into `segments` segments and stands in one table per
segment, under the segment's value. Two fingerprints within the radius have a segment in which they differ by
radius // segments bits at most, so each fingerprint looks up its segments' Hamming balls of that radius, fetches what
stands there, and the complete distance is verified.

A table entry that holds more than DENSE fingerprints (near copies that share half their bits) is not fetched: its members
and those that ask for it are written under all values within radius / 2 bits of the whole fingerprint: two within the radius
meet there, and all that meet are within the radius, so a star stands for their pairs. Nothing is dropped.

Defined cases: a null or empty text has the fingerprint zero and is linked like any other; a null doc_id is in a component
but never names it (a component of such rows alone has a null id); repeated rows give repeated rows; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, text_of

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 2
BITS = 64
SALTS = 32
#: Fingerprints of one table entry that are fetched at most; denser entries go the other way.
DENSE = 64


def fingerprint(text: str | None) -> int:
    """Of the whole text, as a signed long. A bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(ones.view(np.int64)[0])


#: A-Z to a-z in bytes; no byte of another character is one of these.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) per row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(batches, "doc_id bigint, fp bigint")


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def _masks(bits: range, radius: int) -> list[int]:
    """All ways to flip up to radius of the bits."""
    return [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in combinations(bits, r)]


def _flipped(column: Column, masks: list[int]) -> Column:
    return F.array(*[column.bitwiseXOR(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """a, b (a > b): fingerprints within radius bits of each other; from dense table entries stars that connect the same."""
    if radius % 2:
        raise ValueError("the radius is an even number of bits")
    width = BITS // segments
    spans = [range(i * width, BITS if i + 1 == segments else (i + 1) * width) for i in range(segments)]
    distinct = saved(fps.select("fp").distinct())
    wholes = [sum(1 << b for b in span) for span in spans]
    kept = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in wholes]
    table = distinct.select("fp", F.posexplode(F.array(*kept)).alias("segment", "value"))
    asked = [F.struct(F.lit(i).alias("segment"), _flipped(kept[i], [m])[0].alias("value")) for i, span in enumerate(spans) for m in _masks(span, radius // segments)]
    asked = distinct.select(F.col("fp").alias("a"), F.inline(F.array(*asked)))

    crowded = saved(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("segment", "value"))
    entry = ["segment", "value"]
    fetched = asked.join(table.join(crowded, entry, "left_anti").withColumnRenamed("fp", "b").hint("shuffle_hash"), entry)
    near = fetched.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))

    members = asked.join(crowded, entry, "left_semi").select(F.col("a").alias("fp")).distinct()
    balls = members.select("fp", F.explode(_flipped(F.col("fp"), _masks(range(BITS), radius // 2))).alias("ball"))
    met = balls.withColumn("b", F.min("fp").over(Window.partitionBy("ball"))).where(F.col("fp") != F.col("b"))
    stars = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius).select(F.col("fp").alias("a"), "b")
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges a-b.

    Large-star and small-star steps in turn, each a join and a grouping; the edges of a round are written to the shared
    folder. Ends when a round changes nothing, after about log(n) rounds.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        edges = saved(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) per row of docs."""
    fps = saved(fingerprints(docs))
    roots = components(links(fps))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = saved(named)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    per_fp = named.join(names, "root").select("fp", "component_id")
    return fps.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts: that of least doc_id (nulls last) and, among its rows, of least row hash."""
    from tessera.llm.near_sets import node_of, similar_components

    def row_of(docs: DataFrame):
        fields = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        values = [docs[f"`{name}`"] for name in fields]
        return F.xxhash64(*values, *[v.isNull() for v in values])

    doc_id = docs["doc_id"].cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), row_of(docs).alias("row"), node_of(text_of()).alias("node"))
    roots = similar_components(docs.select("text"), shingle, similarity)
    rows = rows.groupBy("doc_id", "row", "node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node", "left")
    rows = rows.select("doc_id", "row", "n", F.coalesce("root", "node").alias("root"))
    firsts = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"), F.sum("n").alias("size"))
    # a group may hold a third of all rows: its rows are dealt over SALTS tasks, each with a copy of the group's one line
    firsts = firsts.where("size > 1").select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    ranked = rows.join(firsts, ["root", "salt"]).withColumn("first", F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row")))
    ranked = saved(ranked.where("not first or n > 1").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "first"))
    gone = ranked.drop("first").hint("shuffle_hash")
    alone = docs.join(gone, doc_id.eqNullSafe(gone["gone_id"]) & (row_of(docs) == gone["gone_row"]), "left_anti")

    # Of equal rows all went; one comes back.
    equal = ranked.where("first").drop("first")
    named = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), doc_id.alias("doc_id"), row_of(docs).alias("row"))
    one = named.join(equal, named["doc_id"].eqNullSafe(equal["gone_id"]) & (named["row"] == equal["gone_row"]), "left_semi")
    return alone.unionByName(one.dropDuplicates(["doc_id", "row"]).select("doc.*"))
