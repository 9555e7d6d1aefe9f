"""Removal of repeated strings of LENGTH bytes, judged on the input: suffixes, their Burrows-Wheeler transform and LCPs.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this document or another. One suffix
array of the whole corpus would have to be sorted through several shuffles of many times the input. It is cut instead into
parts that can't share a repeat:

1. Every window of LENGTH bytes has an anchor, its GRAM-byte gram of least hash (the last of equals). Equal windows have
   equal anchors, so only windows of one gram need comparing. The windows that one anchor owns are a run of neighbouring
   starts; together they are the anchor's context, some 70 windows on average.
2. Grams found once are settled: no window of theirs repeats. So are contexts found twice or more as a whole (by 128 bits
   of hashes): all windows of theirs repeat.
3. What is left are grams with several different contexts, at the ends of repeats. Blocks of such grams get a suffix array
   and a Burrows-Wheeler transform; breadth-first backward extension sets the common prefixes by increasing value, interval
   by interval, and stops at LENGTH: boundaries not set by then are common prefixes of LENGTH or more, so their windows
   repeat. A gram of more than HOT contexts isn't put in one block: its windows are counted by their 128-bit hashes.
4. The marked windows go back to their documents, whose covered bytes are removed.

Texts cross the network compressed. A row of the shuffles stands for some 70 bytes of text; groups are counted with partial
sums, and no task holds a group of unbounded size.

Defined cases: a null or empty text has no bytes; matches never cross documents; rows that repeat a doc_id are documents of
their own, so two equal rows of LENGTH bytes or more remove each other; a null doc_id stays null; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, text_of

LENGTH, GRAM = 200, 64
#: Contexts of one gram beyond which its windows are counted by hashes; bytes of a block of contexts.
HOT, BLOCK_BYTES = 2048, 400_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)


@functools.lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below size."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        row = np.full(size, factor, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Hashes:
    """Polynomial hashes of all substrings of a text."""

    def __init__(self, raw: np.ndarray, base: int):
        size = 1 << max(16, int(len(raw) + 1).bit_length())
        up, self.down = powers(base, size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def contexts(raw: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """g, c, first, count, offset of each anchor of the text: gram hash, context hash, first window, windows, anchor's place."""
    windows = len(raw) - LENGTH + 1
    if windows < 1:
        return None
    a, b = Hashes(raw, BASES[0]), Hashes(raw, BASES[1])
    width = LENGTH - GRAM + 1
    h = a.of(np.arange(len(raw) - GRAM + 1), GRAM)
    least, span = h, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    enters = least == h[width - 1 :]
    changed = np.ones(windows, bool)
    changed[1:] = least[1:] != least[:-1]
    first = np.flatnonzero(enters | changed)
    anchor = first + width - 1
    for at in range(0, len(first), 4096):  # the least gram that was there before: looked up
        part = np.flatnonzero(~enters[first[at : at + 4096]]) + at
        if len(part):
            near = h[first[part][:, None] + np.arange(width - 1, -1, -1)]
            anchor[part] = first[part] + width - 1 - near.argmin(axis=1)
    count = np.diff(np.append(first, windows))
    offset = anchor - first
    shape = (count.astype(np.uint64) << np.uint64(8)) | offset.astype(np.uint64)
    c = mixed(b.of(first, count + LENGTH - 1) ^ (shape * np.uint64(BASES[0])))
    return h[anchor].view(np.int64), c.view(np.int64), first, count, offset


def packed_places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The run of windows in one long."""
    return (first.astype(np.int64) << 9) | count


def anchors(docs: DataFrame) -> DataFrame:
    """g, c, doc_id, row, place: one row per anchor of every text. row tells texts of one doc_id apart."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts, size = [], 0
            for doc_id, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = contexts(np.frombuffer((text or "").encode(), np.uint8))
                if found is None:
                    continue
                g, c, first, count, _ = found
                ids = pa.nulls(len(g), pa.int64()) if doc_id is None else pa.array(np.full(len(g), doc_id))
                parts.append(pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), ids, pa.array(np.full(len(g), row)), pa.array(packed_places(first, count))], names=["g", "c", "doc_id", "row", "place"]))
                size += len(g)
                if size > 50_000:
                    yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    parts, size = [], 0
            if parts:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return docs.mapInArrow(batches, "g bigint, c bigint, doc_id bigint, row bigint, place bigint")


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, row, data: the text's bytes, compressed for the shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in it:
            data = [packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "row", "data"])

    return docs.mapInArrow(batches, "doc_id bigint, row bigint, data binary")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes by their first LENGTH symbols or more, by doubling from keys of several symbols."""
    size = len(text)
    bits = max(1, int(text.max()).bit_length())
    span = max(1, 63 // bits)
    key = np.zeros(size, np.int64)
    for i in range(span):
        key <<= bits
        key[: max(0, size - i)] |= text[i:]
    order = np.argsort(key, kind="stable")
    while True:
        ranks = np.empty(size, np.int64)
        ranks[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        if span >= LENGTH or ranks[order[-1]] == size - 1:
            return order
        later = np.zeros(size, np.int64)
        later[: max(0, size - span)] = ranks[span:] + 1
        key = ranks * (size + 1) + later
        order = np.argsort(key, kind="stable")
        span *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each boundary of the suffix order (0 to size): is the common prefix across it LENGTH or more?

    Each string ends with a symbol of its own. Backward extension on the transform: an interval of
    the suffixes that start with w, and the symbols before them, give the intervals of the strings cw. The first interval
    to end at a boundary has its length as the common prefix there; intervals that end at a known one are dropped. Values
    rise by one a level; at LENGTH the boundaries that are still unknown are as long or longer.
    """
    size = len(text)
    before = text[order - 1]  # the transform; the first suffix wraps round to the text's last symbol, a separator
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    back = place[order - 1]  # where the suffix one symbol longer stands
    known = np.zeros(size + 1, bool)
    known[0] = known[size] = True
    lows, highs = np.array([0]), np.array([size])
    for _ in range(LENGTH):
        widths = highs - lows
        owner = np.repeat(np.arange(len(lows)), widths)
        inside = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths) + lows[owner]
        symbols, to = before[inside], back[inside]
        turn = np.argsort(to)
        symbols, to, owner = symbols[turn], to[turn], owner[turn]
        starts = np.flatnonzero(np.append(True, (np.diff(to) != 1) | (np.diff(symbols) != 0) | (np.diff(owner) != 0)))
        lows, highs = to[starts], to[np.append(starts[1:], len(to)) - 1] + 1
        new = ~known[highs]
        known[highs] = True
        lows, highs = lows[new], highs[new]
        if not len(lows):
            break
    return ~known


def repeated_starts(strings: list[bytes]) -> list[np.ndarray]:
    """Per string the starts of windows of LENGTH bytes that another place in these strings has too."""
    count = len(strings)
    parts = []
    for i, s in enumerate(strings):
        parts += [np.frombuffer(s, np.uint8).astype(np.int64) + count, np.array([i])]
    text = np.concatenate(parts)
    order = suffix_array(text)
    long = long_prefixes(text, order)
    marked = np.zeros(len(text), bool)
    marked[order] = long[:-1] | long[1:]
    ends = np.cumsum([len(s) + 1 for s in strings])
    return [np.flatnonzero(marked[e - len(s) - 1 : e - 1]) for s, e in zip(strings, ends, strict=True)]


def in_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, row, starts from g, doc_id, row, place, context: blocks end where a gram does."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            found = repeated_starts([h[3] for h in held])
            starts = [(f + (h[2] >> 9)).tolist() for f, h in zip(found, held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(starts, pa.list_(pa.int64()))], names=["doc_id", "row", "starts"])

        for batch in it:
            for g, *own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != last and size >= BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
                held.append(own)
                size, last = size + len(own[3]), g
        if held:
            yield done()

    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(batches, "doc_id bigint, row bigint, starts array<bigint>").where(F.size("starts") > 0)


def by_window(rows: DataFrame) -> DataFrame:
    """The same for grams of many contexts: every window by its hashes, counted with partial sums."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc_id, row, place, context in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                raw = np.frombuffer(context, np.uint8)
                at = np.arange(place & 511)
                ids = pa.nulls(len(at), pa.int64()) if doc_id is None else pa.array(np.full(len(at), doc_id))
                w = [pa.array(Hashes(raw, base).of(at, LENGTH).view(np.int64)) for base in BASES]
                yield pa.RecordBatch.from_arrays([*w, ids, pa.array(np.full(len(at), row)), pa.array(at + (place >> 9))], names=["w1", "w2", "doc_id", "row", "start"])

    windows = rows.mapInArrow(batches, "w1 bigint, w2 bigint, doc_id bigint, row bigint, start bigint")
    twice = saved(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return windows.join(twice, ["w1", "w2"]).groupBy("doc_id", "row").agg(F.collect_set("start").alias("starts"))


def with_texts(docs: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """docs (compressed) joined with wanted by doc_id and row."""
    wanted = wanted.withColumnsRenamed({"doc_id": "w_id", "row": "w_row"})
    on = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))
    return compressed(docs).join(wanted.hint("shuffle_hash"), on, how).drop("w_id", "w_row")


def cut_contexts(rows: DataFrame) -> DataFrame:
    """g, doc_id, row, place, context, hot from doc_id, row, data, wants (array of g, place, hot)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        names = ["g", "doc_id", "row", "place", "context", "hot"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in it:
            out: list[tuple] = []
            for doc_id, row, data, wants in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = unpacker.decompress(data)
                for w in wants:
                    first, count = w["place"] >> 9, w["place"] & 511
                    out.append((w["g"], doc_id, row, w["place"], raw[first : first + count + LENGTH - 1], w["hot"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.select("doc_id", "row", "data", "wants").mapInArrow(batches, "g bigint, doc_id bigint, row bigint, place bigint, context binary, hot boolean")


def remove(raw: bytes, places: list[int], starts: list[int]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    if not places and not starts:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    runs = np.array(places, np.int64)
    np.add.at(edge, runs >> 9, 1)
    np.add.at(edge, (runs >> 9) + (runs & 511) + LENGTH - 1, -1)
    single = np.array(starts, np.int64)
    np.add.at(edge, single, 1)
    np.add.at(edge, single + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as doc_id, row, text; and doc_id, row, places, starts: the runs and single windows that repeat, for texts with any."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    found = saved(anchors(own))
    # written before they are joined: both sides of each join are then dealt out anew, and Spark can split a hot gram
    often = saved(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    met = saved(found.join(often.hint("shuffle_hash"), "g", "left_semi"))
    first = F.min_by(F.struct("doc_id", "row", "place"), F.struct("doc_id", "row", "place")).alias("one")
    kinds = saved(met.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), first))
    whole = met.join(kinds.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("doc_id", "row", "place")
    mixed_grams = saved(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    ends = kinds.join(mixed_grams, "g").select("g", "one.*", (F.col("kinds") > HOT).alias("hot"))
    wants = ends.groupBy("doc_id", "row").agg(F.collect_list(F.struct("g", "place", "hot")).alias("wants"))
    cut = saved(cut_contexts(with_texts(own, saved(wants), "inner")))
    marked = in_blocks(cut.where("not hot")).unionByName(by_window(cut.where("hot")))
    nothing = F.lit(None).cast("array<bigint>")
    every = whole.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places")).withColumn("starts", nothing)
    every = every.unionByName(marked.select("doc_id", "row", nothing.alias("places"), "starts"))
    both = every.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("starts")).alias("starts"))
    return own, saved(both)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (what is left, as bytes) per row of docs."""
    own, marks = repeats(docs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in it:
            out = []
            for data, places, starts in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                raw = unpacker.decompress(data) if data else b""
                kept, gone, spans = remove(raw, places or [], starts or [])
                out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = with_texts(own, marks, "left").select("doc_id", "data", "places", "starts")
    return joined.mapInArrow(batches, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
