"""Near-duplicate vectors of one label: Euclidean p-stable hashing, exact cosine checks, components.

A table of the index cuts the space into cells: PROJECTIONS Gaussian projections of the normalised vector, each shifted and cut
at every WIDTH, are one bucket. Two vectors at distance r fall into one bucket of a table with probability p(r) ** PROJECTIONS;
TABLES tables make a miss of a pair at the threshold (r = 0.2 at cosine 0.98) rare, and of closer pairs rarer still. What meets in a
bucket is checked by its cosine in double precision, so no pair below the threshold is linked.

Equal vectors are one class with a count. Buckets of one class are left out before vectors are fetched. A bucket of any size is
dealt into blocks of about BLOCK classes, and each pair of blocks is one matrix product, which returns for each class how many
vectors it links to and one edge of a spanning forest: pairs are neither written nor cut off. Pairs of blocks come to a task in order, many small ones in
one Arrow batch. A pair that meets in several
tables counts in the first of them. Vectors pass from table to table only where a bucket is shared.

Defined cases: vectors that are null, empty or zero, or hold a null or a component that is not finite, and vectors without a label link with
nothing; vectors of different lengths don't link; repeated rows are vectors that link with each other; a null vec_id is in a
component, never names it and isn't kept; rows of one vec_id are judged row by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved
from tessera.llm.near_sets import mixed
from tessera.llm.simhash import components

COSINE = 0.98
TABLES = 16
PROJECTIONS = 16
WIDTH = 2.0
SEED = 20
#: Classes of one block of a bucket, about.
BLOCK = 1024
#: Products this near the threshold are computed again by the definition.
EDGE = 1e-9


def normalised(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def buckets(vectors: np.ndarray, label: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """A bucket for each normalised vector and table; label: a hash that keeps labels apart. Same for all tasks."""
    rng = np.random.default_rng((SEED, vectors.shape[1]))
    lines = rng.standard_normal((vectors.shape[1], tables * projections))
    cells = np.floor((vectors @ lines + rng.uniform(0, WIDTH, tables * projections)) / WIDTH).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(vectors), tables, projections)
    found = mixed(label.view(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64)[None, :])
    for k in range(projections):
        found = mixed(found ^ cells[:, :, k]) + np.uint64(k)
    return found.view(np.int64)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def indexed(classes: DataFrame, tables: int, projections: int) -> DataFrame:
    """classes with signature: the buckets of all tables."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, kind = batch["size"].to_numpy(), batch["kind"].to_numpy()
            found = np.zeros((len(sizes), tables), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                vectors = normalised(matrix(batch["embedding"].take(pa.array(rows)), int(size)))
                found[rows] = buckets(vectors, kind[rows], tables, projections)
            signature = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, signature], names=[*batch.schema.names, "signature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields) + ", signature array<bigint>"
    return classes.mapInArrow(batches, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component, given pairs a, b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def linked(i: int, j: int, at: int, node: np.ndarray, count: np.ndarray, side: np.ndarray, vectors: np.ndarray, signature: np.ndarray, cosine: float) -> tuple | None:
    """(node, links: vectors linked that count here first, hub: of the forest) for the classes of a pair of blocks of a bucket; None without links."""
    unit = normalised(vectors)
    rows = np.flatnonzero(side == i)
    columns = rows if i == j else np.flatnonzero(side == j)
    product = unit[rows] @ unit[columns].T
    a, b = np.nonzero(product >= cosine - EDGE)
    close = product[a, b]
    a, b = rows[a], columns[b]
    keep = (a < b) if i == j else np.ones(len(a), bool)
    for k in np.flatnonzero(np.abs(close - cosine) <= EDGE):
        x, y = vectors[a[k]], vectors[b[k]]
        keep[k] &= bool(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine)
    a, b = a[keep], b[keep]
    new = np.ones(len(a), bool)
    for t in range(at):
        new &= signature[a, t] != signature[b, t]
    a, b = a[new], b[new]
    if not len(a):
        return None
    links = np.bincount(a, count[b], len(node)) + np.bincount(b, count[a], len(node))
    some = np.flatnonzero(links)
    return node[some], links[some].astype(np.int64), node[forest(len(node), a, b)[some]]


def runs_linked(it: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """linked() of each run of rows of one pair of blocks; rows come sorted, and a run that a batch cuts is kept for the next one."""
    keys, rest = ("bucket", "i", "j", "at", "size", "label"), None
    for batch in itertools.chain(it, [None]):
        table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]) if rest is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        own = table.combine_chunks().to_batches()[0]
        new = np.ones(own.num_rows, bool)
        new[1:] = np.logical_or.reduce([pc.not_equal(own[c].slice(1), own[c].slice(0, own.num_rows - 1)).to_numpy(zero_copy_only=False) for c in keys])
        starts = np.append(np.flatnonzero(new), own.num_rows)
        whole = len(starts) - 1 if batch is None else len(starts) - 2  # the last run may go on
        rest = own.slice(int(starts[whole]))
        i, j, at, node, count, side = (own[c].to_numpy() for c in ("i", "j", "at", "node", "n", "side"))
        offsets, flat = own["embedding"].offsets.to_numpy(), own["embedding"].values.to_numpy(zero_copy_only=False)
        signature = matrix_of_longs(own["signature"])
        out = []
        for s, e in zip(starts[:whole], starts[1 : whole + 1], strict=True):
            vectors = flat[offsets[s] : offsets[e]].astype(np.float64).reshape(e - s, -1)
            found = linked(int(i[s]), int(j[s]), int(at[s]), node[s:e], count[s:e], side[s:e], vectors, signature[s:e], cosine)
            if found:
                out.append(found)
        if out:
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "hub"])


def matrix_of_longs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def links(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """node, links, hub by pair of blocks, of classes (node, n, size, label, embedding, signature)."""
    index = classes.select("node", F.posexplode("signature").alias("at", "bucket"))
    crowded = saved(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    members = index.join(crowded, "bucket").join(classes, "node")
    blocks = F.ceil(F.col("held") / block).cast("int")
    members = members.withColumn("side", F.pmod(F.xxhash64("node", "at"), blocks).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", "label", "size", "at", "node", "n", "embedding", "signature", "side",
                         F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def of_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return runs_linked(it, cosine)

    key = ["bucket", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "at", "size", "label")
    return ordered.mapInArrow(of_runs, "node bigint, links bigint, hub bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, label, embedding."""
    embedding = F.col("embedding")
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    sound = F.col("label").isNotNull() & F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))
    one, two = F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding", F.when(sound, one).alias("one"), F.when(sound, two).alias("two"))
    same = rows.where("one is not null").groupBy("one", "two")
    classes = same.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("size"), F.xxhash64("label").alias("kind"))
    classes = saved(indexed(classes, tables, projections).drop("kind"))
    found = saved(links(classes, cosine, block))
    roots = components(found.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = saved(counts.join(roots, "node").join(classes.select("node", "first"), "node"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(firsts, "root").select("node", "links", "component_id")
    small = classes.select("node", "one", "two", "n", "first").join(groups, "node", "left")
    of_class = small.select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                            F.when(F.col("links").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    component = F.when(F.col("one").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    joined = rows.select("vec_id", "one", "two").join(of_class, ["one", "two"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
