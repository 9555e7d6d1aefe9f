"""Nearest neighbours by an inverted file over vectors.

Centres are fitted on a bounded sample (SAMPLE vectors, those of least hash of id; k-means on unit vectors); every row then stands in the cell
of its nearest centre. A query looks into the `probes` cells nearest to it, the kind is a filter inside the cell, and what stands
there is ranked by the exact distance. With exact=True the cells that are left are then bounded by their radius: a cell is read
if it could hold a row as near as the k-th found, so the result is that of comparing with all rows. A cell of any size is dealt into
blocks, and so are its queries; each pair of blocks returns the k best for each query, so neither a cell nor a query is gathered in one task.

Vectors have one length and are compared by direction; rows without a vector, or with a zero one, are not in the index and have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import saved

#: Vectors that centres are fitted on, rounds of the fit, most centres.
SAMPLE, ROUNDS, MOST = 20_000, 10, 4096
#: Rows of one block of a cell.
BLOCK = 8192
#: Distances are rounded to this many digits before they are ranked.
DIGITS = 6


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def with_vector(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.coalesce(F.forall("embedding", lambda x: ~F.isnan(x)), F.lit(False)))


def fitted(vectors: np.ndarray, count: int) -> np.ndarray:
    """k-means on unit vectors; the first centres are spread over the sample. The same for the same sample."""
    vectors = unit(vectors)
    centres = vectors[np.linspace(0, len(vectors) - 1, min(count, len(vectors))).astype(int)]
    for _ in range(ROUNDS):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


@dataclass
class CellIndex:
    """cells: cell, t_id, kind, embedding; centres: one row each; reach: the widest angle in each cell; sizes: cell, kind, blocks."""

    cells: DataFrame
    centres: np.ndarray
    reach: np.ndarray
    sizes: DataFrame


def build_index(rows: DataFrame, centres: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """rows: id, kind, embedding. centres: by default the square root of the number of rows, up to MOST."""
    rows = with_vector(rows.select(F.col("id").alias("t_id"), "kind", "embedding"))
    count = centres or min(MOST, max(1, int(rows.count() ** 0.5)))
    drawn = rows.select("embedding", F.xxhash64("t_id").alias("h"), "t_id").orderBy("h", "t_id").limit(sample).select("embedding").toArrow()
    if not drawn.num_rows:
        return CellIndex(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), rows.sparkSession.createDataFrame([], "cell int, kind string, blocks int"))
    fixed = fitted(matrix(drawn["embedding"]), count)

    def celled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                near = unit(matrix(batch["embedding"])) @ fixed.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(near.max(axis=1))], names=[*batch.schema.names, "cell", "near"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, near double"
    cells = saved(rows.mapInArrow(celled, schema))
    found = cells.groupBy("cell", "kind").agg(F.min("near").alias("near"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    found = saved(found)
    reach = np.full(len(fixed), -1.0)  # cells without rows are never read
    for cell, near in found.groupBy("cell").agg(F.min("near")).collect():  # a row a centre
        reach[cell] = np.arccos(min(1.0, near))
    return CellIndex(cells.drop("near"), fixed, reach, found.select("cell", "kind", "blocks"))


def _visits(queries: DataFrame, index: CellIndex, probes: int, second: bool) -> DataFrame:
    """queries with cell: the `probes` cells nearest to each; second: the others that may hold a row as near as `kth`."""
    centres, reach = index.centres, index.reach

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            near = unit(matrix(batch["embedding"])) @ centres.T
            near[:, reach < 0] = -2
            first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            wanted = np.zeros(near.shape, bool)
            np.put_along_axis(wanted, first, True, axis=1)
            if second:
                # the best cosine that a row of the cell can have, with a margin for the rounding of ranked distances
                angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - reach, 0)
                kth = batch["kth"].to_numpy(zero_copy_only=False).astype(np.float64)
                wanted = ~wanted & (np.cos(angle) >= (1 - kth - 3 * 10.0**-DIGITS)[:, None])
            wanted[:, reach < 0] = False
            row, cell = np.nonzero(wanted)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cell int"
    return queries.mapInArrow(batches, schema)


def _ranked(visits: DataFrame, index: CellIndex, k: int, same_kind: bool) -> DataFrame:
    """id, t_id, distance, read (rows compared in the block) of the k best of each query in each block of the cells that it visits."""
    visits = saved(visits)
    parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))  # a cell that many queries visit
    sizes = index.sizes.join(parts, "cell")
    cells = index.cells.join(sizes, ["cell", "kind"]).withColumn("block", F.pmod(F.xxhash64("t_id"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = visits.withColumnRenamed("kind", "q_kind").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    if same_kind:
        asked = asked.where(F.col("q_kind") == F.col("kind"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["cell", "kind", "block", "part"]

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"id": [], "t_id": [], "distance": [], "read": []}
        if queries.num_rows and rows.num_rows:
            targets, ids = unit(matrix(rows["embedding"])), rows["t_id"].to_numpy()
            for at in range(0, queries.num_rows, 512):
                part = queries.slice(at, 512)
                distance = np.round(1 - np.clip(unit(matrix(part["embedding"])) @ targets.T, 0, 1), DIGITS)
                for i, own in enumerate(part["id"].to_pylist()):
                    fit = ids != own
                    if "forbidden" in part.column_names and part["forbidden"][i].as_py():
                        fit &= ~np.isin(ids, part["forbidden"][i].as_py())
                    places = np.flatnonzero(fit)
                    d, t = distance[i][places], ids[places]
                    if len(d) > k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        d, t = d[near], t[near]
                    order = np.lexsort((t, d))[:k]
                    out["id"] += [own] * len(order)
                    out["t_id"] += t[order].tolist()
                    out["distance"] += d[order].tolist()
                    out["read"] += [len(places)] * len(order)
        return pa.table({"id": pa.array(out["id"], pa.int64()), "t_id": pa.array(out["t_id"], pa.int64()), "distance": pa.array(out["distance"], pa.float64()), "read": pa.array(out["read"], pa.int64())})

    columns = [c for c in ("id", "embedding", "forbidden") if c in asked.columns]
    left, right = asked.select(*key, *columns).groupBy(*key), cells.select(*key, "t_id", "embedding").groupBy(*key)
    return left.cogroup(right).applyInArrow(best, "id bigint, t_id bigint, distance double, read bigint")


def nearest_by_cells(queries: DataFrame, index: CellIndex, k: int, probes: int, exact: bool = False, same_kind: bool = True) -> DataFrame:
    """id, t_id, distance, rank: the k nearest rows of each query (id, kind, embedding; forbidden: ids that are out, if there is the column)."""
    queries = with_vector(queries)
    order = Window.partitionBy("id").orderBy("distance", "t_id")
    rank = lambda found: found.select("id", "t_id", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], "id bigint, t_id bigint, distance double, rank int")
    first = rank(_ranked(_visits(queries, index, probes, False), index, k, same_kind))
    if not exact:
        return first
    first = saved(first)
    kth = first.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).select("id", F.when(F.col("n") >= k, F.col("d")).alias("kth"))
    bounded = queries.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(2.0)))
    more = _ranked(_visits(bounded, index, probes, True), index, k, same_kind).drop("read")
    return rank(first.drop("rank").unionByName(more))


def share_read(queries: DataFrame, index: CellIndex, probes: int, same_kind: bool = True) -> float:
    """The share of all pairs of a query and a row of its kind that the probed cells hold."""
    sizes = index.cells.groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n"))
    visits = _visits(with_vector(queries), index, probes, False).withColumnRenamed("kind", "q_kind").join(sizes, "cell")
    whole = queries.withColumnRenamed("kind", "q_kind").join(sizes.groupBy("kind").agg(F.sum("n").alias("n")), F.col("q_kind") == F.col("kind") if same_kind else F.lit(True))
    if same_kind:
        visits = visits.where("q_kind = kind")
    return visits.agg(F.sum("n")).first()[0] / whole.agg(F.sum("n")).first()[0]


def with_forbidden(queries: DataFrame, forbidden: DataFrame) -> DataFrame:
    """queries with the column forbidden: the ids (t_id) that each must not have. forbidden: id, t_id; short lists."""
    lists = forbidden.groupBy("id").agg(F.collect_set("t_id").alias("forbidden"))
    return queries.join(lists, "id", "left")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (id, t_id) that were found."""
    return found.select("id", "t_id").join(exact.select("id", "t_id"), ["id", "t_id"], "left_semi").count() / max(1, exact.count())
