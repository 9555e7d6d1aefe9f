"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, a proof for every row.

Leaves are hashed natively and put in order by one range exchange; a leaf's position is its number within its partition plus
what the partitions before it hold, so a group may hold any share of the rows. A tree is cut into superblocks of BLOCK = RUN ** 3
consecutive nodes. Going up, each superblock is reduced to one node, and superblocks of superblocks in the same way, until
every tree has one node. Going down, the nodes of a level are cogrouped by superblock with the one row that holds the
superblock's outer siblings up to the root: one applyInPandas does the local reduction again, joins the proofs and folds them.
A task holds one superblock of a tree and its outer path, whatever the size of the table.

Defined cases: a null in a column is `-`, so it differs from an empty value; a null doc_id stands first in its source and is
never tampered; rows of one source with equal doc_id stand in the order of their leaves; repeated rows are leaves of their own; a null source is a tree of its
own, before all others; long texts are hashed whole; columns besides the named ones have no part; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 16
#: Levels that one superblock spans.
SPAN = 3


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def joined_hash(parts: list[bytes]) -> bytes:
    """Of digests as lowercase hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def reduced(nodes: list[bytes], alone: bool, run: int, span: int) -> list[list[bytes]]:
    """The levels over the nodes of a superblock: up to one node if it is its tree's only one, else just as many as it spans."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= span:
        below = levels[-1]
        levels.append([joined_hash(below[i : i + run]) for i in range(0, len(below), run)])
    return levels


def siblings(levels: list[list[bytes]], at: int, run: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a node in its run, level by level."""
    found = []
    for nodes in levels[:-1]:
        first = at - at % run
        found.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + run])))
        at //= run
    return found


def written(path: list[tuple[bytes, bytes]]) -> str:
    return ";".join(f"{before.decode()},{after.decode()}" for before, after in path)


def read(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode() for x in level.split(",")) for level in path.split(";")] if path else []


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        node = joined_hash([before, node, after])
    return node


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (from 0, by `order` within `tree`) and total (rows of the tree). The rows of a tree are in many tasks."""

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in it:
            if not batch.num_rows:
                continue
            tree, n = batch.column(0), batch.num_rows
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(tree.slice(1), tree.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            local = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if tree[0].as_py() == last:
                local[: starts[1] if len(starts) > 1 else n] += seen
            last, seen = tree[n - 1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local)], names=names)

    rows = rows.select("tree", *[c for c in rows.columns if c != "tree"])
    names = [*rows.columns, "part", "local"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, local bigint"
    numbers = saved(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(numbered, schema))
    counts = numbers.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    of_tree = Window.partitionBy("tree")  # a row for each partition that has rows of the tree
    before = F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = saved(counts.select("tree", "part", before.alias("before"), F.sum("n").over(of_tree).alias("total")))
    return numbers.join(offsets, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before")


def climbed(units: DataFrame, run: int, span: int) -> list[DataFrame]:
    """Levels of superblocks over units (tree, pos, total, digest); the last has one row for each tree, with its root."""
    size = run**span

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        total = int(rows["total"].iloc[0])
        top = reduced([bytes(d).hex().encode() for d in rows["digest"]], total <= size, run, span)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "total": [-(-total // size)], "digest": [bytes.fromhex(top.decode())]})

    levels = [units]
    while True:
        below = levels[-1].select("tree", "pos", "total", "digest", F.expr(f"pos div {size}").alias("block"))
        levels.append(saved(below.groupBy("tree", "block").applyInPandas(block, "tree string, pos bigint, total bigint, digest binary")))
        if levels[-1].where("total > 1").isEmpty():
            return levels


def descended(levels: list[DataFrame], tops: DataFrame, run: int, span: int) -> DataFrame:
    """tree, pos, path, subroot, root of the units of the level above the lowest; tops: the same of the trees' roots, with pos 0."""
    size = run**span

    def block(key: tuple, units: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values("pos")
        levels = reduced([bytes(d).hex().encode() for d in units["digest"]], int(units["total"].iloc[0]) <= size, run, span)
        above = outer["path"].iloc[0]
        paths = [";".join(filter(None, (written(siblings(levels, i, run)), above))) for i in range(len(units))]
        return pd.DataFrame({"tree": key[0], "pos": units["pos"], "path": paths, "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})

    for units in levels[-2:0:-1]:
        below = units.withColumn("block", F.expr(f"pos div {size}")).groupBy("tree", "block")
        outer = tops.withColumnRenamed("pos", "block").groupBy("tree", "block")
        tops = saved(below.cogroup(outer).applyInPandas(block, "tree string, pos bigint, path string, subroot string, root string"))
    return tops


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
             text: str = "text", run: int = RUN, span: int = SPAN) -> DataFrame:
    """The order column, leaf, subroot, root, proof_sha256, folded_root, verified and path (siblings before and after, by level) of every row.

    tampered: where true, the proof is folded from the leaf of the row with A-Z of its text lower-cased.
    """
    size = run**span
    values = [F.col(f"`{c}`") for c in fields]
    changed = [ascii_lower(v) if c == text else v for c, v in zip(fields, values, strict=True)]
    other = F.when(tampered, leaf_of(changed)) if tampered is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    at = F.col(f"`{order}`").cast("bigint").alias("at")
    # equal rows are told apart by salt, so that any number of them can be dealt over partitions
    leaves = saved(docs.select(tree.alias("tree"), at, leaf_of(values).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("salt")))
    levels = climbed(placed(leaves, "at", "digest", "salt"), run, span)

    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    over = climbed(saved(placed(roots, "name")), run, span)
    hexed = F.lower(F.hex("digest"))
    tops = over[-1].select("tree", "pos", F.lit("").alias("path"), hexed.alias("subroot"), hexed.alias("root"))
    outer = descended(over, tops, run, span)

    def named(key: tuple, units: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The lowest level over the groups: its units are the groups' roots."""
        units = units.sort_values("pos")
        digests = [bytes(d).hex() for d in units["digest"]]
        levels = reduced([d.encode() for d in digests], int(units["total"].iloc[0]) <= size, run, span)
        above = outer["path"].iloc[0]
        paths = [";".join(filter(None, (written(siblings(levels, i, run)), above))) for i in range(len(units))]
        return pd.DataFrame({"tree": units["name"], "pos": 0, "path": paths, "subroot": digests, "root": outer["root"].iloc[0]})

    def proved(key: tuple, units: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The leaves of a superblock: local reduction, proofs joined to the outer path, both folded."""
        units = units.sort_values("pos")
        leaves = [bytes(d).hex().encode() for d in units["digest"]]
        levels = reduced(leaves, int(units["total"].iloc[0]) <= size, run, span)
        above, root = read(outer["path"].iloc[0]), outer["root"].iloc[0]
        paths, proofs, ends = [], [], []
        for i, (leaf, changed) in enumerate(zip(leaves, units["other"], strict=True)):
            path = siblings(levels, i, run) + above
            proofs.append(joined_hash([part for level in path for part in level]).decode())
            ends.append(folded(leaf if changed is None else bytes(changed).hex().encode(), path).decode())
            paths.append(written(path))
        return pd.DataFrame({
            "at": units["at"].astype("Int64"), "leaf": [x.decode() for x in leaves], "subroot": outer["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": ends, "verified": [e == root for e in ends], "path": paths,
        })

    def exchanged(units: DataFrame, outer: DataFrame, finish, schema: str) -> DataFrame:
        blocks = units.withColumn("block", F.expr(f"pos div {size}")).groupBy("tree", "block")
        return blocks.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(finish, schema)

    tops = saved(exchanged(over[0], outer, named, "tree string, pos bigint, path string, subroot string, root string"))
    outer = descended(levels, tops, run, span)
    schema = "at bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string"
    return exchanged(levels[0], outer, proved, schema).withColumnRenamed("at", order)


def lowered(order: str = "doc_id") -> Column:
    """Rows that the manifest query tampers with: 5 divides the CRC-32 of the decimal id."""
    return F.crc32(F.col(order).cast("string")) % 5 == 0
