"""Digests of rows and tables that two different tables can't share by accident.

A row's text has each field with its length in front, and a mark of its own for null, so no value can take the place of a separator.
A table's digest is the root of a Merkle tree over the sha256 of its rows: rows are sorted into buckets by the first hexadecimal
digits of their own hash, equal rows are counted first, and a bucket's digest is that of its sorted hashes and counts. Neither the
order nor the split of the rows matters, every bucket is small and about as large as the others, and two trees are compared from the
root downwards: below equal nodes nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different rows in a bucket of the tree, about.
BUCKET = 256


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*parts: Column) -> Column:
    """sha256 of the parts in order; a null differs from every value, and no two lists of parts are written alike."""
    return F.sha2(F.concat(*map(field, parts)), 256)


def row_digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """row (sha256), n: the different rows and how often each stands in the table."""
    return rows.groupBy(digest_of(*[F.col(f"`{c}`") for c in columns]).alias("row")).agg(F.count(F.lit(1)).alias("n"))


def depth_of(different: int) -> int:
    """Levels below the root for so many different rows: one bucket up to BUCKET rows, then 16 times as many for each level."""
    depth = 0
    while BUCKET * 16**depth < different:
        depth += 1
    return depth


def digest_tree(rows: DataFrame, columns: list[str], depth: int | None = None) -> DataFrame:
    """level, prefix, n (rows), digest of every node; the root is level 0 with the empty prefix. depth: by the number of different rows."""
    own = row_digests(rows, columns)
    if depth is None:
        depth = depth_of(own.count())

    def level_of(parts: DataFrame, level: int) -> DataFrame:
        """parts: key (sorted by it), text, n."""
        grouped = parts.groupBy(F.substring("key", 1, level).alias("prefix")) if level else parts.groupBy()
        members = F.transform(F.sort_array(F.collect_list(F.struct("key", "text"))), lambda x: x["text"])
        node = grouped.agg(F.sha2(F.array_join(members, ","), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return node.select(F.lit(level).alias("level"), "prefix" if level else F.lit("").alias("prefix"), "n", "digest")

    parts = own.select(F.col("row").alias("key"), F.concat_ws(":", "row", F.col("n").cast("string")).alias("text"), "n")
    found = level_of(parts, depth)
    tree = found
    for level in range(depth - 1, -1, -1):
        found = level_of(found.select(F.col("prefix").alias("key"), F.concat_ws(":", "prefix", "digest").alias("text"), "n"), level)
        tree = tree.unionByName(found)
    return tree


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n, digest of the table: the tree's root."""
    return digest_tree(rows, columns).where("level = 0").select("n", "digest")


def changed_subtrees(one: DataFrame, other: DataFrame) -> DataFrame:
    """prefix, level: the deepest nodes at which two trees of one depth differ. Of a level only children of differing nodes are compared."""
    deepest = one.agg(F.max("level")).first()[0]
    if deepest != other.agg(F.max("level")).first()[0]:
        raise ValueError("the trees have different depths: build the second with the depth of the first")
    differing = None
    for level in range(deepest + 1):
        a, b = one.where(F.col("level") == level), other.where(F.col("level") == level)
        if differing is not None:
            parents = differing.select(F.col("prefix").alias("parent"))
            a, b = (x.join(parents, F.substring("prefix", 1, level - 1) == F.col("parent"), "left_semi") for x in (a, b))
        both = a.select("prefix", F.col("digest").alias("x")).join(b.select("prefix", F.col("digest").alias("y")), "prefix", "full")
        differing = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix", F.lit(level).alias("level"))
    return differing


def changed_rows(one: DataFrame, other: DataFrame, prefixes: DataFrame) -> DataFrame:
    """row, before, after: counts of the rows (row, n: row_digests) below the named prefixes that differ."""
    length = F.char_length("prefix")
    below = lambda rows, name: rows.join(prefixes, F.substring(F.col("row"), F.lit(1), length) == F.col("prefix"), "left_semi").select("row", F.col("n").alias(name))
    both = below(one, "before").join(below(other, "after"), "row", "full").na.fill(0, ["before", "after"])
    return both.where("before <> after")


def summed_digest(*columns: Column) -> Column:
    """An aggregate: one pass over rows in any order. Sums of the eight 32-bit parts of each row's sha256, hashed again."""
    own = digest_of(*columns)
    lanes = [F.sum(F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(",", *lanes), 256)
