"""Best names without comparing all pairs: a threshold-pruned top-k join on the token-sorted Indel ratio.

The ratio of two names is at most 2 m / (len a + len b), where m is the number of letters they share as multisets, and that is at
most twice the shorter length over the sum. A first pass compares each name with a few that share its rarest words; the k-th best of these is
a floor. Targets stand in buckets by kind and length, each dealt into blocks; a name goes only to lengths that can reach its floor. In a
block the targets are visited by falling bound, and the visit ends at the first bound below the k-th best so far (or below
`at_least`). What is left out can't be among the k best, so the rows are those of all pairs.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_sort
from tessera.sources.storage import saved

#: Names of a block, on either side; words of a name and names of a word that the first pass looks at; letters are counted in so many bins.
BLOCK, SEED_WORDS, SEED_NAMES, BINS = 1024, 2, 16, 48
#: Ratios are ranked by four digits: names this close to the k-th best may still be tied with it.
TIE = 0.00011


def shared_run(a: str, b: str) -> int:
    """Length of the longest common subsequence, a letter of a at a time on the bits of one number."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(b):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for letter in a:
        hit = row & masks.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def letter_counts(names: list[str]) -> np.ndarray:
    """A row of counts for each name; letters that fall into one bin can only raise the bound."""
    counts = np.zeros((len(names), BINS), np.int32)
    for i, name in enumerate(names):
        for letter, n in Counter(name).items():
            counts[i, ord(letter) % BINS] += n
    return counts


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the ratios of all names of a (rows of letter counts) with all of b."""
    shared = np.zeros((len(a), len(b)), np.int32)
    for letter in range(BINS):
        shared += np.minimum(a[:, letter][:, None], b[:, letter][None, :])
    return 2.0 * shared / (a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :])


def visit(name: str, floor: float, targets: list[str], bound: np.ndarray, k: int | None) -> tuple[list[tuple[int, int]], int]:
    """(target, common letters) of those that may be among the k best (k None: all from the floor on), and the number of comparisons."""
    found, best, calls = [], [], 0
    for j in np.argsort(-bound, kind="stable"):
        least = max(floor, best[0] - TIE) if k is not None and len(best) == k else floor
        if bound[j] < least - 1e-9:
            break
        calls += 1
        common = shared_run(name, targets[j])
        ratio = 2.0 * common / (len(name) + len(targets[j]))
        if ratio >= least - 1e-9:
            found.append((int(j), common))
            if k is not None:
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, ratio)
    return found, calls


def _names(rows: DataFrame, name: str) -> DataFrame:
    """kind, name, its tokens in order, length; empty names have no ratio."""
    own = rows.select("kind", F.col("norm").alias(name)).distinct().where(F.col(name) != "")
    return own.withColumn("tokens", token_sort(F.col(name))).withColumn("size", F.char_length("tokens"))


def _floors(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """kind, a, floor: the k-th best ratio of a few names that share a word; 0 where there are fewer than k."""
    words = b.select("kind", F.col("b").alias("other"), F.explode(F.array_distinct(F.split("tokens", " "))).alias("word"), F.col("tokens").alias("y"))
    often = words.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("df"))
    some = words.withColumn("k", F.row_number().over(Window.partitionBy("kind", "word").orderBy(F.xxhash64("other"), "other"))).where(F.col("k") <= SEED_NAMES).drop("k")
    mine = a.select("kind", "a", F.col("tokens").alias("x"), F.explode(F.array_distinct(F.split("tokens", " "))).alias("word")).join(often, ["kind", "word"])
    rare = mine.withColumn("k", F.row_number().over(Window.partitionBy("kind", "a").orderBy("df", "word"))).where(F.col("k") <= SEED_WORDS)
    met = rare.join(some, ["kind", "word"]).select("kind", "a", "x", "other", "y").distinct()

    def compared(it):
        for batch in it:
            ratios = [2.0 * shared_run(x, y) / (len(x) + len(y)) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["a"], pa.array(ratios, pa.float64())], names=["kind", "a", "ratio"])

    ratios = met.mapInArrow(compared, "kind string, a string, ratio double")
    ranked = ratios.withColumn("k", F.row_number().over(Window.partitionBy("kind", "a").orderBy(F.desc("ratio")))).where(F.col("k") == k)
    return ranked.select("kind", "a", (F.col("ratio") - TIE).alias("floor"))


def close_names(sources: DataFrame, targets: DataFrame, k: int | None = None, at_least: float = 0.0) -> DataFrame:
    """kind, a, b, lexical, calls of pairs of different normalised names of one kind. sources, targets: norm, kind.

    With k: at least all pairs whose rounded ratio is among the k best of a (and more of those met on the way); without: all from
    at_least on. calls: comparisons of its source in its block, on the first row found there, else 0. Pairs with an empty name or no letter in common may be missing.
    """
    a, b = saved(_names(sources, "a")), saved(_names(targets, "b"))
    floors = _floors(a, b, k) if k is not None else a.select("kind", "a", F.lit(at_least - TIE).alias("floor"))
    asked = a.join(floors, ["kind", "a"], "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(at_least - TIE)))
    lengths = b.groupBy("kind", F.col("size").alias("b_size")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    reach = 2 * F.least("size", "b_size") / (F.col("size") + F.col("b_size")) >= F.col("floor") - 1e-9
    # a row a length, not a name: what a name is sent to
    asked = saved(asked.join(lengths, "kind").where(reach).select("kind", "b_size", "blocks", "a", F.col("tokens").alias("x"), "floor"))
    parts = asked.groupBy("kind", "b_size", "blocks").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    key = ["kind", "b_size", "block", "part"]
    left = asked.join(parts.drop("blocks"), ["kind", "b_size"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = b.withColumnRenamed("size", "b_size").join(parts, ["kind", "b_size"]).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def best(names: pa.Table, others: pa.Table) -> pa.Table:
        out: dict[str, list] = {"kind": [], "a": [], "b": [], "common": [], "total": [], "calls": []}
        if names.num_rows and others.num_rows:
            kind, x, y, b_names = names["kind"][0].as_py(), names["x"].to_pylist(), others["tokens"].to_pylist(), others["b"].to_pylist()
            above = bounds(letter_counts(x), letter_counts(y))
            for i, (a_name, floor) in enumerate(zip(names["a"].to_pylist(), names["floor"].to_pylist(), strict=True)):
                found, calls = visit(x[i], floor, y, above[i], k)
                for j, common in found:
                    for column, value in zip(out, (kind, a_name, b_names[j], common, len(x[i]) + len(y[j]), calls), strict=True):
                        out[column].append(value)
                    calls = 0
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    met = left.select(*key, "a", "x", "floor").groupBy(*key).cogroup(right.select(*key, "b", "tokens").groupBy(*key))
    pairs = met.applyInArrow(best, "kind string, a string, b string, common int, total int, calls bigint")
    return pairs.select("kind", "a", "b", F.round(2.0 * F.col("common") / F.col("total"), 4).alias("lexical"), "calls")
