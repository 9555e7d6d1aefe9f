"""A set of queries against all rows of their kind, as products of blocks.

Both sides are dealt into blocks by a hash of their id; the blocks of a kind meet in one `cogroup`, which multiplies vectors as matrices
and compares a query's name once with each different name of the block. Either every pair is returned, or the k best of each
query in each block, of which a window keeps the k best: no pair is left out, but only those asked for leave a task.

Numbers are those of SQL: products that come within the error of a matrix product to a rounding edge are added up again term by term, and
a half is rounded as `rounded` (functions/text.py) does. A missing vector, one with a null inside or one of another length has cosine 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_sort
from tessera.operators.names import shared_run
from tessera.sources.storage import saved

#: Rows of a block of either side: where the best are kept, and where all pairs are returned. Queries that are multiplied at once.
BLOCK, PAIR_BLOCK, STEP = 4096, 1024, 16
#: Whole units of a cosine or distance, and of a ratio or score.
MILLION, SCORE = 10**6, 10**4
#: Vectors longer than this, or not finite, are added up term by term.
LONGEST = 1000.0
#: Letters of a name that stand in the bits of one number.
BITS = 63
#: Up to so many best ones are taken one by one.
FEW = 12


def units(x: np.ndarray, scale: int) -> np.ndarray:
    """x in whole parts of the scale, not negative; a half goes up."""
    x = x * float(scale)
    whole = np.floor(x)
    x -= whole
    x += x
    whole += np.floor(x, out=x)
    return whole


class Vectors:
    """The vectors of a block as rows of one length; odd: some are not of that length."""

    def __init__(self, column: pa.ChunkedArray):
        whole = column.combine_chunks()
        whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
        self.size = pc.list_value_length(whole).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = whole.flatten()
        self.odd = bool(flat.null_count) or self.size[0] < 0 or bool((self.size != self.size[0]).any())
        if self.odd:
            rows = whole.to_pylist()
            self.size = np.array([-1 if v is None or None in v else len(v) for v in rows])
            self.rows = np.zeros((len(rows), max(0, self.size.max())))
            for i, v in enumerate(rows):
                if self.size[i] > 0:
                    self.rows[i, : self.size[i]] = v
        else:
            self.rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), self.size[0])
        with np.errstate(all="ignore"):
            length = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.wild = ~(length <= LONGEST)
        self.longest = length[~self.wild].max(initial=0.0)

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.rows, ((0, 0), (0, width - self.rows.shape[1])))


def cosine_units(x: np.ndarray, y: np.ndarray, a: Vectors, b: Vectors, at: int, distance: bool) -> np.ndarray:
    """Cosines (or distances) in millionths of the rows x, those of a from `at` on, and y, all of b."""
    with np.errstate(all="ignore"):
        found = x @ y.T
        np.clip(found, 0.0, 1.0, out=found)
        if distance:
            np.subtract(1.0, found, out=found)
        found *= MILLION
        whole = np.rint(found)
        found -= whole
        np.abs(found, out=found)
        edge = found > 0.5 - 1e-8 - MILLION * (x.shape[1] + 4) * 2.3e-16 * a.longest * b.longest
        if a.wild.any() or b.wild.any():
            edge |= a.wild[at : at + len(x), None] | b.wild[None, :]
        row, column = np.nonzero(edge) if edge.any() else ((), ())
        for i in range(0, len(row), 65536):
            r, c = row[i : i + 65536], column[i : i + 65536]
            dot = np.add.accumulate(np.pad(x[r] * y[c], ((0, 0), (1, 0))), axis=1)[:, -1]  # in order
            dot = np.where(np.isnan(dot), 1.0, np.clip(dot, 0.0, 1.0))
            whole[r, c] = units(1.0 - dot if distance else dot, MILLION)
    if a.odd or b.odd or a.rows.shape[1] != b.rows.shape[1]:
        own = a.size[at : at + len(x)][:, None]
        whole[(own != b.size[None, :]) | (own < 0)] = MILLION if distance else 0
    return whole


class Names:
    """The different names of a block; for a query's name its ratios with them, each query's name once."""

    def __init__(self, column: pa.ChunkedArray):
        coded = column.combine_chunks()
        coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        self.place, self.names, self.known = coded.indices.to_numpy(), coded.dictionary.to_pylist(), {}
        self.length = np.array([len(n) for n in self.names])
        self.long = np.flatnonzero(self.length > BITS)
        bits = np.where(self.length > BITS, 0, self.length).astype(np.uint64)
        self.full = (np.uint64(1) << bits) - np.uint64(1)
        masks: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            for j, letter in enumerate(name if len(name) <= BITS else ""):
                masks.setdefault(letter, [0] * len(self.names))[i] |= 1 << j
        self.masks = {letter: np.array(m, np.uint64) for letter, m in masks.items()}

    def ratios(self, name: str) -> np.ndarray:
        """In ten thousandths, with each row of the block."""
        if name not in self.known:
            row = self.full.copy()
            for mask in filter(lambda m: m is not None, map(self.masks.get, name)):
                hit = row & mask
                row = ((row + hit) | (row - hit)) & self.full
            common = self.length - np.bitwise_count(row)
            common[self.long] = [shared_run(name, self.names[i]) for i in self.long]
            none = self.length == 0 if name else np.ones(len(self.names), bool)
            self.known[name] = np.where(none, 0.0, units(2.0 * common / np.maximum(1, len(name) + self.length), SCORE))
        return self.known[name][self.place]


@dataclass(frozen=True)
class Ranking:
    """The order of pairs: by the hybrid score of these weights, then by name and target; by_name: by name, then by score."""

    w_lexical: float
    w_semantic: float
    by_name: bool = False

    def scores(self, lexical: np.ndarray, semantic: np.ndarray) -> np.ndarray:
        """In ten thousandths, of ratios and cosines."""
        total = self.w_lexical + self.w_semantic
        both = self.w_semantic * semantic
        both += self.w_lexical * lexical
        return units(both if total == 1.0 else both / total, SCORE)


def picked(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest keys of each row; a row's keys differ, but for negative ones, which are out. key is used up."""
    every, k = np.arange(len(key)), min(k, key.shape[1])
    if k > FEW:
        row, column = np.repeat(every, k), np.argpartition(key, key.shape[1] - k, axis=1)[:, -k:].ravel()
        fit = key[row, column] >= 0
        return row[fit], column[fit]
    rows, columns = [], []
    for _ in range(k):
        column = key.argmax(axis=1)
        fit = key[every, column] >= 0
        rows.append(every[fit])
        columns.append(column[fit])
        key[every, column] = -1
    return np.concatenate(rows), np.concatenate(columns)


def _steps(queries: pa.Table, rows: pa.Table, distance: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """The number of the first query of a step and its cosines (distances) in millionths with all rows."""
    a, b = Vectors(queries["embedding"]), Vectors(rows["embedding"])
    width = max(a.rows.shape[1], b.rows.shape[1])
    x, y = a.widened(width), b.widened(width)
    for at in range(0, len(x), STEP):
        yield at, cosine_units(x[at : at + STEP], y, a, b, at, distance)


def _best(queries: pa.Table, rows: pa.Table, k: int, rankings: tuple[Ranking, ...]) -> dict[str, list]:
    """The columns of the k best rows of each query by each ranking; without rankings the k nearest."""
    out: dict[str, list] = {c: [] for c in ("at", "to", "lexical", "semantic", "score", "ranking")}
    for start in range(0, rows.num_rows, BLOCK):  # hashes deal out blocks of about this size
        part = rows.slice(start, BLOCK)
        ids, own = part["t_id"].to_numpy(), queries["id"].to_numpy()
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        earlier = np.arange(len(ids) - 1, -1, -1, dtype=np.float64)  # rows stand by id: of equal ones the first has the greatest key
        names, asked = (Names(part["tokens"]), queries["tokens"].to_pylist()) if rankings else (None, [])
        for at, semantic in _steps(queries, part, not rankings):
            ratio = np.stack([names.ratios(n) for n in asked[at : at + len(semantic)]]) if rankings else None
            for ranking in rankings or (None,):
                if ranking is None:
                    score, key = None, MILLION - semantic
                else:
                    score = ranking.scores(ratio / SCORE, semantic / MILLION)
                    key = (ratio if ranking.by_name else score) * (SCORE + 1.0)
                    key += score if ranking.by_name else ratio
                key *= len(ids)
                key += earlier
                for i in np.flatnonzero(last[at : at + len(key)] > first[at : at + len(key)]):
                    key[i, first[at + i] : last[at + i]] = -1
                i, j = picked(key, k)
                out["at"].append(i + at)
                out["to"].append(j + start)
                out["semantic"].append(semantic[i, j] / MILLION + 0.0)
                if ranking is not None:
                    out["lexical"].append(ratio[i, j] / SCORE)
                    out["score"].append(score[i, j] / SCORE)
                    out["ranking"].append(np.full(len(i), rankings.index(ranking), np.int32))
    return out


def _whole(parts: list, of: type) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, of))


def _met(sources: DataFrame, targets: DataFrame, names: bool, block: int):
    """The two sides (id, t_id; kind, embedding, with names tokens) dealt into blocks of a kind that meet each other once, as groups."""
    extra = [token_sort(F.col("norm")).alias("tokens")] if names else []
    own = saved(sources.where("id is not null").select("id", "kind", *extra, "embedding"))
    other = saved(targets.where("id is not null").select(F.col("id").alias("t_id"), "kind", *extra, "embedding"))
    if names:  # asked of what is saved: before, the names of rows that the join behind sources leaves out would be normalised too
        own, other = own.where("tokens is not null"), other.where("tokens is not null")
    counted = lambda rows, name: rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = saved(counted(own, "parts").join(counted(other, "blocks"), "kind"))  # a row a kind
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["kind", "block", "part"]
    left = own.join(sizes, "kind").withColumn("part", dealt("id", "parts")).withColumn("block", every("blocks"))
    right = other.join(sizes, "kind").withColumn("block", dealt("t_id", "blocks")).withColumn("part", every("parts"))
    tidy = lambda side: side.drop("parts", "blocks").groupBy(*key)
    types = {"id": own.schema["id"].dataType.simpleString(), "t_id": other.schema["t_id"].dataType.simpleString(), "kind": own.schema["kind"].dataType.simpleString()}
    return tidy(left).cogroup(tidy(right)), types


def nearest_in_blocks(sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """id, t_id, distance, rank: the k nearest others of one kind, ties by target. Both sides: id, kind, embedding."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"at": [], "to": [], "semantic": []}
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("t_id")
            found = _best(queries, rows, k, ())
        at, to = _whole(found["at"], np.int64), _whole(found["to"], np.int64)
        return pa.table({"id": queries["id"].take(at), "t_id": rows["t_id"].take(to), "distance": _whole(found["semantic"], np.float64)})

    groups, types = _met(sources, targets, False, BLOCK)
    found = groups.applyInArrow(best, f"id {types['id']}, t_id {types['t_id']}, distance double")
    order = Window.partitionBy("id").orderBy("distance", "t_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_in_blocks(sources: DataFrame, targets: DataFrame, k: int, rankings: tuple[Ranking, ...]) -> DataFrame:
    """id, t_id, kind, lexical, semantic, score, ranking, rank: the k best others of one kind by each ranking (its number). Both sides: id, kind, norm, embedding."""

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = {c: [] for c in ("at", "to", "lexical", "semantic", "score", "ranking")}
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("t_id")
            found = _best(queries, rows, k, rankings)
        at, to = _whole(found["at"], np.int64), _whole(found["to"], np.int64)
        columns = {"id": queries["id"].take(at), "t_id": rows["t_id"].take(to), "kind": queries["kind"].take(at)}
        columns |= {c: _whole(found[c], np.float64) for c in ("lexical", "semantic", "score")}
        return pa.table(columns | {"ranking": _whole(found["ranking"], np.int32)})

    groups, types = _met(sources, targets, True, BLOCK)
    schema = f"id {types['id']}, t_id {types['t_id']}, kind {types['kind']}, lexical double, semantic double, score double, ranking int"
    by_name = F.col("ranking").isin([i for i, r in enumerate(rankings) if r.by_name])
    first, second = F.when(by_name, F.col("lexical")).otherwise(F.col("score")), F.when(by_name, F.col("score")).otherwise(F.col("lexical"))
    order = Window.partitionBy("ranking", "id").orderBy(first.desc(), second.desc(), "t_id")
    return groups.applyInArrow(best, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pairs_in_blocks(sources: DataFrame, targets: DataFrame, ranking: Ranking | None) -> DataFrame:
    """id, t_id, kind, lexical, semantic, score of all pairs of one kind; without a ranking id, t_id, semantic alone. Both sides: id, kind, embedding, else norm."""

    def every(queries: pa.Table, rows: pa.Table) -> pa.Table:
        batches, names = [], Names(rows["tokens"]) if ranking and rows.num_rows else None
        ids, others, n = queries["id"].combine_chunks(), rows["t_id"].to_numpy(), rows.num_rows
        for at, semantic in _steps(queries, rows) if queries.num_rows and n else ():
            own = queries.slice(at, len(semantic))
            columns = [pa.array(np.repeat(own["id"].to_numpy(), n), ids.type), pa.array(np.tile(others, len(semantic)), rows["t_id"].type)]
            meaning = semantic / MILLION + 0.0
            if ranking:
                ratio = np.stack([names.ratios(x) for x in own["tokens"].to_pylist()]) / SCORE
                score = ranking.scores(ratio, meaning) / SCORE
                columns += [pa.repeat(own["kind"][0], meaning.size), pa.array(ratio.ravel()), pa.array(meaning.ravel()), pa.array(score.ravel())]
            else:
                columns.append(pa.array(meaning.ravel()))
            batches.append(pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(c, x.type) for c, x in zip(titles, columns, strict=True)])))
        plain = {"id": queries["id"].type, "t_id": rows["t_id"].type, "kind": pa.string()}
        return pa.Table.from_batches(batches, batches[0].schema if batches else pa.schema([pa.field(c, plain.get(c, pa.float64())) for c in titles]))

    titles = ["id", "t_id", "kind", "lexical", "semantic", "score"] if ranking else ["id", "t_id", "semantic"]
    groups, types = _met(sources, targets, ranking is not None, PAIR_BLOCK)
    return groups.applyInArrow(every, ", ".join(f"{c} {types.get(c, 'double')}" for c in titles))
