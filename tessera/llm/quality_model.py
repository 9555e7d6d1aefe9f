"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

1. Document statistics of the whole text (lengths, shares of characters and words, repeats) are computed once per document.
2. Random Fourier features (fixed seed) of the standardised statistics approximate a Gaussian kernel.
3. Each partition sums its part of the normal equations over its labelled rows; Spark adds the parts, entry by entry; the
   driver gets D x D numbers, however many rows there are, and solves for the ridge weights. Statistics and features are
   summed as whole numbers of small units, so sums are exact and the same however rows are split or come back from a lost task.
4. Scores of the labelled rows are counted in BINS steps (a table of fixed size) and made monotone by pooling adjacent
   violators: the calibrated score is the share of label 1 at that score.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0; doc_id, lang, source and labels are no input.

Defined cases: a null or empty text has all statistics zero and gets a score like any other; a null doc_id is not held out
and has no label; a document with several labels counts once for each; labels other than 0 and 1 are left out; without any
label every score is 0.5; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, saved

N_STATS, N_FEATURES, SEED, GAMMA, RIDGE, BINS, FOLDS = 16, 192, 7, 0.08, 1.0, 1000, 5
#: Units of a feature and of a statistic. Products of two features are below 2**32 units: 2**21 rows of a batch add up exactly.
UNIT, STAT_UNIT = 2**16, 2**20
PUNCTUATION = re.compile(r"[.,;:!?]")
SYMBOLS = re.compile(r"[#*$%&|<>~^=+{}\\/@]")


def statistics(text: str) -> list[float]:
    """N_STATS numbers of the whole text, each of moderate size."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_STATS
    counts = Counter(words)
    lines = text.split("\n")
    sizes = [len(w) for w in words]
    capitals = sum(map(str.isupper, words))
    neighbours = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        sum(sizes) / n,
        float(np.std(sizes)),
        4 * len(counts) / n,
        4 * neighbours / n,
        4 * pairs / n,
        4 * counts.most_common(1)[0][1] / n,
        4 * min(2.0, len(SYMBOLS.findall(text)) / n),
        4 * min(2.0, text.count("!") / n),
        4 * min(2.0, text.count("|") / n),
        4 * min(2.0, len(PUNCTUATION.findall(text)) / n),
        4 * capitals / n,
        4 * sum(w[0].isupper() for w in words) / n,
        8 * sum(map(str.isdigit, text)) / chars,
        4 * len(set(lines)) / len(lines),
    ]


def random_features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """sqrt(2/D) cos(Wx + b) of the standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, np.sqrt(2 * GAMMA), (N_STATS, N_FEATURES))
    b = rng.uniform(0, 2 * np.pi, N_FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / N_FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_STATS)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over rows of stats, from exact sums of whole units."""
    units = F.rint(F.col("v") * STAT_UNIT).cast("decimal(18,0)")
    sums = rows.select(F.posexplode("stats").alias("i", "v")).select("i", units.alias("u")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))
    mean, scale = np.zeros(N_STATS), np.ones(N_STATS)
    for m in sums.collect():  # N_STATS rows
        s, q, n = int(m.s), int(m.q), m.n
        mean[m.i], scale[m.i] = s / n / STAT_UNIT, max(((n * q - s * s) ** 0.5) / n / STAT_UNIT, 1e-6)
    return mean, scale


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over rows of stats, quality: one partial sum a partition, added by Spark."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2), dtype=np.int64)
        for batch in it:
            if batch.num_rows:
                x = np.rint(UNIT * random_features(matrix(batch.column(0)), mean, scale))
                total += (x.T @ np.hstack([x, UNIT * np.asarray(batch.column(1), dtype=float)[:, None]])).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    parts = rows.select("stats", F.col("quality").cast("double")).mapInArrow(sums, "cell bigint, part bigint")
    added = parts.groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    total = np.zeros((N_FEATURES + 1) * (N_FEATURES + 2))
    for row in added.collect():  # (D + 1)(D + 2) cells
        total[row.cell] = float(row.total) / UNIT**2
    total = total.reshape(N_FEATURES + 1, N_FEATURES + 2)
    return total[:, :-1], total[:, -1]


def pooled(steps: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the monotone share of ones for each occupied step, carried on to the empty ones."""
    stack: list[list[float]] = []
    for step, one, count in zip(steps.tolist(), ones.tolist(), counts.tolist(), strict=True):
        stack.append([step, one, count])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            step_, one_, count_ = stack.pop()
            stack[-1] = [stack[-1][0], stack[-1][1] + one_, stack[-1][2] + count_]
    at = np.array([s for s, _, _ in stack])
    share = np.array([(o + 0.5) / (c + 1) for _, o, c in stack])
    return np.interp(np.arange(BINS + 1), at, np.maximum.accumulate(share))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs."""
    stats = saved(map_texts(docs.select("doc_id", "text"), lambda t: (statistics(t),), "doc_id bigint, stats array<double>"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    training = saved(stats.where(~held_out()).join(known, "doc_id").select("stats", "quality"))
    mean, scale = moments(training)
    xx, xy = normal_equations(training, mean, scale)
    weights = np.linalg.solve(xx + RIDGE * np.eye(len(xx)), xy)

    whole = np.rint(weights * STAT_UNIT)  # a score is exact too, whatever batch its row is in

    def raw(column: pa.Array) -> np.ndarray:
        values = np.rint(UNIT * random_features(matrix(column), mean, scale)) @ whole / (UNIT * STAT_UNIT)
        return np.rint(np.clip(values, -0.5, 1.5) * BINS / 2 + BINS / 4).astype(np.int64)

    def steps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(raw(batch.column(0))), batch.column(1)], names=["step", "quality"])

    counted = training.mapInArrow(steps, "step bigint, quality int").groupBy("step").agg(F.sum("quality").alias("ones"), F.count(F.lit(1)).alias("n"))
    found = sorted((r.step, r.ones, r.n) for r in counted.collect())  # at most BINS + 1 rows
    curve = pooled(*map(np.array, zip(*found, strict=True))) if found else np.full(BINS + 1, 0.5)

    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve[raw(batch.column(1))])], names=["doc_id", "score"])

    scored = stats.mapInArrow(scores, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
