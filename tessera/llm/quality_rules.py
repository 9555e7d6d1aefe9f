"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a cheap test on the whole text. On a bounded sample each rule's cost (seconds for the sample) and selectivity
(share it rejects) are estimated; the rules then run in the order of rejection per cost, and what a later rule needs is not
computed for a document that an earlier one has rejected. The order changes the work, never the verdict.

`filter_quality` runs all rules that way. `score_quality` also returns the measures of the base rules, which are so computed
for every document; the base rules come first there, at no cost, and the other rules' measures are computed only for what is left.

Defined cases: a null text is an empty one (no words, so it fails `short`); a null doc_id stays null; repeated rows give
repeated rows; an empty table gives an empty result; other columns are passed on untouched by `filter_quality`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, text_of, words_of

#: Length of the word windows whose repeats count.
WINDOW = 8
#: Rows of the sample on which cost and selectivity of the rules are estimated. It decides the order only.
SAMPLE_ROWS = 1000


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in this text, the first find included.

    Each window becomes one long: as many upper bits of its hash as fit above its position. Sorted, equal windows are
    neighbours; neighbours are confirmed on the words' own hashes. One row's arrays are all that is held.
    """

    def covered(hashes: Column, count: Column) -> Column:
        bits = F.length(F.bin(count)).cast("int")

        def packed(shift: Column) -> Column:
            one = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])
            return F.transform(
                F.sequence(F.lit(0), count - window),
                lambda i: F.call_function("shiftleft", one(i), shift).bitwiseOR(i.cast("bigint")),
            )

        def place(value: Column, shift: Column) -> Column:
            return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1).cast("int")

        def same(a: Column, b: Column, shift: Column) -> Column:
            """Equal upper bits, then equal words, by their hashes."""
            upper = F.call_function("shiftright", a, shift) == F.call_function("shiftright", b, shift)
            slices = F.slice(hashes, place(a, shift) + 1, window) == F.slice(hashes, place(b, shift) + 1, window)
            return upper & slices

        def spots(ordered: Column, shift: Column) -> Column:
            twice = F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda i: F.coalesce((i > 0) & same(F.get(ordered, i), F.get(ordered, i - 1), shift), F.lit(False))
                | F.coalesce(same(F.get(ordered, i), F.get(ordered, i + 1), shift), F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda i: place(F.get(ordered, i), shift)))

        def total(shift: Column) -> Column:
            return F.aggregate(
                let(F.sort_array(packed(shift)), lambda ordered: spots(ordered, shift)),
                F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("sum")),
                lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(window), at - acc["last"])).alias("sum")),
                lambda acc: acc["sum"],
            )

        return let(bits, total)

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: covered(hashes, F.size(hashes)))
    return F.when(F.size(words) > window, counted).otherwise(F.lit(0).cast("bigint"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    return let(with_word, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))


def metrics(text: Column, words: Column) -> dict[str, Column]:
    """The measures that the rules compare, each as a column over the whole text."""
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("bigint"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
        "n_capitals": (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("bigint"),
        "n_lines": F.size(F.split(text, "\n")).cast("bigint"),
        "n_stutter": F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: a.eqNullSafe(b)), lambda x: x)).cast("bigint"),
    }


@dataclass(frozen=True)
class Rule:
    """fails takes a lookup of metric columns and gives the column that is true where the text is rejected."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("short", lambda m: m("n_words") < 20),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: Beyond the base: symbols, capitals, repeated lines, words said over and over, and word lengths outside what prose has.
RULES = BASE + (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
    Rule("lines", lambda m: (m("n_dup_lines") >= 5) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("stutter", lambda m: 100 * m("n_stutter") > 30 * m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") > 20 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) on a sample of at most sample_rows rows, by rejection per cost, highest first.

    The sample is the first rows that Spark gives; their texts stay in the tasks, only the rules' answers come back. Reading
    it costs the same however large the table is. A rule's cost is what testing it takes longer than reading alone.
    """

    def timed(answer: Column) -> tuple[float, float]:
        tested = docs.select(answer.cast("double").alias("failed"))
        seconds = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            answers = [row.failed for row in tested.take(sample_rows)]
            seconds.append(time.perf_counter() - began)
        return sum(answers) / max(1, len(answers)), min(seconds)

    def failing(rule: Rule) -> Callable[[Column], Column]:
        return lambda words: rule.fails(metrics(text, words).__getitem__)

    text = text_of()
    _, reading = timed(F.char_length(text) < 0)
    found = []
    for rule in rules:
        share, seconds = timed(let(words_of(text), failing(rule)))
        found.append((rule, share, max(seconds - reading, 1e-3)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def verdict(order: list[Rule], lookup: Callable[[str], Column]) -> Column:
    """Name of the first rule in this order that rejects the text, null if none does. CASE tests no further than that."""
    first, *rest = order
    cascade = F.when(first.fails(lookup), F.lit(first.name))
    for rule in rest:
        cascade = cascade.when(rule.fails(lookup), F.lit(rule.name))
    return cascade


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs."""
    order = [rule for rule, _, _ in rule_order(docs, rules, sample_rows)]
    text = text_of()
    # the words are bound inside the condition: a column of them would be split again at each place once Spark pushes the filter down
    rejected = let(words_of(text), lambda words: verdict(order, metrics(text, words).__getitem__))
    return docs.where(rejected.isNull())


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES[len(BASE) :], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the base rules' measures, base_failed, kept and the rule that rejected it (base rules, then `rules` in the cascade's order)."""
    order = [*BASE, *(rule for rule, _, _ in rule_order(docs, rules, sample_rows))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    prepared = docs.select("doc_id", text_of().alias("_text")).withColumn("_words", words_of(F.col("_text")))
    every = metrics(F.col("_text"), F.col("_words"))
    measured = prepared.select("doc_id", "_text", "_words", *[every[n].alias(n) for n in names])
    # finished measures are columns; the others are computed where CASE gets to them
    rejected = verdict(order, lambda name: F.col(name) if name in names else every[name])
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.fails(F.col)
    return measured.select("doc_id", *names, base.alias("base_failed"), rejected.alias("rejected_by")).select(
        "doc_id", *names, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )
