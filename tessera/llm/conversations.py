"""Conversation structure repair: the cheapest edits that turn a conversation into `(s?(ua)+)?`, by an auction on a lattice.

A node of the lattice is (rows done, state): nothing yet, after the system row, after a user, after an assistant. Arcs are the
edits with their integer costs. Every node has a price; prices start at zero and satisfy price(x) <= cost(x, y) + price(y) all
along. An auction grows a path from its origin: where the price of the path's end is below the best of cost + price over
its arcs, the price rises to it and the path is cut back by a node; else the path is extended along the best arc. It ends at
the sink or at a node whose price is settled; then every price on the path is the distance to the sink. Origins are taken from the last row
to the first, so each auction is short and the work grows with the number of rows. The settled prices show the arcs that lie on
cheapest ways (price(x) = cost + price(y)); the trace takes the ASCII-least of them at each node.

Rows of a conversation come to one task in order and are streamed: the first pass carries a few bytes and a digest a row, no
text; the second reads texts one by one along the audit and hashes them as they come. What a task holds of a conversation is of the
order of the audit, which is one value of the result; texts are never gathered.

Defined cases: null role or text is one space, a null conv_id is a conversation of its own, a null turn comes first and has
no part in gaps; rows of one turn stand by role, then by digest of role and text; repeated rows are rows; an empty role has no
initial; texts of any length are handled whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE

#: States of the lattice, by number, and the role that comes next where a row is inserted or gets another role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: (state, initial of a kept row) to state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def arcs(at: int, rows: list[tuple[str, bool, bool]]) -> list[tuple[str, int, int]]:
    """(edit, cost, node) from a node, by the edit's letter. rows: (initial, must go, truncated); the node after the last is the sink."""
    i, state = divmod(at, 4)
    found = []
    if i < len(rows):
        initial, bad, cut = rows[i]
        found.append(("D", DELETE, at + 4))
        found.append(("I", INSERT, 4 * i + NEXT[state]))
        if not bad:
            if (state, initial) in KEPT:
                found.append(("K", CUT * cut, 4 * i + 4 + KEPT[state, initial]))
            found.append(("R", REROLE + CUT * cut, 4 * i + 4 + NEXT[state]))
    else:
        if state in (START, ASSISTANT):
            found.append(("", 0, 4 * len(rows) + 4))
        found.append(("I", INSERT, 4 * i + NEXT[state]))
    return found


def prices(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """Of all nodes and the sink, by auctions whose origins go from the last row to the first."""
    sink = 4 * len(rows) + 4
    price, settled = [0] * (sink + 1), bytearray(sink + 1)
    settled[sink] = 1
    for i in range(len(rows), -1, -1):
        ways = {at: arcs(at, rows) for at in range(4 * i, 4 * i + 4)}
        for origin in ways:
            path = [origin]
            while not settled[path[-1]]:
                end = path[-1]
                best, to = min((cost + price[node], node) for _, cost, node in ways[end])
                if price[end] < best:
                    price[end] = best
                    if end != origin:
                        path.pop()
                else:
                    path.append(to)
            for node in path:
                settled[node] = 1
    return price


def repaired(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least cost, and the initials of the edits: of the cheapest ones those that are least in ASCII."""
    price, at, audit, sink = prices(rows), 0, [], 4 * len(rows) + 4
    while at != sink:
        edit, at = next((edit, node) for edit, cost, node in arcs(at, rows) if price[at] == cost + price[node])
        audit.append(edit)
    return price[0], "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, gone, copy, role, text, mark (digest of role and text): what is left of each row; of a dropped row only `gone`."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), (F.crc32(key) % 20).alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"), role.alias("role"), text.alias("text"))
    return rows.withColumn("mark", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


def summaries(rows: DataFrame) -> DataFrame:
    """A row of SUMMARY for each conversation of damaged rows."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    small = rows.select("conv_id", "turn", "role", "mark", "copy", "gone", fault.alias("fault"))
    order = ["conv_id", "turn", "role", "mark", "copy"]

    def finished(conv_id, turns: tuple, steps: list) -> tuple:
        low, high, distinct = turns
        faults = [1 if blank else 2 if repeat else 3 if cut else 0 for _, blank, repeat, cut in steps]
        illegal = sum(x[0] + y[0] not in LEGAL for x, y in zip(steps, steps[1:], strict=False))
        cost, audit = repaired([(initial, fault in (1, 2), fault == 3) for (initial, *_), fault in zip(steps, faults, strict=True)])
        return conv_id, high - low + 1 - distinct if distinct else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, steps, seen, turns = None, False, [], set(), (0, 0, 0)
        for batch in it:
            done = []
            for conv_id, turn, role, mark, _, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != conv:
                    done.append(finished(conv, turns, steps))
                    steps, seen, turns = [], set(), (0, 0, 0)
                conv, begun = conv_id, True
                if gone:
                    continue
                if turn is not None:
                    low, high, distinct = turns
                    turns = (low, turn, distinct + (turn != high)) if distinct else (turn, turn, 1)
                steps.append((role[:1], fault == 1, mark in seen, fault == 2))
                seen.add(mark)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finished(conv, turns, steps), types, strict=True)], names=names)

    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    return small.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(batches, SUMMARY)


def repair(conversations: DataFrame) -> DataFrame:
    """SUMMARY and repaired_sha256 for each conv_id of a table of conv_id, turn, role, text."""
    rows = damaged(conversations)
    found = summaries(rows)
    wide = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "copy", "text", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SUMMARY.split(", ")[1:])])
    first = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("mark"),
                         F.lit(0).alias("copy"), F.lit("").alias("text"), *found.columns[1:])
    both = wide.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark", "copy")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, follow = None, None
        for batch in it:
            done = []
            heads = batch.select(["kind", "role", *names[:-1]])
            for i, (kind, role, *values) in enumerate(zip(*(c.to_pylist() for c in heads.columns), strict=True)):
                if kind == 0:
                    if follow:
                        done.append((*summary, follow.end()))
                    summary, follow = values, Followed(values[-1])
                else:
                    follow.row(role, batch.column(text_at)[i].as_py())  # one text at a time
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if follow:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*summary, follow.end()), types, strict=True)], names=names)

    names = [*found.columns, "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    text_at = both.columns.index("text")
    return both.mapInArrow(batches, f"{SUMMARY}, repaired_sha256 string")


class Followed:
    """The repaired conversation's hash, row by row along the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, START, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:".encode() + text.encode())
        self.empty = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self.put(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            self.put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.put(ROLE[self.state], text)

    def end(self) -> str:
        self.inserts()
        return self.hash.hexdigest()
