"""Personal data by a skip-chain conditional random field.

Candidates are the base matches (e-mail, IP address, payment card, phone: fixed patterns) and wider ones: groups of digits
without the mark that the base asks for, and addresses that are spelled out. Numbers may stand side by side: of a row of digit groups those that repeat a
base match of the document, in whole or from its end, are candidates of their own, then what is left between them. A document's candidates are the field's
nodes, their labels O, email, ip, card or phone; a base match has its label given, and no candidate can have a label whose
rules it breaks (a card passes Luhn, an IP address has parts up to 255, a phone 7 to 15 digits, an e-mail an at sign). Unary
potentials come from features of the candidate and the words before it, transition potentials from neighbours in the text
(chain). Distant candidates that repeat the same digits or address, or the same last seven digits, are joined by skip edges,
to the one before and to the first base match of the key (or the first candidate): an edge favours equal labels, O as well as
others, so a repeat passes on what is known of it and makes no entity of nothing. Loopy sum-product passes messages until
the beliefs stand still; a free candidate with a belief of THRESHOLD or more in a label becomes a span. Base spans always stay.

All weights (features, chain, the skip edges' two) are fitted together by the pseudo-likelihood of the labels: each node's
label given its neighbours' labels. What that needs of a node, its situation, is one of a bounded number of small tuples; the
tasks count the situations over all documents, and only the counts come to the driver. Base matches teach the labels, others
count as O with weight UNLABELLED, but those that repeat a base match are unknown and left out. The skip edges' weights have a
Gaussian prior of one node's strength round PRIOR, which decides where documents hold no repeats of known label and gives way where they do. The features leave out the marks that define a base match, so that a repeat without its
mark is judged by the rest.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; an empty
table gives an empty result; equal beliefs go to the label that is named first. A text's memory grows with its candidates
alone; each has at most three edges back.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates beyond the base: rows of digit groups, at signs in any form, and what may follow them.
ROW = re.compile(r"\(?[0-9](?:[0-9().\x20-]*[0-9])?")
GROUP = re.compile(r"[0-9]+")
AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?", re.I | re.A)
HOST = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,})+", re.I | re.A)
#: Digits of a candidate, and the digits by which numbers are like each other.
FEWEST, MOST, LAST = 7, 19, 7
ANY = re.compile(r"[0-9@\[(]")
LABELS = ("O", *KINDS)
SEPARATOR = re.compile(r"[^0-9]+")
#: What a candidate without a base match weighs in the fit: it is unlabelled rather than O.
UNLABELLED = 0.2
THRESHOLD = 0.8
WORDS_BEFORE = {"tel": 0, "phone": 0, "call": 0, "mobile": 0, "fax": 0, "mail": 1, "email": 1, "contact": 1, "ip": 2, "host": 2, "server": 2, "card": 3, "visa": 3, "pay": 3}
N_FEATURES = 16
#: Skip edges: repeats of the same key, and of its last seven digits. Chain edges are of kind 0.
CHAIN, SAME, SIMILAR = 0, 1, 2
#: Message passing ends when no message changes by more than this, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 400
#: Gradient steps of the fit, and its ridge penalty.
STEPS, RIDGE = 400, 1e-3
PRIOR = (4.0, 2.0)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of `[A-Za-z0-9._%+-]+` and DOMAIN, found from the @ signs: linear in the text."""
    found, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            free = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in the order of the digest."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def spelled(text: str) -> list[tuple[int, int]]:
    """Addresses with an at sign in any form, found from the signs: linear in the text."""
    found, free = [], 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if host and start < m.start() and start >= free:
            found.append((start, host.end()))
            free = host.end()
    return found


class Known:
    """The numbers among a document's base matches, to tell their repeats: all their ends of LAST digits and more, and IP addresses by their parts."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.whole, self.ends, self.ips = set(), set(), set()
        for s, kind, e in base:
            if kind == 1:
                self.ips.add(tuple(GROUP.findall(text[s:e])))
            elif kind > 1:
                digits = digits_of(text[s:e])
                self.whole.add(digits)
                self.ends.update(digits[i:] for i in range(len(digits) - LAST + 1))

    def repeats(self, digits: str) -> bool:
        return digits in self.ends or any(digits[i:] in self.whole for i in range(1, len(digits) - LAST + 1))


def numbers_of(text: str, start: int, end: int, known: Known) -> list[tuple[int, int]]:
    """Candidates in a row of digit groups: the longest repeats from left to right, then what is between them as a whole or, of more than MOST
    digits, group by group."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    found, first = [], 0

    def left(i: int, j: int) -> None:
        """The groups i to j (not included), which repeat nothing."""
        digits = sum(e - s for s, e in groups[i:j])
        if FEWEST <= digits <= MOST:
            found.append((groups[i][0], groups[j - 1][1]))
        elif digits > MOST:
            found.extend((s, e) for s, e in groups[i:j] if FEWEST <= e - s <= MOST)

    i = 0
    while i < len(groups) and (known.whole or known.ips):
        digits, last = "", -1
        for j in range(i, len(groups)):
            s, e = groups[j]
            if len(digits) + e - s > MOST:
                break
            digits += text[s:e]
            ip = j == i + 3 and tuple(text[a:b] for a, b in groups[i : j + 1]) in known.ips
            if ip or (len(digits) >= FEWEST and known.repeats(digits)):
                last = j
        if last >= 0:
            left(first, i)
            found.append((groups[i][0], groups[last][1]))
            first = i = last + 1
        else:
            i += 1
    left(first, len(groups))
    return [(s - (s > start and text[s - 1] == "(") if s > start else start, e) for s, e in found]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, label or -1, end): base matches with their labels, then others that overlap none of them."""
    nodes = [(s, k + 1, e) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []

    def free(s: int, e: int) -> bool:
        at = np.searchsorted(starts, e)
        return not (at and ends[at - 1] > s)

    wide = [(s, e) for s, e in spelled(text) if free(s, e)]
    nodes += [(s, -1, e) for s, e in wide]
    known = Known(text, base)
    for m in ROW.finditer(text):
        s, e = m.span()
        while s < e:  # what base matches leave of the row
            at = np.searchsorted(starts, s, "right")
            if at and ends[at - 1] > s:
                s = int(ends[at - 1])
                continue
            stop = min(e, starts[at]) if at < len(starts) else e
            if stop > s:
                nodes += [(x, -1, y) for x, y in numbers_of(text, s, stop, known)]
            s = stop
    if wide:  # a number inside a spelled address is part of it
        nodes = sorted(nodes)
        kept, reach = [], -1
        for x, label, y in nodes:
            if label < 0 and x < reach and not ("@" in text[x:y] or AT.search(text, x, y)):
                continue
            reach = max(reach, y)
            kept.append((x, label, y))
        return kept
    return sorted(nodes)


def key_of(span: str) -> str:
    digits, groups = digits_of(span), GROUP.findall(span)
    if len(groups) == 4 and not any(c.isalpha() for c in span) and all(len(g) <= 3 and int(g) <= 255 for g in groups) and len(set(SEPARATOR.findall(span))) == 1:
        return ".".join(groups)  # an IP address, whatever parts it
    if "@" in span or len(digits) < 7:
        return re.sub(r"[^a-z0-9]", "", re.sub(r"[\[(](at|dot)[\])]", "", span.lower()))
    return digits


def features(text: str, start: int, end: int) -> np.ndarray:
    """Of the candidate less its defining marks, and of the words before it."""
    span, out = text[start:end], np.zeros(N_FEATURES)
    digits = digits_of(span)
    letters = sum(c.isalpha() for c in span)
    out[0] = 1
    out[1] = letters > 0
    out[2] = not letters and len(digits) < 9
    out[3] = not letters and 9 <= len(digits) <= 11
    out[4] = not letters and 12 <= len(digits) <= 15
    out[5] = not letters and len(digits) >= 16
    out[6] = len(digits) >= 12 and luhn(digits)
    out[7] = span.count(".") == 3 and len(digits) <= 12
    out[8] = "(" in span
    out[9] = "-" in span
    out[10] = " " in span
    for word in re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])[-3:]:
        if word.lower() in WORDS_BEFORE:
            out[11 + WORDS_BEFORE[word.lower()]] = 1
    return out


def allowed(span: str) -> np.ndarray:
    """Which labels the candidate may have."""
    digits = digits_of(span)
    parts = span.split(".")
    return np.array(
        [
            True,
            "@" in span or re.search(r"[\[(]at[\])]", span, re.I) is not None,
            (len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)) or key_of(span).count(".") == 3,
            12 <= len(digits) <= 19 and luhn(digits) and "." not in span,
            7 <= len(digits) <= 15 and not any(c.isalpha() for c in span),
        ]
    )


def edges_of(text: str, nodes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes and the kind of their edge. A repeat is joined to the one before and to its key's first base match or first node."""
    pairs, kinds, heads, before = [], [], {}, {}
    keys = [key_of(text[s:e]) for s, _, e in nodes]
    names = [[(SAME, key), (SIMILAR, key[-7:])] if key.isdigit() else [(SAME, key)] for key in keys]
    for i, (_, label, _) in enumerate(nodes):
        for name in names[i]:
            if name not in heads or (label > 0 and nodes[heads[name]][1] <= 0):
                heads[name] = i
    for i, (s, _, _) in enumerate(nodes):
        if i and s - nodes[i - 1][2] <= 80:
            pairs.append((i - 1, i))
            kinds.append(CHAIN)
        joined = set()
        for name in names[i]:
            for j in (before.get(name), heads[name]):
                if j is not None and j != i and j not in joined and not (name[0] == SIMILAR and keys[i] == keys[j]):
                    joined.add(j)
                    pairs.append((j, i))
                    kinds.append(name[0])
            before[name] = i
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


def beliefs(unary: np.ndarray, pairs: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product. unary: nodes x labels, log; tables: edges x labels x labels, log. Gives the nodes' marginals."""
    count, labels = unary.shape
    if len(pairs):
        ends = np.concatenate([pairs, pairs[:, ::-1]])
        log = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        sent = np.zeros((len(ends), labels))
        for _ in range(rounds):
            gathered = unary.copy()
            np.add.at(gathered, ends[:, 1], sent)
            rest = gathered[ends[:, 0]] - sent[back]
            new = np.logaddexp.reduce(rest[:, :, None] + log, axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new
            if change < TOLERANCE:
                break
        unary = unary.copy()
        np.add.at(unary, ends[:, 1], sent)
    unary = unary - unary.max(axis=1, keepdims=True)
    out = np.exp(unary)
    return out / out.sum(axis=1, keepdims=True)


class Model:
    """Weights of the unary features (features x labels), log potentials of neighbouring labels, and of equal ones across skip edges."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the spans that the field adds."""
        nodes = candidates(text, base)
        if all(label >= 0 for _, label, _ in nodes):
            return []
        unary = np.array([features(text, s, e) for s, _, e in nodes]) @ self.weights
        for i, (s, label, e) in enumerate(nodes):
            may = np.arange(len(LABELS)) == label if label >= 0 else allowed(text[s:e])
            unary[i, ~may] = -50.0
        pairs, kinds = edges_of(text, nodes)
        tables = np.stack([self.chain, *(w * np.eye(len(LABELS)) for w in self.skip)])[kinds]
        found = beliefs(unary, pairs, tables)
        best = found.argmax(axis=1)
        return [(s, int(best[i]) - 1, e) for i, (s, label, e) in enumerate(nodes) if label < 0 and best[i] and found[i, best[i]] >= THRESHOLD]


#: A situation: features as bits, label, what may be, labels of the neighbours in the text (-1: none), and for both kinds of
#: skip edges the numbers of neighbours of each label, 2 at most.
def situations(text: str) -> list[tuple]:
    nodes = candidates(text, base_spans(text))
    pairs, kinds = edges_of(text, nodes)
    labels = [max(0, label) for _, label, _ in nodes]
    unknown = [False] * len(nodes)
    for (i, j), kind in zip(pairs.tolist(), kinds.tolist(), strict=True):
        if kind != CHAIN:
            unknown[i] |= nodes[i][1] < 0 < nodes[j][1]
            unknown[j] |= nodes[j][1] < 0 < nodes[i][1]
    before, after = [-1] * len(nodes), [-1] * len(nodes)
    skips = np.zeros((len(nodes), 2, len(LABELS)), np.int64)
    for (i, j), kind in zip(pairs.tolist(), kinds.tolist(), strict=True):
        for one, other, side in ((i, j, after), (j, i, before)):
            if unknown[other]:
                continue
            if kind == CHAIN:
                side[one] = labels[other]
            else:
                skips[one, kind - 1, labels[other]] += 1
    bits = 1 << np.arange(N_FEATURES)
    powers = 3 ** np.arange(2 * len(LABELS))
    out = []
    for i, (s, label, e) in enumerate(nodes):
        if unknown[i]:
            continue
        may = allowed(text[s:e]) | (np.arange(len(LABELS)) == label)
        feature_bits, may_bits = int(features(text, s, e) @ bits), int(may @ bits[: len(LABELS)])
        out.append((feature_bits, may_bits, labels[i], before[i], after[i], int(np.minimum(skips[i], 2).ravel() @ powers)))
    return out


def pseudo_likelihood(rows: np.ndarray, counts: np.ndarray) -> tuple[Callable, int]:
    """A function from parameters to (minus log pseudo-likelihood a node, gradient), and the number of parameters."""
    size = len(LABELS)
    x = (rows[:, :1] >> np.arange(N_FEATURES) & 1).astype(float)
    may = (rows[:, 1:2] >> np.arange(size) & 1).astype(bool)
    label, before, after = rows[:, 2], rows[:, 3], rows[:, 4]
    skips = (rows[:, 5:6] // 3 ** np.arange(2 * size) % 3).astype(float).reshape(-1, 2, size)
    trust = np.where(label == 0, UNLABELLED, 1.0) * counts
    nodes = trust.sum()
    trust = trust / max(1.0, nodes)
    y = np.eye(size)[label]
    left, right = np.eye(size)[before] * (before >= 0)[:, None], np.eye(size)[after] * (after >= 0)[:, None]
    n_unary, n_chain = N_FEATURES * size, size * size
    prior = np.concatenate([np.zeros(n_unary + n_chain), PRIOR])
    # the skip edges' prior weighs as one node of all, the ridge of the other weights as a fixed share
    ridge = np.concatenate([np.full(n_unary + n_chain, RIDGE), np.full(2, min(RIDGE, 1 / max(1.0, nodes)))])

    def parts(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return theta[:n_unary].reshape(N_FEATURES, size), theta[n_unary : n_unary + n_chain].reshape(size, size), theta[n_unary + n_chain :]

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, chain, skip = parts(theta)
        score = x @ weights + left @ chain + right @ chain.T + skips[:, 0] * skip[0] + skips[:, 1] * skip[1]
        score = np.where(may, score, -50.0)
        score = score - score.max(axis=1, keepdims=True)
        log = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        off = (np.exp(log) - y) * trust[:, None]
        off = np.where(may, off, 0.0)
        own = [x.T @ off, left.T @ off + off.T @ right, np.array([(skips[:, k] * off).sum() for k in range(2)])]
        value = -(trust[:, None] * y * log).sum() + 0.5 * (ridge * (theta - prior)) @ (theta - prior)
        return value, np.concatenate([g.ravel() for g in own]) + ridge * (theta - prior)

    loss.parts, loss.prior = parts, prior
    return loss, n_unary + n_chain + 2


def fit(counted: dict[tuple, int]) -> Model:
    """Adaptive gradient steps on the pseudo-likelihood of counted situations, in their sorted order."""
    keys = sorted(counted)
    rows, counts = np.array(keys, np.int64).reshape(-1, 6), np.array([counted[k] for k in keys], float)
    loss, size = pseudo_likelihood(rows, counts)
    theta, squares = loss.prior.copy(), np.full(size, 1e-8)
    for _ in range(STEPS):
        _, slope = loss(theta)
        squares += slope * slope
        theta -= 0.3 * slope / np.sqrt(squares)
    weights, chain, skip = loss.parts(theta)
    return Model(weights, chain, np.maximum(skip, 0.0))


def counted_situations(docs: DataFrame) -> dict[tuple, int]:
    """How often each situation occurs in all documents. At most one row a situation comes to the driver."""
    names = ["features", "may", "label", "before", "after", "skips"]
    schema = ", ".join(f"{n} bigint" for n in names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in it:
            for value in batch.column(0):
                if ANY.search(text := value.as_py()):  # one text at a time is a Python string
                    counts.update(situations(text))
        rows = [(*key, n) for key, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[*names, "n"])

    parts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(batches, f"{schema}, n bigint")
    return {tuple(r)[:-1]: r[-1] for r in parts.groupBy(*names).agg(F.sum("n").alias("n")).collect()}


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added)."""
    model = fit(counted_situations(docs))

    def per_text(text: str) -> tuple:
        if not ANY.search(text):
            return 0, 0, 0, 0, NOTHING, ""
        base = base_spans(text)
        counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
        digest = hashlib.sha256(listed(base).encode()).hexdigest()
        return *counts, digest, listed(base + model.added(text, base))

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_texts(docs.select("doc_id", "text"), per_text, schema)


NOTHING = hashlib.sha256(b"").hexdigest()
