"""Candidates of the PII field: repeats of base matches in other forms, planted into given texts, and what must not be added."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from tessera.llm import pii


def spans(text, model=None):
    base = pii.base_spans(text)
    if model is None:
        return [text[s:e] for s, label, e in pii.candidates(text, base) if label < 0]
    return [(pii.KINDS[k], text[s:e]) for s, k, e in model.added(text, base)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("call 415 555 2671 415 555 2672 today +1 415 555 2671", ["415 555 2671", "415 555 2672"]),
        ("tel 4155552671 4155552672 4155552673 then +14155552672", ["4155552671", "4155552672", "4155552673"]),
        ("ip 10.0.0.1 and host 10.0.0.1:80 10-0-0-1", ["10-0-0-1"]),
        ("mail a.b@c.com or a.b (at) c (dot) com or x [at] y.org", ["a.b (at) c (dot) com", "x [at] y.org"]),
        ("no. 1234567 and 12 34", ["1234567"]),
        ("(415) 555-2671, +1 (415) 555-2671", ["(415) 555-2671"]),
        ("1 " * 40 + "+1 415 555 2671", []),
        ("2024 01 02 415-555-2671 2024 01 03 and +1 415 555 2671", ["2024 01 02", "415-555-2671", "2024 01 03"]),
    ],
)
def test_candidates_of_digit_groups(text, expected):
    assert spans(text) == expected


def test_long_parts_and_linear_time():
    local, host = "a" * 200, "-".join(["host"] * 60)
    text = f"{local}@{host}.example.org and {local} (at) {host} (dot) example (dot) org"
    assert spans(text) == [f"{local} (at) {host} (dot) example (dot) org"]
    for piece in ("1 ", "1234567 ", "(1", "a@", "a (at) ", "+1 4155552671 4155552671 ", "9" * 30 + " "):
        times = []
        for n in (4_000, 32_000):
            began = time.perf_counter()
            pii.candidates(piece * n, pii.base_spans(piece * n))
            times.append(max(time.perf_counter() - began, 0.02))
        assert times[1] < 30 * times[0]


def planted(rng, text, form):
    """The text with a base match at its start and a repeat of it in another form further on: (text, kind, repeat)."""
    a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
    if form == "phone":
        first, kind = f"+1 ({a}) {b}-{c}", "phone"
        repeat = rng.choice([f"{a} {b} {c}", f"{a}-{b}-{c}", f"1 {a} {b} {c}", f"({a}) {b} {c}", f"{a}{b}{c}"])
    elif form == "email":
        user, host = "".join(rng.choices("abcdefgh", k=7)), "".join(rng.choices("klmnop", k=6))
        first, kind = f"{user}@{host}.com", "email"
        repeat = rng.choice([f"{user} (at) {host} (dot) com", f"{user}[at]{host}[dot]com", f"{user} @ {host}.com"])
    else:
        parts = [rng.randrange(1, 255) for _ in range(4)]
        first, kind, repeat = ".".join(map(str, parts)), "ip", "-".join(map(str, parts))
    words = text.split(" ")
    words.insert(rng.randrange(len(words) // 2), first)
    words.insert(rng.randrange(len(words) // 2 + 1, len(words) + 1), repeat)
    return " ".join(words), kind, repeat


@pytest.fixture(scope="module")
def texts(documents):
    return [r.text for r in documents.orderBy("doc_id").collect() if r.text and 300 < len(r.text) < 6000]


def test_planted_repeats_are_found_and_others_are_not(texts):
    rng, docs = random.Random(4), []
    for i in range(240):
        text, kind, repeat = planted(rng, rng.choice(texts), ("phone", "email", "ip")[i % 3])
        if i % 4 == 0:  # numbers that repeat nothing
            text += f"\norder {rng.randrange(10**9, 10**10)} of {rng.randrange(10**7, 10**8)}"
        docs.append((text, kind, repeat))
    model = pii.fit(Counter(x for t in [*texts, *(d[0] for d in docs[:120])] for x in pii.situations(t)))
    hits, added = 0, 0
    for text, kind, repeat in docs[120:]:
        found = spans(text, model)
        hits += (kind, repeat) in found
        added += len(found)
    assert hits >= 0.9 * 120 and added <= hits + 6
    assert sum(len(spans(t, model)) for t in texts) == 0  # nothing in the texts as they were


def test_skip_weights_are_learnt_where_repeats_tell(monkeypatch):
    """From no prior attraction, repeats of known label raise the weight of equal numbers; without repeats it stays where the prior is."""
    rng = random.Random(5)
    numbers = [f"{rng.randrange(200, 999)}{rng.randrange(2000000, 9999999)}" for _ in range(80)]
    lone = [f"+1 {n} and so on" for n in numbers]
    same = [f"+1 {n} and again +1 {n}. " + "and so on " * 12 + f"+1 {n}" for n in numbers]
    learnt = lambda more: pii.fit(Counter(x for t in more for x in pii.situations(t))).skip
    assert np.allclose(learnt(lone), pii.PRIOR, atol=0.1)  # nothing to learn from
    monkeypatch.setattr(pii, "PRIOR", (0.0, 0.0))
    without, taught = learnt(lone), learnt([*lone, *same])
    assert without[0] < 0.05 and taught[0] > 0.3


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com", "x", 1)], "doc_id bigint, text string, spans string, n_email int")
    assert [tuple(r)[:2] + (r.spans,) for r in pii.find_pii(docs).collect()] == [(1, 1, "email:5:12")]
