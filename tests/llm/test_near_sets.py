"""Near copies by exact similarity of word shingles, against brute force over all pairs."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_sets, simhash


def grams(text, k=5):
    w = (text or "").lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups(texts, least=Fraction(4, 5), k=5):
    """The texts' component numbers."""
    sets, root = [grams(t, k) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= least * union) if union else True:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def edited():
    """Texts of many lengths, each with copies of which more and more words are changed, put in or taken out."""
    rng, texts = random.Random(5), ["", None, " \n", "One two", "one TWO", "one two three"]
    for size in [*range(3, 40, 4), 60, 100, 250, 700]:
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for edits in range(0, 2 + size // 12):
            copy = list(base)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
            texts.append(" ".join(copy))
        texts += [" ".join(base[: int(size * 0.8) + 1]), " ".join(base + base[:2])]
    return texts


def test_every_similar_pair_shares_the_entries_it_needs(edited):
    for least in (Fraction(4, 5), Fraction(3, 5)):
        sets = [near_sets.shingle_set(t or "", 5) for t in edited]
        keys, needs = zip(*((set(k.tolist()), int(n.min())) for k, n in (near_sets.entries_of(s, least) for s in sets)), strict=True)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and near_sets.alike(sets[i], sets[j], least)]
        assert len(pairs) > 100
        assert all(len(keys[i] & keys[j]) >= min(needs[i], needs[j]) for i, j in pairs)


@pytest.mark.parametrize("shingle, similarity", [(5, 0.8), (3, 0.6)])
def test_keep_one_against_brute_force(spark, edited, shingle, similarity):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id bigint, text string")
    firsts = {}
    for i, g in enumerate(groups(edited, Fraction(str(similarity)), shingle)):
        firsts.setdefault(g, i)
    kept = simhash.keep_one(docs.repartition(3), shingle=shingle, similarity=similarity)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(firsts.values())


def test_fingerprints_find_most_similar_pairs_out_of_few(spark):
    """Of pairs right at the threshold nine tenths by common segments, of nearer ones more; few unlike pairs are fetched."""
    rng, texts, likely = random.Random(3), [], []
    for kind, words in (("near", 1), ("edge", 4)):
        for i in range(120):
            base = [f"{kind}{i}w{rng.randrange(10_000)}" for _ in range(200)]
            copy = list(base)
            for j in range(words):
                copy[20 + 40 * j] = "changed"
            likely.append((kind, len(texts), len(texts) + 1))
            texts += [" ".join(base), " ".join(copy)]
    sets = [grams(t) for t in texts]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for _, a, b in likely)
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(3)
    pairs = {(r.b, r.a) for r in near_sets.fetched(near_sets.segment_tables(rows, 5, 16), 0.8).collect()}
    assert {(a, b) for k, a, b in likely if k == "near"} <= pairs
    assert sum((a, b) in pairs for k, a, b in likely if k == "edge") >= 0.9 * 120
    assert len(pairs) < 300
    links = near_sets.verified(near_sets.fingerprint_pairs(rows, 5, 0.8), rows, 5, 0.8)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert sum(roots.get(a) == roots.get(b) is not None for _, a, b in likely) >= 0.9 * len(likely)


def test_dense_entries_give_stars(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)] + [" ".join([*base[:i], f"own{i}", *base[i + 1 :]]) for i in range(40, 100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    tables = near_sets.segment_tables(rows, 5, 8)
    every, stars = ({(r.a, r.b) for r in near_sets.fetched(tables, 0.8, d).collect()} for d in (64, 4))
    assert stars < every and len(every) == 61 * 60 // 2
    found = spark.createDataFrame(sorted(stars), "a bigint, b bigint")
    assert [r.n for r in simhash.components(found).groupBy("root").agg(F.count("*").alias("n")).collect()] == [61]


def test_the_stage_links_by_fingerprints_and_the_rest_by_sets(spark, edited, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id bigint, text string").repartition(3)
    asked, whole = [], near_sets.fingerprint_pairs
    monkeypatch.setattr(near_sets, "fingerprint_pairs", lambda *a: asked.append(1) or whole(*a))
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert asked
    monkeypatch.setattr(near_sets, "fingerprint_pairs", lambda texts, *_: whole(texts.limit(0), *_))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept


def test_keep_one_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = spark.createDataFrame(
        [(1, a, "x"), (None, a, "x"), (None, b, "x"), (2, c, "x"), (2, a, "x"), (3, d, "y"), (3, d, "x"), (3, d, None), (4, "e " * 9, "x"), (4, "e " * 9, "x"), (None, "f g", "x"), (None, "F g", "x"), (None, "h", None), (None, "h", None)],
        "doc_id bigint, text string, lang string",
    )
    kept = [tuple(r) for r in simhash.keep_one(docs.repartition(3)).collect()]
    by_text = sorted(((i or 0), t.lower()) for i, t, _ in kept)
    assert by_text == sorted([(1, a), (0, b), (2, c), (3, d), (4, "e " * 9), (0, "f g"), (0, "h")])
    assert set(kept) <= {tuple(r) for r in docs.collect()}


def test_a_large_group_of_copies_far_from_each_other(spark):
    """Copies of one text with a few words changed: linked through the text, or not at all; without it by shared changes."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            copy[at] = f"own{i}"
        texts.append(" ".join(copy))
        if i % 10 == 0:
            texts.append(" ".join([*copy[:-1], "last"]))
    for some in (texts, texts[1:]):
        docs = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
        firsts = {}
        for i, g in enumerate(groups(some)):
            firsts.setdefault(g, i)
        assert sorted(r.doc_id for r in simhash.keep_one(docs.repartition(3)).collect()) == sorted(firsts.values())
        assert 10 < len(firsts) < len(some)
