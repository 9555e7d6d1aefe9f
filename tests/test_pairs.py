"""Queries against all rows in blocks: brute force, odd vectors and names, and what is not made on the way."""

import math
import random

import pytest

from tessera.operators import matching, measure, pairs
from tessera.plans import QUERIES

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def joined(spark, run):
    """The most rows that a join put out in the executions that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    known = set(ids())
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for i in set(ids()) - known:
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            metrics = [n.metrics().apply(j) for j in range(n.metrics().size())]
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows" and "Join" in n.name()]
            most = max([most, *[int(v.get().split("\n")[-1].split(" ")[0].replace(",", "")) for v in found if v.isDefined()]])
    return most


@pytest.mark.parametrize("name", ["c16_bands", "f06_hits", "c26_evidence", "c15_duplicates", "f03_weight_sweep", "s13_candidate_file", "c09_top_candidates", "j07_ranking_summary", "c05_cosine"])
def test_joins_do_not_make_all_pairs(spark, name):
    """sf0.1 has 19,980 pairs of a query and another row of its kind."""
    assert 0 < joined(spark, lambda: QUERIES[name](spark, SF).collect()) < 5000


def half_up(x, digits):
    x *= 10.0**digits
    return (math.floor(x) + (x - math.floor(x) >= 0.5)) / 10.0**digits


def ratio(a, b):
    a, b = (" ".join(sorted(n.split(" "))) for n in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
    return half_up(2.0 * row[-1] / (len(a) + len(b)), 4) if a and b else 0.0


def cosine(x, y):
    dot = 0.0
    if x is None or y is None or None in x or None in y or len(x) != len(y):
        return 0.0
    for a, b in zip(x, y, strict=True):
        dot += a * b
    return 1.0 if math.isnan(dot) else min(1.0, max(0.0, dot))


def brute(own, others):
    """id, t_id, kind, lexical, semantic, score of all pairs of one kind."""
    out = []
    for i, kind, name, x in own:
        for j, other, label, y in others:
            if kind == other is not None and None not in (name, label) and i != j:
                lexical, semantic = ratio(name, label), half_up(cosine(x, y), 6)
                out.append((i, j, kind, lexical, semantic, half_up((0.4 * lexical + 0.6 * semantic) / 1.0, 4)))
    return out


def odd_table():
    """Names that are empty, missing, long or in other letters; vectors that are equal, missing, short, zero, long or not numbers."""
    rng = random.Random(3)
    words = ["ring", "bolt", "gear", "größe", "x", "plate", "a" * 80]
    table = []
    for i in range(240):
        v = [rng.choice([0.5, -0.5, 0.25, 1 / 128, 0.1, rng.gauss(0, 0.4)]) for _ in range(6)]
        v = {0: None, 1: [*v[:5], None], 2: v[:4], 3: [0.0] * 6, 4: [math.nan, *v[1:]], 5: [1e200 * x for x in v], 6: [math.inf, *v[1:]], 7: []}.get(i % 40, v)
        name = {0: "", 1: None, 2: " ".join(words)}.get(i % 30, " ".join(rng.sample(words, 2)))
        table.append((i, None if i == 77 else "ab"[i % 3 == 0], name, v))
    return table + [(i + 300, *table[i][1:]) for i in range(100, 160)]


@pytest.fixture
def odd(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 37)  # many blocks of either side
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 29)
    table = odd_table()
    return table, spark.createDataFrame(table, "id bigint, kind string, norm string, embedding array<double>")


def best(found, k, key):
    by_id = {}
    for r in found:
        by_id.setdefault(r[0], []).append(r)
    return [(*r, n + 1) for some in by_id.values() for n, r in enumerate(sorted(some, key=key)[:k])]


def test_best_pairs_are_those_of_all_pairs(odd):
    table, df = odd
    found = brute([r for r in table if r[0] % 5 == 0], table)
    order = lambda r: (-r[5], -r[3], r[1])
    for k in (1, 3, 20):
        assert rows(matching.top_candidates(matching.best_pairs(df.where("id % 5 = 0"), df, k), k)) == sorted(best(found, k, order), key=repr)


def test_scores_are_rounded_as_in_sql(spark):
    """0.4 * 0.3529 + 0.6 * 0.10515: the shortest decimals of the double are 0.20425, but ten thousand times the double is below 2042.5."""
    found = QUERIES["c07_hybrid"](spark, SF).where("id = 200 and t_id = 906")
    assert rows(found.select("lexical", "semantic", "score")) == [(0.3529, 0.10515, 0.2042)]


def near(table, chosen):
    """id, t_id, distance of all pairs of one kind."""
    return [(i, j, half_up(1 - cosine(x, y), 6)) for i, kind, _, x in table if chosen(i) for j, other, _, y in table if kind == other is not None and i != j]


def test_nearest_are_those_of_all_pairs(odd):
    table, df = odd
    found = near(table, lambda i: i % 5 == 0)
    for k in (1, 10, 20):
        assert rows(matching.nearest(df.where("id % 5 = 0"), df, k)) == sorted(best(found, k, lambda r: (r[2], r[1])), key=repr)


def test_right_ones_without_the_pairs_of_a_class(spark):
    rng = random.Random(5)
    table = [(i, None if i % 19 == 0 else 99 if i == 40 else rng.randrange(6)) for i in range(200)]
    own = spark.createDataFrame(table, "id bigint, class int")
    sources = own.where("id % 4 = 0")
    gold = spark.createDataFrame([(i, j) for i, a in table if i % 4 == 0 for j, b in table if a == b is not None and i != j], "id bigint, t_id bigint")
    lists = spark.createDataFrame([(i, j, r + 1) for i in range(0, 200, 4) if i % 3 for r, j in enumerate(rng.sample(range(200), 12))], "id bigint, t_id bigint, rank int")
    found = rows(measure.hits(lists, gold))
    assert found[0][0] < 50 and found[0][4] > 0
    assert rows(measure.hits(lists, measure.right_among(lists, sources, own))) == found


def test_duplicates_are_those_of_all_pairs(odd):
    table, df = odd
    found, expected = brute([r for r in table if r[0] % 5 == 0], table), []
    for i in {r[0] for r in found}:
        own = [r for r in found if r[0] == i]
        by_score, by_name = min(own, key=lambda r: (-r[5], -r[3], r[1])), min(own, key=lambda r: (-r[3], -r[5], r[1]))
        if by_score[5] >= 0.75 or by_name[3] >= 0.95:
            similar = by_score[5] >= 0.75
            expected.append((i, by_score[1] if similar else by_name[1], "similar" if similar else "same_name", by_score[5], by_name[3]))
    assert {r[2] for r in expected} == {"similar", "same_name"}
    some = matching.best_pairs(df.where("id % 5 = 0"), df, 1, matching.BY_SCORE, matching.BY_NAME)
    assert rows(matching.possible_duplicates(some)) == sorted(expected, key=repr)


def test_pairs_of_a_sweep_hold_the_best_of_each_weight(odd):
    table, df = odd
    found = brute([r for r in table if r[0] % 5 == 0], table)
    some = {(r.id, r.t_id) for r in matching.best_pairs(df.where("id % 5 = 0"), df, 3, *[pairs.Ranking(w, 1 - w) for w in (0.0, 0.4, 1.0)]).collect()}
    assert len(some) < len(found) / 5
    for w in (0.0, 0.4, 1.0):
        assert {r[:2] for r in best(found, 3, lambda r: (-half_up(w * r[3] + (1 - w) * r[4], 4), -r[3], r[1]))} <= some


def test_all_pairs_in_blocks(odd):
    table, df = odd
    found = brute([r for r in table if r[0] % 5 == 0], table)
    assert rows(matching.scored_pairs(df.where("id % 5 = 0"), df).where("id <> t_id")) == sorted(found, key=repr)
    named = df.where("norm is not null")
    assert rows(matching.cosines(named.where("id % 5 = 0"), named).where("id <> t_id")) == sorted(((*r[:2], r[4]) for r in found), key=repr)
