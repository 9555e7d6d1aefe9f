"""Indexes, pruned joins, keyed streams, stored collections and digests: same rows as the plain way, and how much less is read."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, normalize_name
from tessera.operators import decisions, digests, graph, laws, matching, measure, names, neighbours, search
from tessera.sources import collections, statements
from tessera.streaming import logs

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Neighbours by cells


def clustered(n, seed=1, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, size))
    out = []
    for i in range(n):
        v = centres[rng.integers(0, 30)] + 0.35 * rng.standard_normal(size)
        out.append((i, "class" if i % 3 else "property", (v / np.linalg.norm(v)).tolist()))
    return out


VECTORS = "id bigint, kind string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(3000), VECTORS).repartition(4).cache()


def test_cells_find_most_neighbours_in_a_small_share(spark, vectors):
    queries = vectors.where("id % 20 = 0")
    exact = matching.nearest(queries, vectors, 5).cache()
    index = neighbours.build_index(vectors)
    found = matching.nearest(queries, vectors, 5, index=index, probes=6, exact=False)
    share = neighbours.share_read(queries, index, 6)
    assert neighbours.recall(found, exact) >= 0.9 and share <= 0.2


def test_cells_with_bounds_are_exact(spark, vectors):
    queries = vectors.where("id % 20 = 0")
    plain = lambda df: [(r[0], r[1], r[3]) for r in rows(df)]
    index = neighbours.build_index(vectors, centres=12)
    assert plain(matching.nearest(queries, vectors, 4, index=index, probes=1)) == plain(matching.nearest(queries, vectors, 4))
    assert plain(matching.nearest(queries, vectors, 4, False, index, 1)) == plain(matching.nearest(queries, vectors, 4, False))
    forbidden = queries.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + 3)).alias("t_id"))
    assert plain(matching.precedents(queries, vectors, forbidden, 4, index=index, probes=2)) == plain(matching.precedents(queries, vectors, forbidden, 4))


def test_hot_cells_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    same = [(i, "a", [1.0, 0.0, 0.5]) for i in range(200)] + [(300 + i, "b", [0.0, 1.0, 0.1 * i]) for i in range(30)]
    table = spark.createDataFrame([*same, (900, "a", None), (901, "a", [0.0, 0.0, 0.0])], VECTORS)
    unit = table.where("id < 900").withColumn("embedding", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y))))
    index = neighbours.build_index(table)
    found = matching.nearest(table, table, 3, index=index, probes=1)
    assert [r[:2] for r in rows(found)] == [r[:2] for r in rows(matching.nearest(unit, unit, 3))]
    assert rows(matching.nearest(table, table, 3, index=neighbours.build_index(table.limit(0)))) == []


def test_recall_on_the_given_vectors(spark):
    """The given vectors have no clusters, so cells help little: the share is stated for what it is."""
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "'x' AS kind", "embedding")
    queries = own.where("id % 10 = 0")
    index = neighbours.build_index(own)
    exact = matching.nearest(queries, own, 5)
    found = matching.nearest(queries, own, 5, index=index, probes=27, exact=False)
    assert neighbours.recall(found, exact) >= 0.9 and neighbours.share_read(queries, index, 27) <= 0.65


# Names


def test_pruned_names_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["data", "subject", "purpose", "right", "processing", "legal", "basis", "entity", "controller", "risk", "measure", "consent", "record", "transfer", "notice", "x", "zzz"]
    pick = lambda: " ".join(rng.sample(words, rng.randint(1, 4))) + rng.choice(["", "s", "ing", "tion"])
    terms = spark.createDataFrame([(f"t{i:04}", "c" if i % 4 else "p", pick() if i % 50 else "") for i in range(400)], "iri string, kind string, norm string")
    sources = spark.createDataFrame([(f"k{i}", "c" if i % 3 else "p", pick() if i % 30 else rng.choice(["", "qqq", "ÿ"])) for i in range(150)], "key string, kind string, norm string")
    every = matching.lexical_scores(sources, terms).join(terms.withColumnRenamed("norm", "b"), ["kind", "b"])
    wanted = {}
    for r in every.collect():
        wanted.setdefault((r.kind, r.a), []).append((-r.lexical, r.iri))
    expected = [(s.key, iri, -score, i + 1) for s in sources.collect() for i, (score, iri) in enumerate(sorted(wanted[s.kind, s.norm])[:3])]
    found = rows(matching.best_lexical(sources, terms, 3))
    assert found == sorted([(k, i, abs(x), n) for k, i, x, n in expected], key=repr)
    similar = matching.lexical_scores(sources, terms).where("lexical >= 0.7")
    assert rows(matching.similar_names(sources, terms, 0.7)) == rows(similar)


def test_few_names_are_compared(spark):
    """On the given names fewer than a tenth of all pairs are compared."""
    from tessera.plans.views import Inputs

    t = Inputs(spark, SF)
    sources, targets = matching.normalized(t.concepts), matching.normalized(t.terms, "label")
    calls = names.close_names(sources, targets, 2).agg(F.sum("calls")).first()[0]
    a, b = sources.select("kind", "norm").distinct(), targets.select("kind", F.col("norm").alias("b")).distinct()
    assert 0 < calls < 0.1 * a.join(b, "kind").count()


def test_bounds_are_bounds():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 30))) for _ in range(80)]
    above = names.bounds(names.letter_counts(words), names.letter_counts(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            row = [0] * (len(b) + 1)
            for x in a:
                before = row[:]
                for k, y in enumerate(b):
                    row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
            assert names.shared_run(a, b) == row[-1]
            assert 2 * row[-1] / (len(a) + len(b)) <= above[i][j] + 1e-9


def test_accents_of_all_alphabets(spark):
    texts = ["ČeskáData", "ŁódźPlan", "ﬁleRights", "Ａｂｃ１", "étude", "½Rule", "ǅoković", "ñandú", "ŜanĝoĤoro", "Ⅷ kind", "Åland_Öl", "日本", "😀 face"]
    found = {r.x: r.n for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", normalize_name(F.col("x")).alias("n")).collect()}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    apart = lambda t: re.sub("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", re.sub("[_-]", " ", t))
    for text in texts:
        tokens = [x for x in re.split("[^a-z0-9]+", plain(apart(text)).lower()) if x and x not in STOP_WORDS]
        assert found[text] == " ".join(x[:-1] if len(x) > 3 and x.endswith("s") else x for x in tokens)
    assert found["ČeskáData"] == "ceskadata" and found["ﬁleRights"] == "file right" and found["½Rule"].startswith("1 2")


# Reachability


def brute_below(edges, roots):
    out = set()
    for root in roots:
        seen, todo = {root}, [root]
        while todo:
            at = todo.pop()
            for child, parent in edges:
                if parent == at and child not in seen:
                    seen.add(child)
                    todo.append(child)
        out |= {(root, n) for n in seen}
    return out


def test_reachability_by_doubling(spark):
    rng = random.Random(2)
    for n, m in ((12, 20), (30, 28), (25, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        table = spark.createDataFrame(edges, "child bigint, parent bigint")
        roots = [0, 3, 7, 99]
        below = graph.Steps(table).below(spark.createDataFrame([(r,) for r in roots], "node bigint"))
        assert {tuple(r) for r in below.collect()} == brute_below(edges, roots)
        assert {r[0] for r in graph.descendants(table, spark.createDataFrame([(0,), (3,)], "node bigint")).collect()} == {n for _, n in brute_below(edges, [0, 3])}
        pairs = {(c, p) for p in range(n) for c in range(n) if any((x, c) in brute_below(edges, [x]) for x, q in edges if q == p for x in [x])}
        assert {tuple(r) for r in graph.closure(table).collect()} == pairs


def test_a_path_of_ten_thousand_takes_few_rounds(spark):
    path = spark.range(9_999).selectExpr("id + 1 AS child", "id AS parent")
    steps = graph.Steps(path)
    below = steps.below(spark.createDataFrame([(0,), (9_000,)], "node bigint"))
    assert rows(below.groupBy("root").count()) == [(0, 10_000), (9_000, 1_000)]
    assert len(steps.powers) < 20


# Keyed streams

EVENT = "seq bigint, source_id string, target string, concept_key string, dpv_iri string, decision string, relation string"


def events(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        decision = rng.choice(["approved", "approved", "rejected", "pending", "no_match"])
        term = "" if decision == "no_match" else f"t{rng.randrange(4)}"
        out.append((i, "s", "mapping", f"c{rng.randrange(6)}", term, decision, rng.choice(["exactMatch", "closeMatch"]) if decision == "approved" else None))
    return out


def test_keyed_replay_in_any_order_and_after_a_restart(spark, tmp_path):
    log = events(5, 240)
    table = spark.createDataFrame(log, EVENT)
    none = spark.createDataFrame([], "concept_key string, dpv_iri string, relation string")
    wanted = rows(decisions.replay(none, table).drop("origin"))
    order = random.Random(9).sample(range(6), 6)
    path, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    for turn in order[:3]:
        table.where(F.col("seq") % 6 == turn).coalesce(1).write.mode("append").json(path)
    logs.finished(logs.replay_changes(logs.log_stream(spark, path)), out, checkpoint)
    first = set(os.listdir(out))
    for turn in order[3:]:
        table.where(F.col("seq") % 6 == turn).coalesce(1).write.mode("append").json(path)
    changes = logs.finished(logs.replay_changes(logs.log_stream(spark, path)), out, checkpoint)  # goes on from the checkpoint
    assert rows(logs.in_force(changes)) == wanted
    assert first < set(os.listdir(out))


def test_state_is_as_large_as_the_keys(spark, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    one = [(i, "s", "mapping", f"c{i % 3}", f"t{i % 2}", "approved" if i % 5 else "rejected", "exactMatch" if i % 5 else None) for i in range(3000)]
    spark.createDataFrame(one, EVENT).repartition(3).write.json(path)
    changes = logs.finished(logs.replay_changes(logs.log_stream(spark, path)), str(tmp_path / "out"), checkpoint)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "terms").load()
    assert state.count() <= 6 and changes.count() <= 6 * 3


def test_answers_are_taken_in_once(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "cache_key string, answer string"
    for k in range(3):
        spark.createDataFrame([(f"k{i % (10 + k)}", f"a{k}") for i in range(40)], schema).coalesce(2).write.mode("append").json(path)
        found = logs.take_in(logs.log_stream(spark, path, schema), out, checkpoint)
        assert sorted(r.cache_key for r in found.collect()) == sorted(f"k{i}" for i in range(10 + k))
    assert {r.answer for r in found.where("cache_key = 'k1'").collect()} == {"a0"}


def test_latest_changes_merge_in_any_order(spark, tmp_path):
    table = spark.createDataFrame(events(8, 200), EVENT)
    for turn in (2, 0, 1):
        table.where(F.col("seq") % 3 == turn).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    found = logs.latest_of(logs.finished(logs.latest_changes(logs.log_stream(spark, str(tmp_path / "log")))))
    assert rows(found.where("decision <> 'pending'").select(*table.columns)) == rows(decisions.latest(table))


# Digests


def test_tables_that_shared_a_digest_differ(spark):
    schema = "a string, b string"
    tables = [[("a|b", "")], [("a", "b|")], [("a|b", None)], [("a", "b")], [("a", "b"), ("a", "b")], []]
    found = [digests.fingerprint(spark.createDataFrame(t, schema), ["a", "b"]).first().digest for t in tables]
    assert len(set(found)) == len(tables)
    keys = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("ab", None, None), ("a", "", "b")], "x string, y string, z string")
    assert keys.select(decisions.cache_key(F.col("x"), F.col("y"), F.col("z")).alias("k")).distinct().count() == 4
    summed = [spark.createDataFrame(t, schema).agg(digests.summed_digest(F.col("a"), F.col("b")).alias("d")).first().d for t in tables[:5]]
    assert len(set(summed)) == 5


def test_a_changed_row_is_found_from_the_root(spark, monkeypatch):
    monkeypatch.setattr(digests, "BUCKET", 4)
    table = spark.range(3000).selectExpr("id", "concat('v', id % 7) AS v")
    other = table.withColumn("v", F.when(F.col("id") == 1234, "new").otherwise(F.col("v"))).repartition(7)
    one, two = digests.digest_tree(table, ["id", "v"]), digests.digest_tree(other, ["id", "v"])
    depth = one.agg(F.max("level")).first()[0]
    assert depth >= 2 and rows(digests.digest_tree(table.orderBy(F.desc("id")).repartition(3), ["id", "v"])) == rows(one)
    named = digests.changed_subtrees(one, two)
    assert 1 <= named.count() <= 2
    changed = digests.changed_rows(digests.row_digests(table, ["id", "v"]), digests.row_digests(other, ["id", "v"]), named)
    assert sorted((r.before, r.after) for r in changed.collect()) == [(0, 1), (1, 0)]


# Collections


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_upserts_write_what_they_change(spark, tmp_path):
    path = str(tmp_path / "c")
    own = spark.range(20_000).selectExpr("id", "repeat(md5(cast(id AS string)), 20) AS document", "array(id / 7.0, id / 3.0) AS v")
    collections.build_collection(own, path, "f", buckets=4)
    base = folder_bytes(f"{path}/1")
    few = own.where("id % 100 = 0").withColumn("document", F.repeat(F.md5(F.concat(F.lit("n"), F.col("id").cast("string"))), 20))
    assert collections.upsert_collection(few.unionByName(own.where("id < 5000 and id % 100 <> 0")), path) == 20_000  # most of these rows are as stored
    assert 0 < folder_bytes(f"{path}/2") < 0.04 * base
    held = collections.newest(spark, path)
    before = collections.read_version(spark, path, held)
    for k in range(collections.MOST_DELTAS + 1):
        collections.upsert_collection(few.withColumn("id", F.col("id") + 100_000 + k), path)
    now = collections.newest(spark, path)
    assert now.base > 1 and len(now.deltas) <= collections.MOST_DELTAS and now.items == collections.read_collection(spark, path).count() == 20_000 + 200 * (collections.MOST_DELTAS + 1)
    assert before.count() == 20_000 and before.where("id = 100").first().document.startswith(few.where("id = 100").first().document[:32])  # read as it was while others wrote
    assert rows(collections.read_collection(spark, path, [100, 100_100, 5]).select("id").orderBy("id")) == sorted([(5,), (100,), (100_100,)], key=repr)
    whole = rows(collections.read_collection(spark, path))
    assert 1 in collections.drop_unused(spark, path) and rows(collections.read_collection(spark, path)) == whole


# Chains


def brute_chain(numbers):
    ones = [i for i, n in enumerate(numbers) if n == 1] or ([0] if numbers else [])
    best = []
    for start in ones:
        chain = [start]
        for i in range(start + 1, len(numbers)):
            if 1 <= numbers[i] - numbers[chain[-1]] <= laws.MAX_GAP:
                chain.append(i)
        if len(chain) >= len(best):
            best = chain
    return best


def test_chains_in_one_pass():
    rng = random.Random(7)
    for _ in range(3000):
        numbers = [rng.randrange(0, rng.choice([4, 9, 30])) for _ in range(rng.randrange(0, 25))]
        assert laws.chains_of(list(range(len(numbers))), numbers) == brute_chain(numbers)
    many = [rng.choice([1, 1, rng.randrange(1, 400)]) for _ in range(100_000)]
    assert len(laws.chains_of(list(range(len(many))), many)) > 3


# Rules out of counts


def test_rule_tables_out_of_a_histogram(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["aligned", "aligned", "no_match"]), rng.choice("ab"), rng.choice(["a", "b", None]), rng.choice([None, 0.1, 0.2, 0.35, 0.4, 0.9]), rng.choice(["high", "low", None])) for i in range(300)]
    gold = spark.createDataFrame(data, "key bigint, status string, term string, predicted string, score double, confidence string")
    grid = [("a", ["high"], 1, 0.2), ("b", ["high", "low"], 2, 0.35), ("c", ["low"], 1, 0.0)]
    rules = spark.createDataFrame(grid, "rule string, levels array<string>, n_levels int, min_score double")
    for r in measure.rule_table(gold, rules).collect():
        levels, least = next((x[1], x[3]) for x in grid if x[0] == r.rule)
        taken = [d for d in data if d[5] in levels and d[4] is not None and d[4] >= least and d[3] is not None]
        assert (r.n, r.proposals) == (300, len(taken)) and r.correct == sum(d[1] == "aligned" and d[2] == d[3] for d in taken) and r.on_no_match == sum(d[1] != "aligned" for d in taken)
    big = rules.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(200)))).select(F.concat("rule", F.col("i").cast("string")).alias("rule"), "levels", "n_levels", "min_score")
    steps = measure.edges_of(big)
    assert measure.histogram(gold, steps).count() <= 4 * 3 * 4  # as large as the grid's levels and edges, not rows x rules
    assert measure.rule_table(gold, big).count() == 600


# Records with a free snapshot


def test_snapshots_are_kept_as_they_are(spark, tmp_path):
    lines = [
        '{"seq": 1, "source_id": "s", "target": "mapping", "concept_key": "a", "dpv_iri": "x", "decision": "approved", "relation": "exactMatch", "reviewer": "r", "note": null, "snapshot": {"rank": 1, "nested": {"list": [1, "two", null, 3.5]}, "ñ": "é"}}',
        '{"seq": 2, "source_id": "s", "target": "mapping", "concept_key": "b", "dpv_iri": "y", "decision": "approved", "relation": "closeMatch", "reviewer": "r", "snapshot": [], "unknown": 5}',
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    log = statements.read_log(spark, str(tmp_path / "log.json"), decisions.RECORD)
    statements.append_log(log, str(tmp_path / "again"))
    again = statements.read_log(spark, str(tmp_path / "again"), decisions.RECORD)
    for kept in (log, again, decisions.latest(again), decisions.replay(again.limit(0).select("concept_key", "dpv_iri", "relation"), again, ("snapshot",))):
        found = {r.concept_key: r for r in kept.select("concept_key", F.to_json("snapshot").alias("s"), F.variant_get("snapshot", "$.nested.list[1]", "string").alias("two")).collect()}
        assert found["a"].two == "two" and found["a"].s == '{"nested":{"list":[1,"two",null,3.5]},"rank":1,"ñ":"é"}' and found["b"].s == "[]"


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"reviewer": " "}, "no reviewer"), ({"target": "x"}, "unknown target"), ({"decision": "duplicate"}, "unknown decision"), ({"entity_kind": "class"}, "mapping with an entity kind"), ({"same_as": "z"}, "mapping with a same entity"),
     ({"decision": "pending", "dpv_iri": "", "relation": None}, None), ({"decision": "no_match"}, "no_match with a term or relation"), ({"relation": "none"}, "approved without a known relation"), ({"decision": "rejected"}, "relation without approval"),
     ({"dpv_iri": None}, "no term"), ({"target": "concept"}, "concept with a term"), ({"target": "concept", "dpv_iri": "", "relation": None}, "approved without an entity kind"), ({"target": "concept", "dpv_iri": "", "relation": None, "entity_kind": "class"}, None),
     ({"target": "concept", "dpv_iri": "", "relation": None, "decision": "duplicate"}, "duplicate of nothing"), ({"target": "concept", "dpv_iri": "", "relation": None, "decision": "rejected", "same_as": "x"}, "same entity without duplicate"), ({"target": "concept", "dpv_iri": "", "relation": None, "decision": "rejected", "entity_kind": "class"}, "entity kind without approval")],
)
def test_record_rules(spark, change, reason):
    record = {"source_id": "s", "target": "mapping", "concept_key": "c", "dpv_iri": "t", "decision": "approved", "relation": "exactMatch", "entity_kind": None, "same_as": None, "reviewer": "r"} | change
    assert decisions.validated(spark.createDataFrame([tuple(record.values())], ", ".join(f"{k} string" for k in record))).first().reason == reason


# Search


def test_search_by_index_reads_its_own_trigrams(spark, tmp_path):
    rng, parts = random.Random(6), ["Personal", "data", "of the", "subject", "Ñandú", "a", "ab", "aaa", "right to", " "]
    own = [(f"k{i}", i, rng.choice(["class", "property"]), "".join(rng.choices(parts, k=2)), " ".join(rng.choices(parts, k=3)) if i % 5 else None, " ".join(rng.choices(parts, k=9))) for i in range(150)]
    table = spark.createDataFrame(own, "key string, seq bigint, kind string, name string, label string, definition string")
    path = str(tmp_path / "index")
    search.write_postings(table, path)
    for text in ("data", "of the subject", "aaaa", "ab", "a", "ñandú", "no such", "t t", "", "DATA"):
        want = text.lower()
        hits = {r[0]: 0 if want in r[3].lower() or want in (r[4] or "").lower() else 1 for r in own if want and any(want in (x or "").lower() for x in r[3:])}
        assert {r.key: r.hit for r in search.found_by_index(spark, path, text).collect()} == hits
    assert rows(search.search_by_index(spark, path, "data", limit=7)) == rows(matching.search(table, "data", 7))
    read, all_rows = search.read_grams(spark, path, "Ñandú").count(), spark.read.parquet(path).count()
    assert read < 0.1 * all_rows
