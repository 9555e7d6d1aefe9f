"""Quality rules, line dedup, SimHash, decontamination against brute force, with odd and empty tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from oracle import same_rows
from pyspark.sql import functions as F

from tessera.llm import decontaminate, entries, line_dedup, quality_rules, simhash

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    same_rows(spark, SF, entries.QUERIES[name], entries.ORACLE_SQL[name])


def measures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered, seen, repeated = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(i, i + 8))
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_measures(odd_documents):
    source = [(r.doc_id, r.text) for r in odd_documents.collect()]
    found = Counter(tuple(r)[:6] for r in quality_rules.score_quality(odd_documents).collect())
    assert found == Counter((i, *measures(t)) for i, t in source)


def test_quality_order_changes_no_verdict_and_columns_stay(odd_documents, documents):
    kept = quality_rules.filter_quality(odd_documents)
    assert kept.columns == odd_documents.columns
    base = {r.doc_id for r in quality_rules.score_quality(documents).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.filter_quality(documents, sample_rows=5).collect()} == base
    assert {r.doc_id for r in quality_rules.filter_quality(documents, rules=quality_rules.RULES[::-1]).collect()} == base


def test_cascade_stops_at_the_first_rule_that_rejects(spark):
    """A rule that fails the job if it is ever evaluated on a text that an earlier rule rejects."""
    docs = spark.createDataFrame([(1, "ab " * 30), (2, "x1 y2 z3"), (3, " ".join(f"word{i}" for i in range(40)))], "doc_id bigint, text string")
    trap = quality_rules.Rule("trap", lambda m: F.when(m("n_words") * 0 + m("n_lines") > 0, F.when(m("n_words") < 20, F.raise_error(F.lit("looked at")).isNull()).otherwise(m("n_stutter") < 0)))
    order = [*quality_rules.BASE, trap]
    text = F.col("text")
    asked = docs.select("doc_id", quality_rules.verdict(order, quality_rules.metrics(text, quality_rules.words_of(text)).__getitem__).alias("r"))
    assert {r.doc_id: r.r for r in asked.collect()} == {1: "repeats", 2: "short", 3: None}
    with pytest.raises(Exception, match="looked at"):
        docs.select(quality_rules.verdict([trap], quality_rules.metrics(text, quality_rules.words_of(text)).__getitem__)).collect()
    # score_quality computes the measures beyond the base only inside the cascade
    plan = quality_rules.score_quality(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]+") == 1 and "CASE WHEN" in plan[: plan.index("[A-Z]+")]


def test_order_is_by_rejection_per_cost(documents):
    found = quality_rules.rule_order(documents)
    rates = [share / seconds for _, share, seconds in found]
    assert rates == sorted(rates, reverse=True) and {rule.name for rule, _, _ in found} == {rule.name for rule in quality_rules.RULES}
    source = [r.text for r in documents.collect()]
    shares = {rule.name: share for rule, share, _ in found}
    assert shares["short"] == sum(measures(t)[0] < 20 for t in source) / len(source)


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (5, 2)])
def test_line_dedup(spark, odd_documents, documents, batches, fanout):
    docs = odd_documents.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    source = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = defaultdict(set)
    for i, text in source:
        if i is not None:
            for line in text.split("\n"):
                held[key(line)].add(i)

    def rest(i, text):
        out = []
        for line in text.split("\n"):
            k = key(line)
            gone = len(k) >= 10 and held[k] and ((i is None) or (len(held[k]) > 1 and i != min(held[k])))
            if not gone:
                out.append(line)
        return "\n".join(out), len(text.split("\n")) - len(out)

    found = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()
    assert Counter((r.doc_id, r.text or "", r.n_dropped) for r in found) == Counter((i, *rest(i, t)) for i, t in source)
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_run")]


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(odd_documents, documents):
    for docs in (odd_documents, documents):
        source = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter(map(tuple, simhash.fingerprints(docs).collect())) == Counter((i, fingerprint(t)) for i, t in source)


def all_pairs(fps, radius=2):
    """fingerprint to the smallest one that links reach, by comparing all with all."""
    fps, root = sorted(set(fps)), {}
    for fp in fps:
        if fp in root:
            continue
        root[fp], open_ = fp, [fp]
        while open_:
            x = open_.pop()
            for y in fps:
                if y not in root and ((x ^ y) & (2**64 - 1)).bit_count() <= radius:
                    root[y] = fp
                    open_.append(y)
    return root


def as_signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def clustered():
    """Fingerprints in chains and clouds, some of which share half their bits; 0 and the sign bit too."""
    rng, out = random.Random(11), [0, 0b11, 0b1111, 0b111111, 1 << 63, (1 << 63) | 0b111, (1 << 40) - 1]
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 16)):
            out.append(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    high = rng.getrandbits(32) << 32
    out += [high | rng.getrandbits(32) for _ in range(60)] + [high | 1 << i for i in range(32)]
    return [as_signed(x) for x in out]


@pytest.mark.parametrize(("segments", "dense"), [(2, 64), (2, 3), (4, 64), (3, 0)])
def test_links_connect_what_all_pairs_connect(spark, clustered, segments, dense):
    fps = spark.createDataFrame([(x,) for x in clustered], "fp bigint")
    links = simhash.links(fps, segments=segments, dense=dense)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert {x: found.get(x, x) for x in clustered} == all_pairs(clustered)


def test_only_tables_of_segments_bring_links(spark, clustered):
    """Every link is fetched from a segment's table: wider balls bring more of them, none brings none."""
    fps = spark.createDataFrame([(x,) for x in clustered], "fp bigint")
    at = {radius: simhash.links(fps, radius=radius, dense=10**6).count() for radius in (0, 2, 4)}
    distinct = sorted(set(clustered))
    pairs = [((x ^ y) & (2**64 - 1)).bit_count() for i, x in enumerate(distinct) for y in distinct[:i]]
    assert at == {0: 0, 2: sum(d <= 2 for d in pairs), 4: sum(d <= 4 for d in pairs)}


def test_components_of_documents_against_all_pairs(spark, documents, odd_documents):
    docs = documents.select("doc_id", "text").unionByName(odd_documents.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = simhash.near_components(docs).collect()
    roots = all_pairs([r.fp for r in rows])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[roots[r.fp]] = min(least.get(roots[r.fp], r.doc_id), r.doc_id)
    assert len(rows) == docs.count() and all(r.component_id == least.get(roots[r.fp]) for r in rows)
    assert len(set(least.values())) < len({r.doc_id for r in rows})


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[i] for i in range(100, 140)} == {100}


def test_keep_one(odd_documents, documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] and not ids[4] and not ids[5]  # no words: one group
    assert simhash.keep_one(documents.limit(0)).count() == 0


def similar(document, item):
    w, v = words((document or "").translate(LOWER)), words((item or "").translate(LOWER))
    if not v:
        return 0.0
    k = min(5, len(v))
    grams = lambda x: [" ".join(x[i : i + k]) for i in range(len(x) - k + 1)]
    d, b = grams(w), grams(v)
    size, best = min(len(b), len(d)), 0.0
    for at in range(len(d) - size + 1):
        x, y = Counter(d[at : at + size]), Counter(b)
        shared = sum((x & y).values())
        best = max(best, shared / (len(b) + size - shared)) if size else best
    return best


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    fill = " ".join(f"w{i}" for i in range(50))
    near = item.replace("ten", "TEN extra")
    texts = [(1, f"{fill} {item.upper()} {fill}"), (2, f"{fill} {near}"), (3, item.replace("ten", "x").replace("fifteen", "y")), (4, fill), (5, None), (6, ""), (7, "alpha beta gamma"), (8, item[:-7]), (None, item), (9, item), (9, item), (9, "twice " + item + " and " + item)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item), (1, "alpha beta"), (2, None), (3, ""), (4, item)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(docs, bench).collect()}
    expected = {}
    for i, t in texts:
        for j, b in ((0, item), (1, "alpha beta"), (4, item)):
            if (s := similar(t, b)) >= 0.8:
                expected[i, j] = max(expected.get((i, j), 0), round(s, 9))
    assert found == expected
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == sorted(i for i, t in texts if i is not None and max(similar(t, item), similar(t, "alpha beta")) < 0.8)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(texts)


def test_blocks_of_fingerprints_bring_the_leaks(spark):
    """Edited items in documents: what the blocks fetch is what all windows give; a narrow radius loses the edited ones."""
    rng = random.Random(21)
    items = [" ".join(f"v{rng.randrange(400)}" for _ in range(n)) for n in (6, 12, 20, 20, 33, 50, 50) for _ in range(3)]
    texts = []
    for i in range(150):
        copy = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = "edited"
        fill = [f"v{rng.randrange(400)}" for _ in range(30)]
        texts.append((i, " ".join(fill[: rng.randrange(30)] + copy + fill)))
    shared = "the same question is asked of all in these very words again and again"
    items += [f"{shared} {x}" for x in ("one", "two", "three")]
    texts += [(1000 + i, f"{shared} four " * 2) for i in range(5)]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    expected = {(i, j): round(best, 9) for i, t in texts for j, b in enumerate(items) if (best := similar(t, b)) >= 0.8}
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == expected and 0.8 <= min(found.values()) < 1
    assert {k for k, v in expected.items() if v == 1} <= (exact := {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, radius=0).collect()}) < set(expected)
    assert {expected[k] for k in exact} != set(expected.values())


def test_blocks_select_and_miss_little(spark):
    """Windows at similarity 0.8 and more of items of many sizes: nearly all pairs are met through a block, and far fewer than all pairs are."""
    rng, rows, items, wanted = random.Random(4), [], [], []
    for n in (16, 30, 46, 46, 90, 200):
        for _ in range(40):
            item = [rng.getrandbits(62) for _ in range(n)]
            items.append((len(items), 5, n, item))
            other, lost = list(item), int(n * rng.choice([0.0, 0.05, 0.11]))  # of n shingles 0.11 n replaced: similarity 0.8
            for i in rng.sample(range(n), lost):
                other[i] = rng.getrandbits(62)
            rows.append((len(rows), 5, n, other))
            wanted.append((len(rows) - 1, len(items) - 1, (n - lost) / (n + lost) >= 0.8))
    explode = lambda data, key: spark.createDataFrame(data, f"{key} bigint, k int, total int, hashes array<bigint>").select(key, "k", "total", F.explode("hashes").alias("h"))
    prints = decontaminate.simhash(explode(rows, "w"), ["w", "k", "total"])
    table = decontaminate.simhash(explode(items, "item"), ["item", "k", "total"])
    met = decontaminate.met_by_blocks(prints, table, ["w", "k", "total"], decontaminate.RADIUS).distinct().collect()
    near = {(r.w, r.item) for r in met if r.distance <= decontaminate.RADIUS}
    similar_pairs = {(w, i) for w, i, ok in wanted if ok}
    assert len(near & similar_pairs) >= 0.98 * len(similar_pairs)
    all_pairs = sum(a[2] == b[2] for a in rows for b in items)
    assert len(met) <= 0.2 * all_pairs and len(near) <= len(rows) + 0.01 * all_pairs
    # the guarantee: every pair within the radius is met
    by_id = {r.w: r.fp for r in prints.collect()}
    own = {r.item: (r.total, r.fp) for r in table.collect()}
    for w, _, n, _ in rows[::7]:
        for item, (total, fp) in own.items():
            distance = sum(bin((a ^ b) & ((1 << 64) - 1)).count("1") for a, b in zip(by_id[w], fp, strict=True))
            assert (total == n and distance <= decontaminate.RADIUS) == ((w, item) in near)


def test_leaks_in_very_long_documents(spark):
    item = " ".join(f"q{i}" for i in range(30))
    fill = " ".join(f"w{i % 5000}" for i in range(150_000))
    docs = spark.createDataFrame([(1, f"{fill} {item} {fill}"), (2, fill), (3, item + " " + fill)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.start_word) for r in decontaminate.leaks(docs, bench).collect()) == [(1, 150_000), (3, 0)]


def test_clashing_columns_stay(spark, odd_documents):
    clash = odd_documents.withColumns({c: F.lit("x") for c in ("gone_id", "gone_row", "d_id", "drops", "_words", "component_id", "in_0")})
    bench = spark.createDataFrame([(0, "same row same row same row"), (1, "nothing of this")], "item_id bigint, text string")
    for found in (quality_rules.filter_quality(clash), simhash.keep_one(clash), decontaminate.without_leaks(clash, bench)):
        assert found.columns == clash.columns and found.count() <= clash.count()
    lines = line_dedup.drop_repeated_lines(clash)
    assert lines.columns == [*clash.columns, "n_lines", "n_dropped"] and lines.count() == clash.count()


def test_empty_tables(documents):
    none = documents.limit(0)
    assert quality_rules.score_quality(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert simhash.near_components(none).count() == 0
