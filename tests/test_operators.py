"""Small hand-made cases: exact values, orders, nulls, ties, cycles, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import common_subsequence, humanize, indel_ratio, normalize_name, trim_words
from tessera.operators import decisions, graph, law_questions, laws, matching, measure, rules, shapes
from tessera.plans import QUERIES
from tessera.sources import collections, statements
from tessera.streaming import logs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    fields = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("SpecialCategoriesOfPersonalData", "special category personal data"), ("hasPurpose", "has purpose"), ("Política", "politica"), ("of_the", ""), ("GDPRRight", "gdpr right"), ("status-analysis", "status analysis")],
)
def test_normalized_names(spark, name, expected):
    assert one(spark, normalize_name(F.col("x")), x=name) == expected


def test_humanize_and_trim(spark):
    assert one(spark, humanize(F.col("x")), x="DataSubjectOfGDPRRight") == "Data Subject Of GDPR Right"
    assert one(spark, trim_words(F.col("x"), 9), x="one  two three") == "one two..."


@pytest.mark.parametrize(("a", "b", "expected"), [("data subject", "subject data", 1.0), ("abc", "abd", 2 / 3), ("", "x", 0.0), ("a", "b", 0.0)])
def test_indel_ratio(spark, a, b, expected):
    assert one(spark, indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)


LOG = "seq bigint, source_id string, target string, concept_key string, dpv_iri string, decision string, relation string"


def log(spark, *events):
    return spark.createDataFrame([(i, "s", "m", c, t, d, r) for i, (c, t, d, r) in enumerate(events)], LOG)


def test_latest_is_last_in_the_log_and_pending_withdraws(spark):
    events = log(spark, ("a", "x", "approved", "exactMatch"), ("a", "x", "pending", None), ("b", "x", "rejected", None), ("b", "x", "approved", "closeMatch"))
    found = decisions.latest(events)
    assert rows(found.select("concept_key", "decision")) == [("b", "approved")]
    assert rows(decisions.latest(found)) == rows(found)
    assert rows(decisions.latest(events.limit(0))) == []


def test_replay_clears_then_sets_and_the_stream_agrees(spark, tmp_path):
    events = log(spark, ("a", "x", "approved", "exactMatch"), ("a", "", "no_match", None), ("a", "y", "approved", "closeMatch"), ("b", "x", "approved", "exactMatch"), ("b", "x", "rejected", None))
    base = spark.createDataFrame([("a", "z", "exactMatch"), ("c", "z", "exactMatch")], "concept_key string, dpv_iri string, relation string")
    found = decisions.replay(base, events)
    assert rows(found) == [("a", "y", "closeMatch", "user"), ("c", "z", "exactMatch", "base")]
    for turn in (2, 0, 1):
        events.where(F.col("seq") % 3 == turn).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    streamed = logs.in_force(logs.finished(logs.replay_changes(logs.log_stream(spark, str(tmp_path / "log")))))
    assert rows(streamed) == rows(found.where("origin = 'user'").drop("origin"))


def test_versions_count_ended_approvals(spark):
    events = log(spark, ("a", "x", "approved", "exactMatch"), ("a", "x", "approved", "exactMatch"), ("a", "x", "rejected", None), ("a", "y", "approved", "exactMatch"))
    assert rows(decisions.approvals(events).select("dpv_iri", "seq", "until", "version")) == [("x", 0, 2, 1), ("y", 3, None, 2)]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child bigint, parent bigint")
    assert len(rows(graph.closure(edges))) == 9
    assert rows(graph.closure(edges.limit(0))) == []


def test_ambiguous_names_do_not_fall_through(spark):
    users = spark.createDataFrame([(1, None, "data"), (2, None, "other")], "id bigint, iri string, norm string")
    base = spark.createDataFrame([(10, None, "data", "p"), (11, None, "data", "q")], "id bigint, iri string, norm string, signature string")
    pairs = spark.createDataFrame([(1, 10, 0.9, 0.9), (2, 10, 0.8, 0.1)], "id bigint, t_id bigint, score double, lexical double")
    found = {r.id: (r.method, r.status) for r in matching.inherit(users, base, pairs).collect()}
    assert found == {1: ("name", "ambiguous"), 2: ("similarity", "inherited")}


def test_null_and_empty_rule_parameters_differ(spark):
    answers = spark.createDataFrame([("high", 0.9, "exactMatch", False), ("high", 0.9, None, True)], "confidence string, score double, relation string, is_property boolean")
    accepts = lambda **p: [r[0] for r in answers.select(rules.rule_accepts(["high"], 0.5, **p)).collect()]
    assert accepts(relations=None, property_relations=[]) == [True, False]
    assert accepts(relations=["closeMatch"], property_relations=None) == [False, True]


def test_score_card_has_null_ratios_without_proposals(spark):
    card = measure.score_card(spark.createDataFrame([("aligned", "a", None)], "status string, term string, proposed string")).first()
    assert (card.precision, card.coverage, card.f1) == (None, 0.0, None)


def test_conflicting_mappings_are_found(spark):
    held = spark.createDataFrame([("a", "x", "exactMatch"), ("a", "x", "broadMatch"), ("b", "x", "exactMatch")], "s string, o string, relation string")
    assert rows(shapes.mapping_conflict(held).select("focus", "value")) == [("a", "x")]


def test_statements_keep_their_text_exactly(spark, tmp_path):
    text = 'a "quote" \\ back\nline\ttab ñ \\n'
    graph_ = spark.createDataFrame([("http://x/a", "http://x/p", text, "literal", "rdf:langString", "es"), ("_:b1", "http://x/p", "_:b2", "bnode", None, None), ("_:b1", "http://x/q", "http://x/a", "iri", None, None)], "s string, p string, o string, o_kind string, dt string, lang string")
    statements.write_statements(graph_, str(tmp_path / "nt"))
    assert rows(statements.read_statements(spark, str(tmp_path / "nt"))) == rows(graph_)


def test_damaged_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"cache_key": "a", "seq": 1}\n{"cache_key": "a", "seq": 2}\n{"cache_key": "b", "se')
    path = str(tmp_path / "log.json")
    assert rows(statements.read_cache(spark, path, "cache_key string, seq bigint")) == [("a", 2)]
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed|malformed"):
        statements.read_log(spark, path, "cache_key string, seq bigint").collect()


def segmented(spark, text):
    law = spark.createDataFrame([(1, text)], "law bigint, text string")
    found = laws.candidates(law)
    chains = laws.longest_chain(found)
    arts = laws.articles(law, chains).orderBy("start").collect()
    return arts, [r.number for r in laws.skipped(chains).collect()], [r.rejected for r in laws.rejected(found, chains).collect()]


def test_chains_and_articles(spark):
    text = "Article 1 - One. Then\ntext\nArticle 9: Noise\nArticle 2\n\nTwo.\nbody\nArticle 4\n(1) body\nArticle 5 - More ....... 7\n"
    arts, skipped, rejected = segmented(spark, text)
    assert [(a.number, a.title) for a in arts] == [(1, "One"), (2, "Two"), (4, "")]
    assert skipped == [3] and rejected == [1]
    assert arts[0].body.startswith("Article 1 - One. Then\ntext") and arts[-1].stop == len(text)
    assert [a.stop for a in arts[:-1]] == [a.start for a in arts[1:]]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_heading_families(spark, end):
    spanish = [" ARTÍCULO 1o. OBJETO. La norma rige.", "artículo 9°. no es encabezado", "Artículo 2°. Ámbito de aplicación", "Artículo 3", "  Datos sensibles. ", "texto", "Articulo 4 . Final."]
    assert [(a.number, a.title) for a in segmented(spark, end.join(spanish))[0]] == [(1, "OBJETO"), (2, "Ámbito de aplicación"), (3, "Datos sensibles"), (4, "Final")]
    dashed = ["Art. 1.-Objeto y fin.- Uno", "según el Art. 2.- citado", "Artículo 2.- Dos", "art. 3- Tres ", "Art. 4 Cuatro"]
    arts, _, rejected = segmented(spark, end.join(dashed))
    assert [(a.number, a.title) for a in arts] == [(1, "Objeto y fin.- Uno"), (2, "Dos"), (3, "Tres")] and rejected == [0]
    english = ["ARTICLE 1", "Scope", "Article 1. In the case of doubt", "Article 2. Terms. They are", "1. body", "Article 3", "x" * 151]
    arts, _, rejected = segmented(spark, end.join(english))
    assert [(a.number, a.title) for a in arts] == [(1, "In the case of doubt"), (2, "Terms"), (3, "")] and rejected == [1]
    assert segmented(spark, "no headings")[0] == []


def test_furniture_needs_three_pages_and_is_no_heading(spark):
    pages = spark.createDataFrame([("d", i, f"Law {i}\nArticle {i}. Xs\n{'abcd'[i]} words\nPage {i} of 4") for i in range(4)], "doc string, page int, text string")
    assert rows(laws.furniture(pages)) == [("d", "Law #"), ("d", "Page # of #")]
    assert rows(laws.furniture(pages.where("page < 2"))) == []


def test_ancestry_ends_on_a_cycle_reached_from_outside(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5), (6, 6)], "child bigint, parent bigint")
    found = rows(graph.ancestry(edges, spark.createDataFrame([(3,)], "node bigint")))
    assert found == [(1, 3, 2), (2, 3, 1), (3, 3, 1), (4, None, 1), (5, None, 0), (6, None, 0)]


def test_merge_drops_headers_and_every_import_of_a_module(spark):
    head = lambda s: (s, "rdf:type", "owl:Ontology", None, None)
    body = [("a", "owl:imports", "b", None, None), ("b", "owl:imports", "c", None, None), ("a", "owl:imports", "c", None, None), ("a", "owl:imports", "elsewhere", None, None), ("x", "rdfs:label", "c", None, "en"), ("b", "dct:title", "B", None, None), ("x", "rdfs:label", "c", None, "en")]
    modules = spark.createDataFrame([head("a"), head("b"), head("c"), *body], "s string, p string, o string, dt string, lang string")
    kept = [head("a"), ("a", "owl:imports", "elsewhere", None, None), ("x", "rdfs:label", "c", None, "en")]
    assert rows(statements.merged_modules(modules, "a")) == sorted(kept, key=repr)
    assert rows(statements.merged_away(modules, "a")) == sorted({head("a"), head("b"), head("c"), *body} - set(kept), key=repr)


def test_searches_in_blocks_equal_all_pairs(spark):
    vectors = [(i, "ab"[i % 2], f"n{i % 7}", [float((i * 7 + j * j) % 5 - 2) for j in range(6)]) for i in range(60)]
    own = spark.createDataFrame([v for v in vectors if any(v[3])], "id bigint, kind string, norm string, embedding array<double>")
    few = own.where("id % 10 = 0")
    cosine = lambda x, y: round(1 - min(1.0, max(0.0, sum(a * b for a, b in zip(x, y, strict=True)))), 6)
    expected = []
    for i, kind, _, x in vectors:
        if i % 10 == 0 and any(x):
            near = sorted((cosine(x, y), j) for j, other, _, y in vectors if other == kind and j != i and any(y))[:3]
            expected += [(i, j, d, r + 1) for r, (d, j) in enumerate(near)]
    assert rows(matching.nearest(few, own, 3)) == sorted(expected, key=repr)
    listed = few.selectExpr("id", "id + 2 as t_id")
    whole = {tuple(r) for r in matching.scored_pairs(few, own).join(listed, ["id", "t_id"]).collect()}
    assert whole and {tuple(r) for r in matching.listed_pairs(few, own, listed).collect()} == whole


def test_same_concepts_of_an_iri_that_many_rows_share(spark):
    some = [(i, i % 50, None if i % 7 == 0 else "" if i % 3 else f"n{i % 4}") for i in range(400)] + [(400, None, "n0")]
    own = spark.createDataFrame(some, "id bigint, iri bigint, norm string")
    pairs = spark.createDataFrame([(0, 3, 0.8, 0.0), (0, 50, 0.9, 1.0), (0, 4, 0.1, 0.1)], "id bigint, t_id bigint, score double, lexical double")
    expected = {(0, 3): 3}
    for i, iri, norm in some:
        for j, other, name in some:
            if i % 100 == 0 and i != j and (iri == other is not None or (norm and norm == name)):
                expected[i, j] = 1 if iri == other is not None else 2
    assert rows(matching.same_concept_pairs(own.where("id % 100 = 0"), own, pairs)) == sorted(((*k, v) for k, v in expected.items()), key=repr)


def test_same_concepts_by_iri_grow_with_the_table(spark):
    found = QUERIES["c20_same_concepts"](spark, SF).where("rule = 1")
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows(found.select("id", "t_id")) == sorted(((i, j) for i in ids for j in ids if i % 100 == 0 and i != j and i % 50 == j % 50), key=repr)


def test_pages_lose_marks_and_spaced_headings(spark):
    text = "▼B\nS e c t i o n 1\n►C1 ofﬁce ◄ and a b c\nﬂow ►M2 on"
    found = laws.cleaned(spark.createDataFrame([("d", 1, text), ("d", 2, "◄"), ("d", 3, "")], "doc string, page int, text string"))
    assert rows(found) == [("d", 1, "office and a b c\nflow on", 0, 3, 1, 2), ("d", 2, "", 0, 1, 0, 0), ("d", 3, "", 0, 0, 0, 0)]


def test_halves_share_the_rows_over(spark):
    found = measure.halves(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "key bigint, s string"), ["s"], "1")
    assert rows(found.groupBy("s", "half").count()) == sorted([("a", 0, 2), ("a", 1, 1), ("b", 0, 1), ("b", 1, 2), ("c", 0, 2), ("c", 1, 1)], key=repr)
    assert rows(measure.halves(found.select("key", "s").limit(0), ["s"], "1")) == []


def test_questions_on_a_law(spark):
    graph_ = spark.createDataFrame(
        [("c:a", "rdfs:subClassOf", "onto:Rights"), ("onto:Rights", "rdfs:subClassOf", "top"), ("c:b", "rdfs:subClassOf", "c:a"), ("i:1", "rdf:type", "onto:Rights"), ("i:1", "onto:are_constituted_of", "i:2"), ("i:2", "rdf:type", "owl:NamedIndividual"),
         ("c:m", "skos:closeMatch", "dpv:x"), ("dpv:x", "skos:broader", "dpv:y"), ("dpv:y", "rdfs:subClassOf", "dpv:DataSubjectRight"), ("c:s", "dct:source", "art. 12"), ("c:t", "dct:source", "art. 12, 3"), ("c:s", "rdfs:label", "one"), ("c:s", "rdfs:label", "two"),
         ("i:1", "onto:responsable_de_canalizar_el_ejercicio_de_derechos", "i:2"), ("p", "onto:age", "15"), ("p", "onto:can_give_explicit_consent_to_treatment", "true"), ("q", "onto:age", "9"), ("q", "onto:can_give_explicit_consent_to_treatment", "false")],
        "s string, p string, o string",
    )
    ask = lambda name: rows(law_questions.answered(graph_, law_questions.QUESTIONS[name]))
    assert ask("l01_rights") == sorted([("c:a", None, None, None), ("c:b", None, None, None), ("i:2", None, None, None), ("c:m", None, "dpv:x", None), ("c:s", "one", None, "art. 12"), ("c:s", "two", None, "art. 12")], key=repr)
    assert ask("k04_ensures") == [("i:2", None)] and ask("k05_age") == [("p", "15")] and ask("l08_infringements") == []


def test_quads_and_escapes(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://x/a> <http://x/p> "caf\\u00E9 \\U0001F600 \\\\u0041 \\u005Cn"@es <http://x/g> .\n_:b <http://x/p> <http://x/o> _:g .\n# note\n<http://x/a> <http://x/q> "1"^^<http://x/int> .\n')
    found = [(r.s, r.o, r.dt, r.lang) for r in statements.read_statements(spark, str(tmp_path)).collect()]
    assert found == [("http://x/a", "café 😀 \\u0041 \\n", "rdf:langString", "es"), ("_:b", "http://x/o", None, None), ("http://x/a", "1", "http://x/int", None)]


def test_json_ld_of_others(spark, tmp_path):
    doc = """{"@graph": [
      {"@id": "http://x/a", "@type": ["http://x/C", "http://x/D"], "http://x/p": [{"@value": "uno", "@language": "es"}, {"@value": 5}, {"@value": true}, {"@value": "5"}, {"@id": "_:n"}]},
      {"@id": "_:n", "http://x/q": [{"@value": "[not a list] {", "@type": "http://x/t"}]}]}"""
    (tmp_path / "a.jsonld").write_text(doc)
    rdf, xsd = statements.RDF + "type", statements.XSD
    expected = [("http://x/a", rdf, "http://x/C", "iri", None, None), ("http://x/a", rdf, "http://x/D", "iri", None, None), ("http://x/a", "http://x/p", "uno", "literal", "rdf:langString", "es"), ("http://x/a", "http://x/p", "5", "literal", xsd + "integer", None),
                ("http://x/a", "http://x/p", "true", "literal", xsd + "boolean", None), ("http://x/a", "http://x/p", "5", "literal", None, None), ("http://x/a", "http://x/p", "_:n", "bnode", None, None), ("_:n", "http://x/q", "[not a list] {", "literal", "http://x/t", None)]
    assert rows(statements.read_json_ld(spark, str(tmp_path / "a.jsonld"), lines=False)) == sorted(expected, key=repr)
    (tmp_path / "b.jsonld").write_text('[{"@id": "a", "p": [{"@list": []}]}]')
    (tmp_path / "c.jsonld").write_text('{"@context": {"p": "http://x/p"}, "@id": "a", "p": "x"}')
    (tmp_path / "d.jsonld").write_text('{"@id": "a", "p": [')
    for name in "bcd":
        with pytest.raises(Exception, match="JSON-LD"):
            statements.read_json_ld(spark, str(tmp_path / f"{name}.jsonld"), lines=False).collect()


@pytest.mark.parametrize(("encoding", "sep"), [("utf-8-sig", ","), ("utf-8", ";"), ("cp1252", ";")])
def test_labelled_samples(spark, tmp_path, encoding, sep):
    (tmp_path / "a.csv").write_bytes(f"key{sep}name{sep}n\n1{sep}año €{sep}7\n2{sep}{sep}\n".encode(encoding))
    assert rows(statements.read_labelled(spark, str(tmp_path), "n int, key string, name string, more string")) == [(7, "1", "año €", None), (None, "2", None, None)]


def test_stored_collections(spark, tmp_path):
    path = str(tmp_path / "c")
    own = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, document string")
    assert collections.collection_state(spark, path, "f") == "missing"
    assert [collections.ensure_collection(own, path, f) for f in ("f", "f", "g")] == ["missing", "current", "stale"]
    with pytest.raises(ValueError, match="more than once"):
        collections.build_collection(own.unionByName(own), path, "g")
    more = spark.createDataFrame([(2, "x"), (3, "y")], "id bigint, document string")
    for _ in range(2):
        collections.upsert_collection(more, path)
        assert rows(collections.read_collection(spark, path)) == [(1, "a"), (2, "x"), (3, "y")]
    version = collections.newest(spark, path).version
    own.limit(1).write.mode("overwrite").parquet(f"{path}/{version}")
    assert collections.collection_state(spark, path, "g") == "incomplete"


def test_common_subsequences_of_any_length(spark):
    rng, pairs = random.Random(3), [("", ""), ("a", ""), ("ñandú 😀", "nandú 😀"), ("x" * 62, "x" * 62), ("ab" * 40, "ba" * 40)]
    pairs += [tuple("".join(rng.choice("abcd ") for _ in range(rng.choice([3, 20, 61, 62, 63, 70]))) for _ in range(2)) for _ in range(40)]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    for r in found:
        row = [0] * (len(r.b) + 1)
        for x in r.a:
            before = row[:]
            for i, y in enumerate(r.b):
                row[i + 1] = before[i] + 1 if x == y else max(before[i + 1], row[i])
        assert r.n == row[-1]
