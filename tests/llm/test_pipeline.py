"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter

import corpus_pipeline
import pytest
from test_text_operators import measures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out[name] = (before, docs)
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_clean_documents_stay_and_bad_ones_go(stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, _, symbols, _, repeats = measures(r.text)
        if n < 20 or 100 * repeats > 30 * n or 10 * symbols > n:
            assert r.doc_id not in kept
    assert len(kept) > 0.7 * before.count()


def test_each_stage_only_takes_away(stages):
    before, after = stages["line_dedup"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    for name in ("near_dedup", "decontamination"):
        b, a = stages[name]
        assert not Counter(map(tuple, a.collect())) - Counter(map(tuple, b.collect()))


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages["bpe"][1].collect()))


def test_stages_on_odd_tables(spark, odd_documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    good = " ".join(f"word{i} of the text" for i in range(30))
    some = spark.createDataFrame([(50, good, None, None, None), (51, good, "en", "s", 9), (51, good, "en", "s", 9), (None, good, "en", "s", 9)], odd_documents.select(columns).schema)
    docs = odd_documents.select(columns).unionByName(some)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, table, SF)
            assert name == "bpe" or kept.columns == columns
            assert kept.count() <= table.count()
        assert corpus_pipeline.STAGES[1][1](spark, table, SF).count() == table.count()
    kept = corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()
    assert [r.doc_id for r in kept if r.text == good] == [50]
    assert [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect() if r.text == good] == [50, 51, 51, None]
