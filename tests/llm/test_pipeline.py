"""The pipeline stage by stage on the given small table, and registered queries that SQL can express."""

import pytest
from compare import database, mismatch

import corpus_pipeline
from attestry.llm import near_dup, queries, toxicity
from attestry.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    model = toxicity.fit(docs, table(spark, FOLDER, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    twice = docs.union(docs.limit(5))
    single = corpus_pipeline.drop_near_duplicates(spark, twice, FOLDER)
    kept = {r.doc_id for r in near_dup.near_duplicates(docs, 80).where("kept").collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept)


def test_run_deals_every_row_of_the_mix(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    slots = {(r.shard, r.slot) for r in got}
    assert got and len(slots) == len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert mismatch(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLES[name]) is None
