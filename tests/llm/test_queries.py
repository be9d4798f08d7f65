"""Every registered query runs over whole tables; twins, accuracy and the pipeline's stages."""

import pytest

import corpus_pipeline
from lineagelab.llm import decontaminate, language, mixing, near_dedup
from lineagelab.llm.queries import QUERIES
from lineagelab.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_twin(spark, name):
    from oracle_check import compare

    res = compare(spark, SF, [name], verbose=False)[name]
    assert res.get("ok") is True, res


def test_language_accuracy_on_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_token_counts_cover_every_document(spark):
    got = QUERIES["op9_token_counts"](spark, SF)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max"}).where("`sum(n_tokens)` <> `max(doc_tokens)`").count() == 0


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
    assert kept["language"] == {r.doc_id for r in language.predict(docs, language.fit(docs)).where("fits and lang_pred <> 'und'").collect()}
    assert kept["near_dedup"] == {r.doc_id for r in near_dedup.near_classes(docs).where("kept").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert kept["decontaminate"] == {r.doc_id for r in decontaminate.judge(docs, bench).where("not contaminated").collect()}
    assert kept["mix"] == {r.doc_id for r in mixing.mix(docs).where("sampled").collect()}
    assert len(kept["shard"]) == docs.count()


def test_pipeline_runs_to_the_end(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"shard", "slot"} <= set(out.columns)
