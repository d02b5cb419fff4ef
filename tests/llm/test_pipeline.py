from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from relaykit.llm import bpe, mixing, pii, toxicity
from tests.llm.test_documents import plain_groups
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF_DIR).cache()
        if name != "tokens":
            assert kept.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train_on_labels(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score(before, model).filter("score >= 0.5").collect()}
            assert {r["doc_id"] for r in before.collect()} - bad == {r["doc_id"] for r in kept.collect()}
        if name == "near_duplicates":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            groups = plain_groups([t for _, t in rows])
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[g][0] for g in groups})
        if name == "personal_data":
            left = pii.find_spans(kept).collect()
            assert kept.count() == before.count() and not any(s["base"] for r in left for s in r["spans"])
        if name == "mixing":
            plan = mixing.plan_mix(before).collect()
            assert kept.count() == sum(r["copies"] * r["rows"] for r in plan)
        if name == "tokens":
            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
            texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
            assert all(r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) for r in kept.collect())


def test_odd_documents_pass_every_stage(spark):
    kept = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 20_000, "en", None, 3), (2, "word " * 20_000, "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        rows = kept.limit(0) if empty else kept
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_DIR)
        assert (rows.count() == 0) == empty


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op6_chat_format", "op10_substring_dedup", "op11_url_filter"])
def test_queries_with_sql(spark, name):
    from relaykit.llm.queries import QUERIES

    query, sql = QUERIES[name]
    assert compare(connect(SF_DIR), query(spark, SF_DIR), sql) == ""
