"""The pipeline's stages against plain rules, each on what the one before kept."""

import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from obsflow.llm import bpe, neardup, pii
from obsflow.llm.op3 import key

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "near_duplicates":
            want = neardup.components_by_rule({r.doc_id: r.text for r in before.collect()}, 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "personal_data":
            text = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: pii.pseudonymise(t, key(spark).encode())[0] for i, t in text.items()}
        if name == "mixing":
            assert set(map(tuple, docs.collect())) <= set(map(tuple, before.collect()))
        if name == "byte_bpe":
            v = bpe.Vocabulary(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
            text = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.ids for r in docs.collect()} == {i: enc.encode_ordinary(t) for i, t in text.items()}


def test_run_equals_its_stages_and_the_entry_lists_it(spark):
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) >= 10
    assert corpus_pipeline.run(spark, SF).count() > 0
