import hashlib
import os

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from riskflow.llm import bpe
from riskflow.llm.common import vocabulary_file

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{scratch}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == start.columns
    assert kept["language_id"] == start.count() >= kept["exact_dedup"] >= kept["near_dedup"] > 0
    reference = Tokenizer.from_file(vocabulary_file())
    text = {r.doc_id: r.text for r in start.collect()}
    rows = docs.collect()
    for r in rows:
        assert bpe.unpack(bytes(r.ids)) == reference.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, odd, none, name, stage):
    out = stage(spark, odd, SF)
    assert out.count() > 0 and (name == "bpe" or out.columns == odd.columns)
    assert stage(spark, none, SF).count() == 0


def test_run_keeps_the_rows_of_one_stage(spark, monkeypatch):
    held = []
    step = lambda spark, docs, folder: held.append(docs.inputFiles()) or docs.limit(len(held) + 1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", step) for i in range(4)])
    assert corpus_pipeline.run(spark, SF).count() == 2
    there = [[os.path.exists(f.removeprefix("file://")) for f in files] for files in held]
    assert all(there[0]) and not any(x for files in there[1:] for x in files)


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
