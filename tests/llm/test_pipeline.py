"""Stages on the small tables: columns stay, decisions take effect, nothing else is lost."""

import corpus_pipeline as pipeline
from ringwarden.llm import packing, pii
from ringwarden.session import store


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, tables = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        kept = store(stage(spark, kept, folder), name)
        assert kept.columns == docs.columns
        tables.append(kept)
    toxic, near, private, mixed = tables
    assert near.count() == near.select("doc_id").distinct().count() <= toxic.count()
    assert private.count() == near.count()
    assert all(not pii.base_spans(r.text) or "[" in r.text for r in private.collect())
    assert mixed.select("doc_id").distinct().count() == private.count() <= mixed.count()
    pieces = pipeline.STAGES[-1][1](spark, mixed, folder).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()}
    assert all(len(r.ids) == 4 * r.length for r in pieces)


def test_packing_remembers_fewer_words(spark, folder, monkeypatch):
    """pipeline: few words remembered give the pieces that many give."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    many = packing.pack(docs, pipeline.TOKENIZER, pipeline.END_ID).collect()
    monkeypatch.setattr(pipeline, "REMEMBERED_WORDS", 500, raising=False)
    few = pipeline.pack_sequences(spark, docs, folder).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == pipeline.READ_ROWS
