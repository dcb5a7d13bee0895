import corpus_pipeline
from mergelens.llm import registry
from mergelens.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents").limit(150).cache()
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns, name
        assert dict(out.dtypes) == dict(docs.dtypes), name
        kept, had = {r["doc_id"] for r in out.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= had, name
        docs = out
    assert 0 < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name


def test_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "decontamination", "packing"]
