from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_queries import odd_documents, tables


def test_stages_do_what_they_say(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    from emberframe.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = written(stage(spark, docs, tiny), "test-stage")
        assert found.columns == docs.columns and found.schema == docs.schema
        own = {r["doc_id"]: r["text"] for r in docs.collect()}
        left = {r["doc_id"]: r["text"] for r in found.collect()}
        if name == "language_id":
            assert set(left) == {i for i, t in own.items() if any(c.isalpha() for c in t or "")}
        elif name == "jaccard_join":
            classes = brute.jaccard(list(own.items()))
            assert set(left) == {c for c, _ in classes.values()}
        elif name == "decontamination":
            assert set(left) == {r[0] for r in brute.contamination(list(own.items()), items) if not r[5]}
        else:
            assert set(left) == set(own) and not any(brute.base_spans(t) for t in left.values())
            assert all(left[i] == own[i] for i in own if not brute.base_spans(own[i]) and left[i].count("[SECRET]") == own[i].count("[SECRET]"))
        docs = found
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert {r["doc_id"] for r in tokens} == {r["doc_id"] for r in docs.collect()} <= set(before)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids"][0] == 1 and r["ids"][-1] == 2 for r in tokens)


def test_last_stage_decodes(spark, tiny):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.piece_model())
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(50)
    found = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert len(found) == 50 and all(r["decoded"] == library.decode(list(r["ids"])) for r in found)


def test_odd_and_empty_documents(spark, tmp_path):
    odd = tables(spark, tmp_path / "odd", odd_documents(), [], [(0, "nothing like it")], [])
    assert corpus_pipeline.run(spark, odd).count() > 40
    empty = tables(spark, tmp_path / "empty", [], [], [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []
