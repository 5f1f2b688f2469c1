import numpy as np
import sentencepiece

import corpus_pipeline
from cuematch.llm import mixing, stages
from cuematch.llm.queries import QUERIES, piece_model
from tests.llm import cases


def test_stages_keep_columns_and_take_effect(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = source, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == source.columns, name
        seen.append((before, docs))
    good, one, clean, mixed, final = (x[1] for x in seen)
    assert good.count() <= source.count()
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = {c for _, n, c in cases.jaccard_classes(rows) if n} | {r[0] for r in rows if not cases.shingle_set(r[1])}
    assert {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    assert clean.count() == one.count() and all("<secret>" in r["text"] or r["n_chars"] == len(r["text"]) for r in clean.collect())
    copies = {r[0]: r[1] for r in mixing.mix(clean).select("row.doc_id", "copies").collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    out = final.collect()
    assert len(out) == mixed.count()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == model.encode(texts[r["doc_id"]], add_bos=True, add_eos=True) for r in out)


def test_empty_documents_pass_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for stage in (stages.keep_good, stages.keep_one_of_each_group, stages.redact_secrets, stages.mix_sources, stages.sentence_pieces):
        assert stage(spark, docs, sf).count() == 0


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}
