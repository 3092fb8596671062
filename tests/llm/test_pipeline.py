"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from spanlens.llm import bpe, queries, quality
from spanlens.llm.common import materialise
from tests.llm.test_operators import by_hand, contamination, expected_classes

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, D), "test-stage")
        kept.append(docs)
    assert all(k.columns == columns for k in kept[:-1])
    first = spark.read.parquet(f"{D}/documents.parquet")
    good = {r.doc_id for r in quality.score(first, quality.train(first)).filter("good").collect()}
    assert {r.doc_id for r in kept[0].collect()} == good
    rows = [(r.doc_id, r.text) for r in kept[0].collect()]
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted({v[0] for v in expected_classes(rows).values()})
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    before = kept[1].collect()
    dirty = {r.doc_id for r, (n, hit, _) in zip(before, contamination([r.text for r in before], items), strict=True) if hit and 20 * hit >= n}
    assert {r.doc_id for r in kept[2].collect()} == {r.doc_id for r in before} - dirty
    was = {r.doc_id: r.text for r in kept[2].collect()}
    for r in kept[3].collect():
        assert not by_hand(r.text) and r.n_chars == len(r.text)
        assert (r.text == was[r.doc_id]) == ("[secret]" not in r.text)
    coder = bpe.encoder(queries.BPE_RANKS, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    for r in kept[4].collect():
        assert b"".join(coder.pairs.vocab[i] for i in r.ids) == texts[r.doc_id].encode()
    assert kept[4].count() == len(texts)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, D), "test-empty")
    assert docs.count() == 0
