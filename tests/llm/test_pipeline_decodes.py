"""The pipeline's last stage codes and decodes."""


def test_encode_stage_decodes_its_ids(spark):
    import corpus_pipeline
    texts = {1: "Two  words, naïve 日本 \U0001f600", 2: "", 3: None, 4: "x" * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert {d: bytes(r.decoded) for d, r in got.items()} == {d: (t or "").encode() for d, t in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in got.values())
