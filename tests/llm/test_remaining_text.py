"""op7's text column is what its digest is of."""

import hashlib

from basketry.llm import suffix_dedup


def test_text_and_digest_agree(spark):
    shared = "a passage that stands in two documents, " * 12
    docs = spark.createDataFrame([(1, "first: " + shared), (2, shared + " second"), (3, "alone"), (4, None)], "doc_id long, text string")
    plain = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for r in suffix_dedup.remove_repeats(docs, with_text=True).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 == plain[r.doc_id].kept_sha256
        assert len(r.text) == r.n_bytes - r.n_removed
    assert plain[1].n_removed > 400 and plain[3].n_removed == 0
