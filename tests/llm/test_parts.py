"""Remembered parts of texts, and the bounded sample of the quality model."""

import random

import numpy as np

import public_tokenizers
from basketry.llm import ordinal_quality, token_records
from basketry.llm.pieces import PieceCodes, splitter

BITS_OF_TEXT = ["a", "B", "é", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "1", " ", "　", "漢", "!", "?x", " the", " the,", "\x1c"]


def test_parts_like_the_library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(open(public_tokenizers.path("byte_bpe_50k.json")).read())

    def encode(texts):
        return [np.array(e.ids, "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS_OF_TEXT) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for limits in ((10, 10), (1000, 1000)):  # full dictionaries, and dictionaries with room
        codes = PieceCodes(splitter(token_records.BYTE_LEVEL), encode, *limits)
        assert [c for a in range(0, len(texts), 400) for c in codes(texts[a:a + 400])] == encode(texts)


def test_sample_of_bounded_features(spark):
    docs = spark.createDataFrame([(i, ("Good words here " if i % 2 else "bad BAD bad 77 ") * (i % 5 + 1) + f"own{i}") for i in range(60)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) grade")
    few, many = (ordinal_quality.fit(docs, ratings, "grade", most=n) for n in (40, 1 << 20))
    again = ordinal_quality.fit(docs.repartition(7), ratings.repartition(3), "grade")
    assert few[0] == many[0] == [0, 1] and np.count_nonzero(few[1]) < np.count_nonzero(many[1])
    assert np.array_equal(many[1], again[1]) and np.array_equal(many[2], again[2])  # whatever the partitions
    assert ordinal_quality.fit(docs, ratings, "grade", most=0)[0] == [0]
    wrong = ordinal_quality.rate(docs, many).filter("(tail_probability >= 0.5) != (doc_id % 2 = 1)")
    assert wrong.count() == 0
