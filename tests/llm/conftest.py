import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from basketry.session import build_session
    yield build_session("local[4]", app="basketry-llm-tests", shuffle_partitions=4)


PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch quietly from an old oak tree and the "
         "river keeps running towards a distant sea where small boats wait for the morning wind to carry them home again ")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names clash with inner ones."""
    rows = [(1, PROSE, "a"), (1, PROSE, "a"), (2, PROSE.replace("fox", "cat"), None), (3, "", "b"), (4, None, None), (None, "no id here", "c"),
            (5, PROSE * 300, "a"), (6, "  \n\t ", "a"), (7, "日本語 テスト café  double  space", "a"), (8, "x" * 3000, "b"), (9, "word", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    return frame.selectExpr("doc_id", "text", "row_key", "'k' AS key", "1 AS node", "2 AS cluster", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
