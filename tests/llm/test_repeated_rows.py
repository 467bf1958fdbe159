"""Rows whose id repeats, in searches and archives."""

import numpy as np

from basketry.llm import rotated_codes, warc_bundles


def test_vectors_of_one_id_are_rows_of_their_own(spark):
    random = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in random.normal(size=8)]) for i in random.integers(0, 60, 300)]
    rows += [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.5, 0.5]), (2, [0.0, 1.0]), (20, [7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "'x' AS query_id")
    got = rotated_codes.nearest(frame, lambda c: c % 20 == 0, 5, rows_per_block=64, queries_per_block=7).collect()
    want = []
    for i, (query, q) in enumerate(rows):
        if query % 20 == 0:
            other = sorted(((-float(np.dot(q, v)), c) for j, (c, v) in enumerate(rows) if j != i and len(v) == len(q)))[:5]
            want += [(query, r + 1, c, round(-s, 9)) for r, (s, c) in enumerate(other)]
    mine = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got]
    assert len(mine) == len(want) and len(set(mine) & set(want)) >= 0.97 * len(set(want))
    assert {x for x in mine if x[0] == 0 and x[3] in (0.9, 0.5)} >= {(0, 1, 0, 0.9), (0, 2, 1, 0.5)}


def test_one_response_where_the_largest_page_id_repeats(spark):
    rows = [(7, "a", "same"), (7, "b", "same"), (7, "a", "same"), (3, "c", "same"), (8, "d", "own"), (None, "e", "same")] + [(50, "u", "hot")] * 40 + [(9, "x", "hot")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = warc_bundles.warc_bundles(frame).collect()
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert found == sorted([(7, "response", 0), (7, "revisit", 7), (7, "revisit", 7), (3, "revisit", 7), (8, "response", 0), (0, "revisit", 7),
                            (50, "response", 0), (9, "revisit", 50)] + [(50, "revisit", 50)] * 39)
