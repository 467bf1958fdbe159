"""Lines that very many texts hold: anchors told apart by what stands around them."""

from collections import Counter

import numpy as np
import pytest

from basketry.llm import suffix_arrays, suffix_dedup
from test_operators import brute_passages, brute_repeats, rows_of


def lined_texts():
    """A line of 150 bytes in 60 texts, in some with the same surroundings, and a text that repeats it many times."""
    random = np.random.default_rng(11)
    words = lambda n: " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(n))
    line, around = words(25), words(60)
    rows = [(i, f"{words(50 + i % 7)} {line} {words(60)}") for i in range(60)]
    rows += [(100 + i, f"{words(20)} {around[i * 5:]} {line} {around[:200 + i]} {words(9)}") for i in range(12)]
    rows += [(200, "\n".join([line] * 40)), (201, f"{line}\n{line}\n{line}\n{line} {words(30)}"), (None, rows[3][1]), (None, None), (202, "")]
    return rows


@pytest.mark.parametrize("levels", [(), (4, 16)])
def test_bytes_and_words(spark, levels):
    rows = lined_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 400)))
    assert Counter(rows_of(suffix_dedup.remove_repeats(docs, 400, 3, levels=levels))) == want
    got = suffix_dedup.without_repeats(docs, 1 << 20, 3, words=51, levels=levels)
    assert Counter(rows_of(got)) == Counter(zip([d for d, _ in rows], brute_passages([t for _, t in rows], 51)))


def test_levels_leave_few_windows_to_compare(spark):
    """Texts that share one line only: after a level no window of the line has a partner left."""
    random = np.random.default_rng(12)
    words = lambda n: " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(n))
    line = words(25)
    docs = suffix_dedup._keyed(spark.createDataFrame([(i, f"{words(70)} {line} {words(70)}") for i in range(80)], "doc_id long, text string"))
    windows = suffix_dedup._windows(docs, 400, False)
    anchor = windows.groupBy("anchor").count().orderBy("count", ascending=False).first()
    assert anchor["count"] >= 40
    raw = docs.selectExpr("row_key", "cast(text as binary) AS raw").join(windows.filter(windows.anchor == anchor["anchor"]), "row_key")
    hot = raw.selectExpr("row_key", "anchor AS gram", "1L AS copies", "first", "starts", "substring(raw, first + 1, starts + 399) AS bytes")
    pieces = suffix_dedup._pieces(hot, 400, 100, False)
    assert pieces.groupBy("anchor").count().filter("count > 1").count() == 0
    assert pieces.groupBy().sum("starts").first()[0] == hot.groupBy().sum("starts").first()[0]


def test_suffix_arrays_of_words():
    random = np.random.default_rng(5)
    data = random.integers(0, 3, 400).astype(np.uint64) << np.uint64(40)
    sa = suffix_arrays.suffix_array(data, len(data))
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tolist())
    marks = suffix_arrays.repeated_starts(data, np.array([0, 200]), np.array([194, 194]), 7)
    starts = [*range(194), *range(200, 394)]
    seen = Counter(tuple(data[i:i + 7].tolist()) for i in starts)
    assert marks.nonzero()[0].tolist() == [i for i in starts if seen[tuple(data[i:i + 7].tolist())] > 1]
