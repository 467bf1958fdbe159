"""op7 tells the passages of over 50 words that repeat, and takes out none of them that the 400-byte law keeps."""

from collections import Counter

import numpy as np
import pytest

from basketry.llm import queries, suffix_dedup
from basketry.llm.common import WordHasher


def brute(texts, words):
    """n_passages and passage_words of every text."""
    hasher = WordHasher()
    found = [hasher(t).tolist() for t in texts]
    grams = [[tuple(f[i:i + words]) for i in range(len(f) - words + 1)] for f in found]
    seen = Counter(g for mine in grams for g in mine)
    out = []
    for f, mine in zip(found, grams):
        held = np.zeros(len(f) + 1, np.int8)
        for i, g in enumerate(mine):
            if seen[g] > 1:
                held[i:i + words] = 1
        out.append((int((np.diff(np.concatenate([[0], held])) > 0).sum()), int(held.sum())))
    return out


def texts():
    random = np.random.default_rng(23)
    words = lambda n: " ".join("".join(random.choice(list("abcdeéfgh"), 5)) for _ in range(n))
    edge, long, other = words(50), words(51), words(55)
    rows = [f"{words(30)} {edge} {words(20)}" for _ in range(2)] + [f"{words(30)} {p} {words(20)}" for p in (long, long + ",", f'"{long.upper()}"')]
    rows += [f"{words(9)} {other} {words(9)} {other}", f"{other} {words(60)} {long}", words(130), words(51), "", None, " \n-- ", long, long]
    return rows + [words(5) + " " + words(200)] * 2


@pytest.mark.parametrize("classes", [2048, 2])
def test_passages_are_told(spark, odd_docs, classes):
    docs = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame([*enumerate(texts()), (None, texts()[2])], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.remove_repeats(docs, 400, classes, words=51).collect()
    want = Counter((d, len((t or "").encode()), *x) for (d, t), x in zip(rows, brute([t for _, t in rows], 51)))
    assert Counter((r.doc_id, r.n_bytes, r.n_passages, r.passage_words) for r in got) == want
    plain = suffix_dedup.remove_repeats(docs, 400, classes, with_text=True)
    assert Counter(tuple(r)[:6] for r in got) == Counter(map(tuple, plain.collect()))


def test_op7_tells_passages_under_400_bytes(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(7)] == [0] * 7
    assert [(got[i].n_passages, got[i].passage_words) for i in range(9)] == [(0, 0)] * 2 + [(1, 51)] * 3 + [(2, 110), (2, 106)] + [(0, 0)] * 2
