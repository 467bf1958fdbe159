"""Collocations against counting every phrase with Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.llm import phrase_index
from basketry.llm.queries import op11_phrase_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most=5, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows_ = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((" ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        rows_.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows_[:top])]
    return sorted(out)


def as_rows(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_extension_of_both_sides():
    """Intervals of every phrase, reached over either side, hold its occurrences."""
    random.seed(3)
    ids = np.array([0] + [random.choice([0, 1, 2, 3]) for _ in range(400)] + [0])
    ahead, back = (phrase_index.Index(phrase_index.transform(x)) for x in (ids, ids[::-1].copy()))
    text = "".join(map(str, ids))
    starts = {str(c): (int((ids < c).sum()), int((ids == c).sum())) for c in (1, 2, 3)}
    known = {p: (s, n, s) for p, (s, n) in starts.items()}
    for length in range(2, 6):
        names = sorted(known)
        low, count, other = (np.array([known[p][i] for p in names]) for i in range(3))
        right = phrase_index.extend(back, other, other + count, low)
        left = phrase_index.extend(ahead, low, low + count, other)
        from_right = {names[of] + str(c): (int(new_low), int(n), int(new_other)) for of, c, n, new_other, new_low in zip(*right)}
        from_left = {str(c) + names[of]: (int(new_low), int(n), int(new_other)) for of, c, n, new_low, new_other in zip(*left)}
        assert from_right == from_left
        want = Counter(text[i:i + length] for i in range(len(text) - length + 1) if "0" not in text[i:i + length])
        assert {p: v[1] for p, v in from_right.items()} == want
        known = from_right


def odd_rows(seed, n):
    random.seed(seed)
    words = ["the", "The", "of", "a", "new york", "New York city", "hot  dog", "x\ty", "é", "É", "日本", "\x85", "to be or not to be"]
    return [(random.choice(["en", "en", "en", "de", None]), " ".join(random.choice(words) + random.choice(["", "", "", ".", ",", "\n", "!?", "\x0b"]) for _ in range(random.choice([0, 1, 5, 40])))) for _ in range(n)]


@pytest.mark.parametrize("least, size, top", [(4, 1 << 20, 2000), (5, 300, 2000), (2, 1000, 7)])
def test_against_plain_counts(spark, least, size, top):
    rows = odd_rows(least, 120) + [("fr", None), ("fr", ""), ("it", " .,;"), ("und", "to be to be to be"), ("en", "go " * 3000)]
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS f", "'k' AS key", "2 AS n").repartition(5)
    got = as_rows(phrase_index.collocations(frame, least=least, top=top, size=size))
    assert got == brute(rows, least, top=top) and got


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    assert as_rows(op11_phrase_index(spark, "/root/testdata/sf0.01")) == brute(rows, 100)


def test_empty_table(spark, odd_docs):
    assert phrase_index.collocations(odd_docs.limit(0)).count() == 0
    assert as_rows(phrase_index.collocations(odd_docs, least=3)) == brute([("en", r.text) for r in odd_docs.collect()], 3)
