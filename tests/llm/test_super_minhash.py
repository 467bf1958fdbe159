"""SuperMinHash signatures and near-duplicate groups against exact sets."""

import random
import re

import numpy as np
import pytest

from basketry.llm import super_minhash
from basketry.llm.queries import op13_super_minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, n, percent=80):
    """Sorted (doc_id, n_shingles, component_id, kept) of rows with an id, by all pairs of sets."""
    sets = [exact_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 10 * min(len(x), len(y)) >= 7 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def as_rows(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect())


def test_signature_is_the_plain_algorithm():
    """Against Fisher-Yates with a permutation per element, written out."""
    random.seed(1)
    sets = [np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 7, 40, 300)]
    got = super_minhash.super_min_hashes(sets, 20)
    for s, row in zip(sets, got):
        want = [2**64 - 1] * 20
        for x in s:
            state = super_minhash.mix64(np.array([x ^ np.uint64(13)]))
            p = list(range(20))
            for j in range(20):
                state = super_minhash.mix64(state + np.uint64(0x9E3779B97F4A7C15))
                k = j + ((int(state[0]) >> 32) * (20 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 56 | int(super_minhash.mix64(state)[0]) & (1 << 56) - 1)
        assert row.tolist() == want


def test_estimate_varies_less_than_independent_values():
    random.seed(2)
    errors = []
    for _ in range(300):
        both = [random.getrandbits(64) for _ in range(20)]
        x, y = (np.unique(np.array(both + [random.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(2))
        a, b = super_minhash.super_min_hashes([x, y], 64)
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * 0.25 / 64


def planted(seed, count=60):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(count):
        base = [random.choice(words) for _ in range(random.choice([3, 30, 80]))]
        for _ in range(random.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(random.choice([0, 1, 3, 6])):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((d := d + 1, random.choice(["  ", " "]).join(copy)))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, block", [(2, 1024), (5, 2)])
def test_groups_against_all_pairs(spark, n, block):
    rows = planted(n) + [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "One"), (1004, "oNE"), (1005, "É x"), (1006, "é x"), (1007, "a b " * 4000), (1007, "other text here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2L AS component", "'x' AS text_key")
    assert as_rows(super_minhash.near_groups(frame, n=n, block=block)) == brute(rows, n)


def test_chain_of_copies_that_only_neighbours_reach(spark):
    words = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(words[4 * i:4 * i + 40])) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1)
    assert {r[2] for r in want} == {0}
    assert as_rows(super_minhash.near_groups(frame, n=1, block=3)) == want


def test_rows_without_id_repeated_rows_and_empty_table(spark, odd_docs):
    got = super_minhash.near_groups(odd_docs, n=2)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(got.filter("doc_id is not null")) == brute([r for r in rows if r[0] is not None], 2)
    assert [(r.component_id, r.kept) for r in got.filter("doc_id is null").collect()] == [(None, True)]
    assert super_minhash.near_groups(odd_docs.limit(0)).count() == 0


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(op13_super_minhash(spark, "/root/testdata/sf0.001")) == brute(rows, 2)
