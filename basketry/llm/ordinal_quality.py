"""Quality by ordinal cumulative-link regression on graded ratings.

Grades g1 < g2 < ... share one linear score f(x) over hashed features of the
text; ordered thresholds cut it:

    P(grade <= k) = sigmoid(threshold_k - f(x))

The fit gives the expected grade and tail probabilities P(grade >= k); a
document is selected by its tail probability at a wanted grade.  Features are
relative frequencies: words, word shapes (letter case, digits and symbols, runs
collapsed), pairs of shapes, and words that repeat their predecessor, hashed
into 2**BITS weights.  Any set of integer grades works; the weights are learnt
on a bounded sample of rated documents, in one task that holds at most
``FEATURES`` features and the longest document's; only the weights reach the driver.

A text without any non-space character gets the lowest grade; null texts are
such.  Rating rows with a null grade or id are not used; a document with
several ratings counts with the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ship
from basketry.llm.mil_toxicity import sample_labels

BITS = 18
SAMPLE = 2_000  # rated documents per grade, at most
FEATURES = 1 << 24  # features of the sample, at most: documents go in whole, by a hash of the id
SCALE = 10.0


def _bucket(text: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def shape(token: str) -> str:
    """Letter case, digits and symbols of a token, runs collapsed: 'Word,' is 'Aa,'."""
    out = []
    for c in token:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Features:
    """Hashed features of a text; those of a token come from a dictionary of bounded size."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.known, self.pairs = limit, {}, {}
        self.again = _bucket("=")

    def _token(self, token: str) -> tuple[int, str]:
        value = (_bucket("w" + token.lower()), shape(token))
        if len(self.known) < self.limit:
            self.known[token] = value
        return value

    def _pair(self, pair: tuple[str, str]) -> tuple[int, int]:
        value = (_bucket("s" + pair[1]), _bucket("p" + pair[0] + " " + pair[1]))
        if len(self.pairs) < self.limit:
            self.pairs[pair] = value
        return value

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Buckets and values; None for a text without tokens."""
        tokens = (text or "").split()
        if not tokens:
            return None
        get, pair = self.known.get, self.pairs.get
        found = [x if (x := get(t)) is not None else self._token(t) for t in tokens]
        words = [w for w, _ in found]
        shapes = [s for _, s in found]
        both = [x if (x := pair(p)) is not None else self._pair(p) for p in zip(["^", *shapes], shapes)]
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        n = len(tokens)
        buckets, counts = np.unique(np.array(words + [x for p in both for x in p] + [self.again], np.int64), return_counts=True)
        values = counts / n * SCALE
        values[np.searchsorted(buckets, self.again)] += (repeats - 1) / n * SCALE
        return buckets, values


def train(flat: np.ndarray, value: np.ndarray, per_doc: np.ndarray, grades: np.ndarray, levels: int, weights: np.ndarray, rounds: int = 200,
          rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds (levels - 1) from buckets, values, features per row, grades 0 .. levels - 1, and row weights."""
    doc = np.repeat(np.arange(len(grades)), per_doc)
    used, column = np.unique(flat, return_inverse=True)
    share = weights / weights.sum()
    below = np.cumsum(np.bincount(grades, share, levels))[:-1].clip(1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    cuts = levels - 1
    # the first threshold and the logarithms of the gaps keep the thresholds ordered
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, rounds + 1):
        gaps = np.exp(theta[len(used) + 1:])
        at = theta[len(used)] + np.concatenate([[0], np.cumsum(gaps)])
        f = np.bincount(doc, theta[column] * value, len(grades))
        upper = np.where(grades < cuts, sigmoid(at[np.minimum(grades, cuts - 1)] - f), 1.0)
        lower = np.where(grades > 0, sigmoid(at[np.maximum(grades - 1, 0)] - f), 0.0)
        chance = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / chance * share, lower * (1 - lower) / chance * share
        df = du - dl  # gradient of the loss along f
        dat = np.bincount(np.minimum(grades, cuts - 1), np.where(grades < cuts, -du, 0), cuts) + np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0), cuts)
        tails = np.cumsum(dat[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, df[doc] * value, len(used)) + ridge * theta[:len(used)], tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-7)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = theta[:len(used)]
    return out, theta[len(used)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(used) + 1:]))])


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", per_grade: int = SAMPLE,
        most: int = FEATURES) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(grades, weights, thresholds) from the sample's documents, at most ``per_grade`` a grade and ``most`` features in all.

    No documents or no ratings give one grade and no thresholds.
    """
    ship(docs.sparkSession)
    taken, counts = sample_labels(ratings, grade, per_grade)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [of(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x[0].tolist() if x else None for x in found], pa.list_(pa.int32())),
                     pa.array([x[1].tolist() if x else None for x in found], pa.list_(pa.float32()))], ["place", "grade", "buckets", "vals"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sizes, flat, values, room = [], [], [], [], most
        for batch in batches:
            for i, mark in enumerate(batch.column(1).to_pylist()):
                buckets = batch.column(2)[i].values.to_numpy()
                if len(buckets) > room:
                    continue
                room -= len(buckets)
                marks.append(mark)
                sizes.append(len(buckets))
                flat.append(buckets.copy())  # a view would hold its batch
                values.append(batch.column(3)[i].values.to_numpy().copy())
        levels = sorted(set(marks))
        if len(levels) > 1:
            shares = np.array([counts[g] / marks.count(g) for g in levels])
            grades = np.searchsorted(levels, marks)
            weights, cuts = train(np.concatenate(flat), np.concatenate(values), np.array(sizes), grades, len(levels), shares[grades])
        else:
            weights, cuts = np.zeros(1 << BITS, np.float32), np.empty(0)
        yield pa.RecordBatch.from_arrays([pa.array([levels], pa.list_(pa.int32())), pa.array([weights.astype("<f4").tobytes()]),
                                          pa.array([cuts.astype("<f8").tobytes()])], ["levels", "weights", "cuts"])

    # broadcast is bounded: the sample's ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    source = rows.select(F.xxhash64("doc_id", "text").alias("place"), "label", "text")
    sample = source.mapInArrow(features, "place long, grade int, buckets array<int>, vals array<float>").filter("buckets is not null")
    # one task holds the sample, whose rows and features are bounded
    sorted_ = sample.repartition(1).sortWithinPartitions("place", "grade")
    row = sorted_.mapInArrow(learn, "levels array<int>, weights binary, cuts binary").first()
    levels = list(row["levels"]) if row else []
    if len(levels) < 2:
        return levels or sorted(counts)[:1] or [0], np.zeros(1 << BITS, np.float32), np.empty(0)
    return levels, np.frombuffer(row["weights"], "<f4"), np.frombuffer(row["cuts"], "<f8")


def grade_chances(f: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade) for each score and level."""
    below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - f[:, None], -40, 40)))
    edge = np.concatenate([np.zeros((len(f), 1)), below, np.ones((len(f), 1))], 1)
    return np.diff(edge, axis=1)


def rate(docs: DataFrame, model: tuple[list[int], np.ndarray, np.ndarray], wanted: int | None = None, keep: list[str] = ()) -> DataFrame:
    """doc_id (and the columns ``keep``), expected_grade and tail_probability, P(grade >= wanted), of every document.

    ``wanted`` is the second lowest grade unless given.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS weights
    wanted = wanted if wanted is not None else model[0][min(1, len(model[0]) - 1)]
    columns = [c for c in keep if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (levels, weights, cuts) = Features(), shared.value
        level, top = np.array(levels, float), np.array(levels) >= wanted
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [of(t) for t in part.column("text").to_pylist()]
                f = np.array([float(weights[x[0]] @ x[1]) if x else 0.0 for x in found])
                chance = grade_chances(f, cuts)
                empty = np.array([x is None for x in found])
                chance[empty] = np.eye(len(levels))[0]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names[:-2]] + [pa.array(chance @ level), pa.array(chance[:, top].sum(1))], names)

    names = ["doc_id", *(["text"] if "text" in keep else []), *columns, "expected_grade", "tail_probability"]
    source = docs.select(*dict.fromkeys(["doc_id", "text", *columns]))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names[:-2]) + ", expected_grade double, tail_probability double")
