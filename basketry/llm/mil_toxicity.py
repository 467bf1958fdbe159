"""Toxicity by multiple-instance learning: sentences combined by noisy-or.

Only documents have labels.  A sentence s scores p(s) = sigmoid(b + sum of the
weights of its hashed features), and a document is toxic unless none of its
sentences is:

    P(document) = 1 - prod(1 - p(s)) = 1 - exp(-sum softplus(z(s)))

The features of a word (lower case, no punctuation at its ends) are the word
and its first 4 and 5 characters, hashed into 2**BITS weights.  The
likelihood of the documents' labels is maximised over a bounded sample of
labelled documents; the score then names the sentences that make a document
toxic.  Sentences end at ``. ! ?`` or a line end.

Texts without words score as the model's prior for an empty document, 0; null
texts are empty.  A label row with a null label or id is not used, and a
document with several label rows is toxic if one of them says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import ship

BITS = 20
SAMPLE = 2_000  # labelled documents per class, at most
RANGE_BITS = 14  # ranges of doc_id hashes in which label rows are counted
SENTENCE = re.compile(r"[.!?\n\r]+")
PREFIXES = (4, 5)


def word_features(token: str) -> tuple[int, ...]:
    """Buckets of a token; none without an alphanumeric character."""
    import xxhash
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    if a == b:
        return ()
    word = token[a:b]
    texts = ["w" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> (64 - BITS) for t in texts)


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def softplus(z):
    return np.logaddexp(0.0, z)


def train(flat: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 150,
          rate: float = 0.15, shrink: float = 1e-5, least_documents: int = 5) -> tuple[np.ndarray, float]:
    """Feature weights and bias from buckets, buckets per sentence, sentences per document, labels and row weights.

    Full-batch Adam on the weighted mean loss, restricted to the features of
    ``least_documents`` documents or more; ``shrink`` is an L1 penalty by soft
    thresholding.
    """
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc = np.repeat(np.arange(len(labels)), per_doc)
    # features of few documents would only learn those documents by heart
    pair = np.unique(flat.astype(np.int64) * len(labels) + doc[sentence])
    used, seen = np.unique(pair // max(1, len(labels)), return_counts=True)
    used = used[seen >= least_documents]
    at = np.searchsorted(used, flat)
    known = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == flat) if len(used) else np.zeros(len(flat), bool)
    column, sentence = at[known], sentence[known]
    share = weights / weights.sum()
    # expected noisy-or mass of a clean document decides where the bias starts
    bias = float(np.log(0.05 / max(1.0, len(per_sentence) / max(1, len(labels)))))
    theta = np.zeros(len(used) + 1)
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, theta[column], len(per_sentence)) + theta[-1]
        mass = np.bincount(doc, softplus(z), len(labels))
        none = np.exp(-mass)
        slope = np.where(labels > 0, -none / np.maximum(1 - none, 1e-12), 1.0) * share
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.concatenate([np.bincount(column, dz[sentence], len(used)), [dz.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - shrink * rate / (np.sqrt(v[:-1] / (1 - 0.99 ** t)) + 1e-6), 0)
    out = np.zeros(1 << BITS, np.float32)
    out[used] = theta[:-1]
    return out, float(theta[-1])


class Scorer:
    """Scores of texts; token weights come from a dictionary of bounded size."""

    def __init__(self, weights: np.ndarray, bias: float, limit: int = 300_000):
        self.weights, self.bias, self.limit, self.known = weights, bias, limit, {}

    def _weight(self, token: str) -> float:
        found = word_features(token)
        value = float(self.weights[list(found)].sum()) if found else 0.0
        if len(self.known) < self.limit:
            self.known[token] = value
        return value

    def logits(self, text: str) -> list[tuple[str, float]]:
        """Each sentence with words, and its logit."""
        out, get = [], self.known.get
        for s in sentences(text.lower()):
            tokens = s.split()
            if tokens:
                out.append((s, self.bias + sum([w if (w := get(t)) is not None else self._weight(t) for t in tokens])))
        return out

    def __call__(self, text: str | None) -> tuple[float, str | None, float]:
        """Score of the document, its worst sentence (lower case) and that one's score."""
        found = self.logits(text or "")
        if not found:
            return 0.0, None, 0.0
        z = np.array([x for _, x in found])
        worst = int(np.argmax(z))
        return float(-np.expm1(-softplus(z).sum())), found[worst][0].strip(), float(1 / (1 + np.exp(-np.clip(z[worst], -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def least_hashes(rows: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows in the ranges of doc_id hashes that hold each label's ``per_class`` least ones, and all rows per label.

    Rows are counted per label and range (the hash's leading bits), so no task sees all rows of a label.
    """
    rows = rows.withColumn("_range", F.shiftright(F.xxhash64("doc_id"), 64 - RANGE_BITS).cast("int"))
    counts: dict[int, int] = {}
    last: dict[int, int] = {}
    counted = rows.groupBy("label", "_range").count().toArrow()  # bounded: 2**RANGE_BITS rows per label
    for label, place, count in sorted(zip(*(counted.column(c).to_pylist() for c in ("label", "_range", "count")))):
        if counts.get(label, 0) < per_class:
            last[label] = place
        counts[label] = counts.get(label, 0) + count
    if not last:
        return rows.drop("_range").limit(0), counts
    until = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    return rows.filter(F.col("_range") <= until[F.col("label")]).drop("_range"), counts


def sample_labels(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` ids per label value, by a hash of the id, and all rows per value.

    Takes no row whose id belongs to the held-out fold.
    """
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .filter("doc_id is not null and label is not null").filter(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    least, counts = least_hashes(rows, per_class)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    taken = least.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= per_class).select("doc_id", "label")
    return taken, counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from the sample's documents; their features, not their texts, reach the driver."""
    ship(docs.sparkSession)
    taken, counts = sample_labels(labels, label, per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, found, sizes = batch.slice(a, 512), [], []
                for text in part.column(1).to_pylist():
                    all_rows: list[int] = []
                    lengths = []
                    for s in sentences((text or "").lower()):
                        row: list[int] = []
                        for t in s.split():
                            if t not in known:
                                if len(known) >= 300_000:
                                    known.clear()
                                known[t] = word_features(t)
                            row += known[t]
                        if row:
                            all_rows += row
                            lengths.append(len(row))
                    found.append(all_rows)
                    sizes.append(lengths)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
                                                 ["label", "buckets", "sentences"])

    # broadcast is bounded: the sample's ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    table = rows.select("label", "text").mapInArrow(features, "label int, buckets array<int>, sentences array<int>").toArrow()
    marks = np.array(table.column("label").to_pylist(), int)
    seen = {k: int((marks == k).sum()) for k in counts}
    weights = np.array([counts[k] / seen[k] for k in marks.tolist()])
    if not (marks > 0).any() or not (marks == 0).any():
        return np.zeros(1 << BITS, np.float32), -20.0 if not (marks > 0).any() else 20.0
    return train(flattened(table, "buckets"), flattened(table, "sentences"), sizes_of(table, "sentences"), marks, weights)


def flattened(table: pa.Table, column: str) -> np.ndarray:
    """All elements of a list column, in order."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def sizes_of(table: pa.Table, column: str) -> np.ndarray:
    return np.diff(table.column(column).combine_chunks().offsets.to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score, worst (the sentence most likely toxic, lower case) and worst_score of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                scores, worst, worst_scores = zip(*map(scorer, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.string()), pa.array(worst_scores, pa.float64())],
                                                 ["doc_id", "score", "worst", "worst_score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, worst string, worst_score double")
