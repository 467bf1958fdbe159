"""Join of documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

1. Documents with equal shingle sets form a text class; only one row per class
   goes on, with the number of its documents.
2. MinHash signatures are cut into bands.  Classes that share a band are
   candidates; each is tied to the smallest class of the band, never to all,
   and the components of these ties hold every candidate pair.
3. A component's members are dealt into blocks of bounded size, and every pair
   of blocks is one unit of work.  There, candidate pairs compare their MinHash
   values ``STEP`` at a time: with a uniform prior, m matches among n values
   make P(similarity >= t) = P(Binomial(n + 1, t) <= m); a pair is dropped once
   that falls below ``tolerance``.  What remains is verified on the whole sets.
4. Only link counts and a spanning forest of the links leave the units; the
   components of the forest are the near-duplicate classes.

A word is lower-cased and without punctuation at its ends (``WordHasher``); a
text of fewer words than a shingle has is one shingle.  Texts without words
are linked to nothing, and rows without a doc_id have no class.  Rows of one
doc_id with equal shingle sets are one document; with different ones they are
documents of their own, which a class may name by the same doc_id.  The nodes
of ties and links are text classes (64 bits of their keys), mapped to doc_ids
at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import partitions, ship, written
from basketry.llm.components import components
from basketry.llm.shingles import Shingler

BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
STEP = 16  # MinHash values compared at a time
BLOCK = 512  # classes of a component in one block
SIGNED_SCHEMA = "doc_id long, text_hash long, text_key binary, signature binary, bands array<long>"
FOUND_SCHEMA = "a long, b long, links long, edge boolean"


def coefficients(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of multiply-shift hash functions."""
    random = np.random.default_rng(seed)
    a, b = random.integers(0, 2**64, (2, count), dtype=np.uint64)
    return a | np.uint64(1), b


def min_hashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures (rows of 32-bit minima) of non-empty sets."""
    out = np.empty((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 15):
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.cumsum([0] + [len(s) for s in sets[i:j - 1]])
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat(x * a[k] + b[k], starts) >> np.uint64(32)
        i = j
    return out


def least_matches(total: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, fewest matches among n values that keep a pair) for n = step, 2 step, ... total."""
    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(Binomial(n + 1, t) <= m)
            m += 1
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return common / (len(x) + len(y) - common)


def sign(docs: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash (of the text itself), text_key (128-bit hash of the shingle set), signature and band hashes; null without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        shingler, (a, b) = Shingler(n), coefficients(bands * rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingler(t) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = min_hashes([sets[i] for i in full], a, b)
                keys, raw, hashed = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, signed):
                    keys[i], raw[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
                    hashed[i] = [xxhash.xxh3_64_intdigest(raw[i][k * rows * 4:(k + 1) * rows * 4], seed=k) - (1 << 63) for k in range(bands)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(raw, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "text_key", "signature", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    return rows_.mapInArrow(run, SIGNED_SCHEMA)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def verify_unit(nodes, counts, signatures, sets, in_left, in_right, same: bool, bands: int, stages, threshold: float):
    """Links between the left and the right block of one unit.

    Returns (node, documents linked to it) pairs and forest edges (node, node).
    """
    m = len(nodes)
    order, sizes = np.arange(m), np.array([len(s) for s in sets])
    linked, forest, edges = np.zeros(m, np.int64), _Forest(m), []
    for i in np.nonzero(in_left)[0]:
        alive = order[in_right & (order > i)] if same else order[in_right]
        alive = alive[np.minimum(sizes[alive], sizes[i]) >= threshold * np.maximum(sizes[alive], sizes[i]) - 1e-9]
        if not len(alive):
            continue
        equal = signatures[alive] == signatures[i]
        candidate = equal.reshape(len(alive), bands, -1).all(2).any(1)
        alive, equal = alive[candidate], equal[candidate]
        matches, done = np.zeros(len(alive), np.int64), 0
        for n, least in stages:
            matches = matches + equal[:, done:n].sum(1)
            keep = matches >= least
            alive, equal, matches, done = alive[keep], equal[keep], matches[keep], n
            if not len(alive):
                break
        for j in alive:
            if jaccard(sets[i], sets[j]) >= threshold - 1e-12:
                linked[i] += counts[j]
                linked[j] += counts[i]
                if forest.join(int(i), int(j)):
                    edges.append((nodes[i], nodes[j]))
    return [(nodes[i], int(linked[i])) for i in np.nonzero(linked)[0]], edges


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of the same unit, across batches."""
    held, key = [], None
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for row in batch.slice(a, 256).to_pylist():
                own = (row["cluster"], row["left"], row["right"])
                if own != key and held:
                    yield held
                    held = []
                key = own
                held.append(row)
    if held:
        yield held


def text_classes(docs: DataFrame, threshold: float, n: int, tolerance: float = 1e-6, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of each text class: text_key, text_class, n_links, and doc_id and text_hash of the first row of its near-duplicate class (``first``)."""
    spark = docs.sparkSession
    signed = written(sign(docs, n), "signatures")
    classes = written(
        signed.filter("doc_id is not null and text_key is not null").groupBy("text_key")
        .agg(F.min(F.struct("doc_id", "text_hash", "signature", "bands")).alias("first"), F.count_distinct("doc_id").alias("docs"))
        .select("text_key", F.xxhash64("text_key").alias("node"), F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash"),
                "first.signature", "first.bands", "docs"), "text-classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("band", "head")
    ties = banded.join(heads, "band").filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(ties).withColumnRenamed("component", "cluster")
    parts = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    members = clusters.join(parts, "cluster").join(classes.drop("bands"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        shingler = Shingler(n)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                raw = [shingler(t).tobytes() for t in part.column("text").to_pylist()]
                mine = [xxhash.xxh3_128_digest(r) == k for r, k in zip(raw, part.column("text_key").to_pylist())]
                names = ["node", "cluster", "parts", "docs", "signature"]
                out = pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(raw, pa.binary())], [*names, "shingles"])
                yield out.filter(pa.array(mine, pa.bool_()))

    with_sets = (texts.join(members, ["first_id", "text_hash"]).select("node", "cluster", "parts", "docs", "signature", "text_key", "text")
                 .mapInArrow(sets_of, "node long, cluster long, parts int, docs long, signature binary, shingles binary"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = (with_sets.withColumn("part", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
             .drop("other", "parts").repartition(partitions(spark), "cluster", "left", "right")
             .sortWithinPartitions("cluster", "left", "right", "node"))
    stages = least_matches(BANDS * ROWS, STEP, threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            unique = {r["node"]: r for r in rows}  # repeated rows of a text
            rows = list(unique.values())
            left, right = rows[0]["left"], rows[0]["right"]
            part = np.array([r["part"] for r in rows])
            counted, edges = verify_unit(
                [r["node"] for r in rows], [r["docs"] for r in rows],
                np.frombuffer(b"".join(r["signature"] for r in rows), np.uint32).reshape(len(rows), -1),
                [np.frombuffer(r["shingles"], np.uint64) for r in rows], part == left, part == right, left == right,
                BANDS, stages, threshold)
            if counted:
                a = [c[0] for c in counted] + [e[0] for e in edges]
                b = [None] * len(counted) + [e[1] for e in edges]
                links = [c[1] for c in counted] + [None] * len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64()),
                                                  pa.array([x is not None for x in b])], ["a", "b", "links", "edge"])

    found = written(units.mapInArrow(verify, FOUND_SCHEMA), "links")
    own_row = F.struct(F.col("first_id").alias("doc_id"), "text_hash")
    near = components(found.filter("edge").select("a", "b"))
    heads_ = near.join(classes.select("node", own_row.alias("row")), "node").groupBy("component").agg(F.min("row").alias("head"))
    near = near.join(heads_, "component").select("node", "head")
    counts = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    described = (classes.select("text_key", "node", "docs", "first_id", own_row.alias("row")).join(counts, "node", "left").join(near, "node", "left")
                 .select("text_key", F.coalesce("head", "row").alias("first"), F.col("first_id").alias("text_class"),
                         (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return signed, described


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, class_id, n_links, text_class.

    class_id is the smallest doc_id of the near-duplicate class, n_links the
    number of other documents whose similarity reaches the threshold, and
    text_class the smallest doc_id with an equal shingle set.
    """
    signed, described = text_classes(docs, threshold, n, tolerance, block)
    described = described.select("text_key", F.col("first.doc_id").alias("class_id"), "n_links", "text_class")
    joined = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("text_key")).alias("text_key")).join(described, "text_key", "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                         F.coalesce("text_class", "doc_id").alias("text_class"))


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``docs`` with the document of smallest doc_id of every near-duplicate class, one without words of every doc_id, and rows without a doc_id."""
    signed, described = text_classes(docs, threshold, n)
    wordless = signed.filter("doc_id is not null and text_key is null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    kept = described.select("first.doc_id", "first.text_hash").unionByName(wordless).distinct()
    kept = kept.select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_hash"))
    ids = docs.filter(F.col("doc_id").isNotNull()).withColumn("_hash", _text_hash())
    ids = ids.join(kept, (ids["doc_id"] == kept["_kept"]) & (ids["_hash"] == kept["_kept_hash"]), "left_semi").dropDuplicates(["doc_id", "_hash"])
    return ids.drop("_hash").unionByName(docs.filter(F.col("doc_id").isNull()))
