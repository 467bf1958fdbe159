"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``11011011`` hashes the words at its ones and ignores those at
its zeros, so a passage still meets its benchmark item where words were
replaced.  Hashes of all masks over all items go into a bit table of bounded
size; documents emit only the hashes that the table may hold, these are joined
to the items' hashes, and every distinct (document, item, diagonal) is verified
on the words: along the diagonal the best run of matches (+1) and mismatches
(-2) must have at least ``min_words`` matching words and a share of
``min_share`` of them.

Words are as in ``WordHasher``: lower case, no punctuation at the ends.  Items
with fewer words than ``min_words`` must match as a whole, and items too short
for any mask (fewer than 6 words) take no part.  Null texts have no words;
rows and items that repeat are reported once; a null doc_id or item_id stays
null in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WordHasher, combine, ship, written

MASKS = ("111111", "11011011", "1101010011", "111001011")
LEAST_BITS, MOST_BITS = 24, 28  # the bit table takes 2 to 32 MB
PROBES = 3
MATCH, MISMATCH = 1, -2


def all_seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and spans of every mask at every place where it fits."""
    at, out, spans = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for number, mask in enumerate(masks):
        n = len(words) - len(mask) + 1
        if n > 0:
            ones = [i for i, c in enumerate(mask) if c == "1"]
            tag = np.full(n, number + 1, np.uint64)
            out.append(combine([tag, *(words[i:i + n] for i in ones)]))
            at.append(np.arange(n))
            spans.append(np.full(n, len(mask)))
    return np.concatenate(at), np.concatenate(out), np.concatenate(spans)


def seed_hashes(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one text's seeds."""
    at, found, _ = all_seeds(words, masks)
    return at.astype(np.int32), found


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct sorted keys and the values of each."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first].tolist(), np.split(values, first[1:]) if len(first) else []


def item_words(items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """item_id, item_key, words (binary of 64-bit hashes) and seeds (array of position and hash) of each item."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, raw, places, hashes = batch.slice(a, 512), [], [], []
                for text in part.column(2).to_pylist():
                    words = hasher(text)
                    at, found = seed_hashes(words, masks)
                    raw.append(words.tobytes())
                    places.append(at.tolist())
                    hashes.append(found.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(raw, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                    ["id", "key", "words", "places", "hashes"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = items.select(F.col("id").cast("long").alias("id"), F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("\n"), text)).alias("key"), text.alias("text"))
    return keyed.mapInArrow(run, "id long, key string, words binary, places array<int>, hashes array<long>").dropDuplicates(["key"])


def bit_table(seeds: DataFrame) -> np.ndarray:
    """The bits that the items' hashes set; its size follows their number up to 2**MOST_BITS bits."""
    count = max(1, seeds.count())
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * count - 1).bit_length()))
    places = F.array(*[F.shiftrightunsigned(F.col("hash"), 18 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(PROBES)])
    words = (seeds.select(F.explode(places).alias("place"))
             .groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set")))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():  # bounded: 2**(MOST_BITS - 6) rows
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the table may hold."""
    bits, live = (len(table) * 64).bit_length() - 1, np.arange(len(hashes))
    for k in range(PROBES):
        place = (hashes[live] >> np.uint64(18 * k)) & np.uint64((1 << bits) - 1)
        live = live[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
    return live


def candidates(docs: DataFrame, table: np.ndarray, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, doc_key, words and possible seeds of the documents that have any."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded: 2**MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(), shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, keep, raw, places, hashes = batch.slice(a, 512), [], [], [], []
                words = [hasher(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(w) for w in words])
                # all texts in one go; seeds that reach over a text's end are none
                at, found, spans = all_seeds(np.concatenate(words), masks)
                hit = may_hold(bits, found)
                owner = np.searchsorted(ends, at[hit], side="right")
                inside = at[hit] + spans[hit] <= ends[owner]
                hit, owner = hit[inside], owner[inside]
                order = np.argsort(owner, kind="stable")
                for i, mine in zip(*_grouped(owner[order], hit[order])):
                    keep.append(i)
                    raw.append(words[i].tobytes())
                    places.append((at[mine] - (ends[i] - len(words[i]))).tolist())
                    hashes.append(found[mine].view(np.int64).tolist())
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keep)), pa.array(raw, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                        ["doc_id", "words", "places", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, words binary, places array<int>, hashes array<long>")
    return found.withColumn("doc_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit("\n").cast("binary"), F.col("words"))))


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
    """Score, start in the document, length and matches of the best run on a diagonal (document minus item position)."""
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = doc[a:b] == item[a - diagonal:b - diagonal]
    gain = np.where(same, MATCH, MISMATCH)
    total = np.concatenate([[0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.nonzero(total[:end + 1] == low[end])[0][-1])
    return int(total[end] - total[start]), a + start, end - start, int(same[start:end].sum())


def overlaps(docs: DataFrame, items: DataFrame, min_words: int = 8, min_share: float = 0.75, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Documents (doc_id, text) that overlap items (item_id, text), one row per document and item.

    Returns doc_id, item_id, doc_start, item_start, n_words, n_matched (the
    best overlap, in words); documents without any do not occur.
    """
    bench = written(item_words(items.select(F.col("item_id").alias("id"), "text"), masks), "items")
    seeds = bench.select("key", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select(
        "key", F.col("s.places").alias("item_at"), F.col("s.hashes").alias("hash"))
    found = written(candidates(docs, bit_table(seeds), masks), "seeded")
    hits = found.select("doc_key", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select(
        "doc_key", F.col("s.places").alias("doc_at"), F.col("s.hashes").alias("hash"))
    diagonals = (hits.join(seeds, "hash").select("doc_key", "key", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
                 .groupBy("doc_key", "key").agg(F.collect_list("diagonal").alias("diagonals")))  # bounded: words of a document
    sides = (diagonals.join(found.select("doc_key", "doc_id", F.col("words").alias("doc_words")).dropDuplicates(["doc_key"]), "doc_key")
             .join(bench.select("key", F.col("id").alias("item_id"), F.col("words").alias("item_words")), "key"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = []
                for doc_id, item_id, doc, item, diagonals in zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns)):
                    doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
                    runs = [(*best_run(doc, item, d), d) for d in diagonals]
                    fits = [r for r in runs if r[3] >= min(min_words, len(item)) and r[3] >= min_share * r[2]]
                    if fits:
                        _, start, n, matched, diagonal = max(fits, key=lambda r: (r[0], -r[1]))
                        rows.append((doc_id, item_id, start, start - diagonal, n, matched))
                if rows:
                    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matched"]
    return sides.select("doc_id", "item_id", "doc_words", "item_words", "diagonals").mapInArrow(
        verify, "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_matched int").distinct()
