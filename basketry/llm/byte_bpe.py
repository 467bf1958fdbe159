"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

``fold_column`` is the fold as a Spark expression: higher-order functions join
the adjacent pair with the lowest rank until no pair has one, looking ranks up
in a literal table.  ``encode_documents`` counts the distinct words of the
whole corpus, folds the ``WORDS`` most frequent by that expression and
broadcasts their ids: a bounded dictionary that covers nearly all occurrences.
The tail, and words of more than ``LONG`` bytes, for which the expression takes
quadratic time, are folded by the same ranks inside the Arrow batches that
encode the documents (``Merges``); README gives the figures behind the split.
Decoding concatenates the byte pieces of the ids.

A null text is the empty text, which has no ids; tables without words have an
empty dictionary.  Unpaired surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import partitions, ship, written
from basketry.llm.pieces import PieceCodes, splitter

WORDS = 1 << 16  # words of the dictionary
LONG = 64  # bytes of its longest word
HELD = 300_000  # parts counted together in a task
STEPS = 16  # of the histogram of counts, a doubling
_CODECS: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte piece -> rank of a vocabulary file with a base64 piece and a rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of lowest rank (leftmost of equals) until none has a rank, with a heap."""
    import heapq
    n = len(word)
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i:j + size[j]])) is not None:
            heap.append((r, i, size[i], size[j])) if not started else heapq.heappush(heap, (r, i, size[i], size[j]))

    started = False
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    started = True
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if size[i] != a or j >= n or size[j] != b:
            continue  # one of the two has been merged since
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:i + size[i]]])
        i = after[i]
    return out


class Merges:
    """Ranked merges over many words at once.

    Each row of a matrix holds the piece ids of one word.  A step joins, in
    every row that still has a ranked pair, the leftmost pair of lowest rank;
    as a piece's rank is its id, the pair table gives the joined piece too.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted(((ranks[p[:i]] << 32) | ranks[p[i:]], r) for p, r in ranks.items()
                       for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks)
        self.keys = np.array([k for k, _ in pairs] + [2**63 - 1], np.int64)
        self.values = np.array([r for _, r in pairs] + [0], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], self.NONE)

    def fold_equal(self, raw: list[bytes]) -> list[bytes]:
        """Codes of words of at most the first word's length, sorted by length, longest first."""
        n, width = len(raw), len(raw[0])
        size = np.array([len(w) for w in raw])
        ids = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        pair = self.rank(ids[:, :-1], ids[:, 1:])
        rows, column = np.arange(n), np.arange(width)
        a, p = ids, pair
        while len(rows):
            best = p.argmin(1)
            value = p[np.arange(len(p)), best]
            go = value < self.NONE
            if not go.all():
                done = ~go
                ids[rows[done]] = a[done]
                rows, a, p, best, value = rows[go], a[go], p[go], best[go], value[go]
                if not len(rows):
                    break
            i = np.arange(len(rows))
            moved = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > best[:, None]), width)
            a = np.take_along_axis(a, moved, 1)
            a[i, best] = value
            p = np.take_along_axis(p, np.minimum(column + (column > best[:, None]), width - 1), 1)
            p[:, -1] = self.NONE
            p[i, best] = self.rank(value, a[i, best + 1])
            left = np.nonzero(best)[0]
            p[left, best[left] - 1] = self.rank(a[left, best[left] - 1], value[left])
        flat, count = ids[ids >= 0].astype("<u4").tobytes(), (ids >= 0).sum(1)
        ends = (np.cumsum(count) * 4).tolist()
        return [flat[e - 4 * c:e] for e, c in zip(ends, count.tolist())]

    def __call__(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        out: list[bytes] = [b""] * len(raw)
        a = 0
        while a < len(order) and len(raw[order[a]]) > 64:
            out[order[a]] = np.array(fold_long(raw[order[a]], self.ranks), "<u4").tobytes()
            a += 1
        while a < len(order):
            part = order[a:a + 4096]
            a += len(part)
            for i, code in zip(part, self.fold_equal([raw[i] for i in part])):
                out[i] = code
        return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, dictionary: bytes):
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.decimals = [b"%d," % i for i in range(len(self.pieces))]
        self.encode = PieceCodes(splitter(pattern), Merges(ranks))
        self.encode.seen.update(codes_of(dictionary) if dictionary else {})


def codec(key: str, ranks: dict[bytes, int], pattern: str, dictionary: bytes) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern, dictionary)
    return _CODECS[key]


def frequent_words(docs: DataFrame, pattern: str, limit: int) -> DataFrame:
    """``word``: the ``limit`` most frequent matches of the pattern of at most ``LONG`` bytes, of all documents.

    Counts are summed per task before the shuffle, so a word of any frequency
    is one row of each task.  Parts of a text between single spaces are counted
    first and matched once.  The least count that still goes in follows from a
    histogram of the counts (``STEPS`` steps a doubling); of the words in its
    last step those of least hash go in, drawn by a bound of the hash that lets
    little more than ``limit`` through, so no task gets more rows at more input.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = splitter(pattern), Counter()

        def found() -> pa.RecordBatch:
            total: Counter = Counter()
            for part, n in parts.items():
                for word in words(" " + part):
                    total[word] += n
            parts.clear()
            short = [(w, n) for w, n in total.items() if len(w) <= LONG and len(w.encode()) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for text in batch.slice(a, 256).column(0).to_pylist():
                    if text:
                        parts.update(text.split(" "))
                if len(parts) >= HELD:
                    yield found()
        yield found()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    totals = written(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    sizes = {r["step"]: r["count"] for r in totals.groupBy(step.alias("step")).count().collect()}  # bounded: STEPS rows a doubling
    room = limit
    for last in sorted(sizes, reverse=True):
        if sizes[last] > room:
            drawn = (room + 8 * room ** 0.5 + 64) / sizes[last]
            place = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
            tied = totals.filter((step == last) & (place < int(min(1.0, drawn) * (1 << 30)))).orderBy(place, "word").limit(room)
            return totals.filter(step > last).select("word").unionAll(tied.select("word"))
        room -= sizes[last]
    return totals.select("word")


def dictionary_of(words: DataFrame, ranks: dict[bytes, int]) -> bytes:
    """``word, ids`` of a bounded number of words, folded by ``fold_column``, as an Arrow stream."""
    spread = words.repartition(partitions(words.sparkSession), "word")
    table = spread.select("word", fold_column(F.col("word").cast("binary"), ranks).alias("ids")).toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def codes_of(dictionary: bytes) -> dict[str, bytes]:
    """Word -> code of such a stream."""
    with pa.ipc.open_stream(dictionary) as reader:
        return {w: np.array(ids, "<u4").tobytes() for batch in reader for w, ids in zip(*(c.to_pylist() for c in batch.columns))}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False, decode: bool = True,
                     words: int = WORDS) -> DataFrame:
    """Encode the text of every document and decode its ids.

    Returns doc_id, n_tokens and either ``ids`` (array<int>) and, unless
    ``decode`` is off, ``decoded`` (binary), or with ``digests`` their SHA-256 in lowercase hex: ids_sha256 of
    the decimal ids joined by commas, decoded_sha256 of the decoded bytes.
    Counting and folding the ``words`` dictionary entries runs when the query is built.
    """
    ship(docs.sparkSession)
    dictionary = dictionary_of(frequent_words(docs, pattern, words), ranks) if words else b""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, dictionary))  # bounded: a vocabulary file, ``words`` entries
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(key, shared.value[0], pattern, shared.value[1])
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                codes = own.encode([t or "" for t in part.column(1).to_pylist()])
                arrays = [np.frombuffer(c, "<u4") for c in codes]
                n = np.array([len(x) for x in arrays], np.int64)
                lists = [x.tolist() for x in arrays] if decode or digests else []
                decoded = [b"".join(map(own.pieces.__getitem__, x)) for x in lists] if decode else []
                if digests:
                    decimal = (b"".join(map(own.decimals.__getitem__, x))[:-1] for x in lists)
                    outputs = [pa.array([hashlib.sha256(x).hexdigest() for x in decimal], pa.string()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                else:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    flat = np.concatenate([np.empty(0, "<u4"), *arrays]).astype(np.int32)
                    outputs = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))] + ([pa.array(decoded, pa.binary())] if decode else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *outputs], names)

    last = ["ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded binary"][:1 + decode]
    schema = ", ".join(["doc_id long", "n_tokens long", *last])
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------ Spark expression
def rank_table(ranks: dict[bytes, int], buckets: int = 1 << 14) -> list[dict[bytes, int]]:
    """The rank map in buckets by CRC-32, since a literal map is searched entry by entry."""
    import zlib
    table: list[dict[bytes, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        table[zlib.crc32(piece) % buckets][piece] = rank
    return table


def fold_column(word: Column, ranks: dict[bytes, int], buckets: int = 1 << 14) -> Column:
    """Ids of a binary column's value, by higher-order functions over a literal rank table."""
    literal = F.from_json(F.lit(_json(rank_table(ranks, buckets))), "array<map<string,int>>")
    # an array of one value binds the table: a plan that repeats the literal takes the driver's memory
    return F.get(F.transform(F.array(literal), lambda table: _fold(word, table, buckets)), 0)


def _fold(word: Column, table: Column, buckets: int) -> Column:
    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(table, (F.crc32(piece) % buckets + 1).cast("int")), F.hex(piece))

    def join_lowest(state: Column, _: Column) -> Column:
        pairs = F.transform(state, lambda x, i: F.struct(x["pair"].alias("pair"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["pair"].isNotNull()))
        # an array of one value binds it, so that it is computed once
        return F.get(F.transform(F.array(best), lambda b: F.when(b.isNull(), state).otherwise(joined(state, b))), 0)

    def joined(state: Column, best: Column) -> Column:
        i = best["i"]
        piece = F.concat(F.get(state, i)["piece"], F.get(state, i + 1)["piece"])
        after = F.get(state, i + 2)["piece"]
        moved = F.transform(state, lambda x, j: (
            F.when(j == i, entry(piece, best["pair"], rank(F.concat(piece, after))))
            .when(j == i - 1, entry(x["piece"], x["id"], rank(F.concat(x["piece"], piece))))
            .when(j != i + 1, x)))
        return F.filter(moved, lambda x: x.isNotNull())

    def entry(piece: Column, own: Column, pair: Column) -> Column:
        return F.struct(piece.alias("piece"), own.alias("id"), pair.alias("pair"))

    n = F.octet_length(word)
    none = F.array().cast("array<int>")
    single = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none), lambda i: entry(
        F.substring(word, i, F.lit(1)), rank(F.substring(word, i, F.lit(1))), F.when(i < n, rank(F.substring(word, i, F.lit(2))))))
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(none)
    return F.transform(F.aggregate(steps, single, join_lowest), lambda x: x["id"])


def _json(table: list[dict[bytes, int]]) -> str:
    import json
    return json.dumps([{piece.hex().upper(): rank for piece, rank in bucket.items()} for bucket in table])
