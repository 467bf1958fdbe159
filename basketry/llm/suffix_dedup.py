"""Removal of repeated byte strings, exact, by suffix arrays of shards.

A text loses every byte covered by a ``length``-byte string (400 by default)
that starts anywhere else, in the same text included.

1. Every position where such a string can start is owned by an anchor: the
   64-byte gram with the least hash among those inside the string (the leftmost
   of equals).  Equal strings have equal anchors, so only windows (an anchor's
   run of consecutive starts with their bytes) of the same anchor can share
   strings.  Counts per anchor are combined map-side; windows of anchors seen
   once go no further.
2. Windows with equal bytes form a class.  If it has two members or more, all
   its strings repeat.  A third of all rows being copies of one text makes a
   few classes, not large groups; equal windows of one text are one row.
3. Anchors with several classes need a closer look: one window per class goes
   to a shard, chosen by the anchor.  A shard orders its suffixes by
   Larsson-Sadakane refinement, finds common prefixes by Kasai's method, and
   marks the starts that share ``length`` bytes.
4. An anchor with more classes than ``CLASSES`` (a line that very many texts
   hold) is told apart by what stands around it: its starts are cut into runs
   by their distance to the anchor, and all strings of a run contain the same
   stretch, relative to the anchor, of nearly ``length`` bytes.  Equal strings
   have equal stretches, so the stretch takes the anchor's place, and windows
   whose stretch occurs once go no further (``LEVELS``: finer and finer runs).
   What is left with more classes is dealt over several shards, and every two
   of them are merged by binary search.

``without_repeats`` also takes out passages of ``words`` words or more that
start anywhere else: the same windows over the texts' word hashes (words as in
``WordHasher``: lower case, no punctuation at the ends), with 8-word anchors.
Shards order and compare these by the same suffix arrays, a 64-bit hash a word.
A passage goes from the first byte of its first word to the last byte of its
last, punctuation at the words included; the white space around it stays.
``remove_repeats`` with ``words`` only tells such passages.  Byte strings and
passages share one exchange of the texts that the shards take windows from.

Null texts count as empty and keep nothing; texts shorter than ``length`` stay
whole; very long texts are cut into windows like the others, one text at a time
in a task; equal rows are copies of each other, so both lose what they share;
rows without a doc_id are treated like the others; an empty table gives an empty
result; further columns of ``docs`` are neither read nor in the way.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import MIX, WordHasher, mix64, partitions, ship, written
from basketry.llm.suffix_arrays import found_in, repeated_starts, suffix_array

GRAM = 64  # bytes of an anchor
WORD_GRAM = 8  # words of an anchor
WORD_BYTES = 8  # of a word's hash
CLASSES = 2048  # window classes of one anchor in a shard
SHARD_BYTES = 512 << 10  # a task's arrays take up to 60 times as much
LEVELS = (4, 16)  # runs of starts as parts of a string's length, for anchors of very many classes
WINDOW_SCHEMA = "row_key binary, anchor long, digest binary, first int, starts int, more array<int>"
PIECE_SCHEMA = "anchor long, digest binary, copies long, row_key binary, first int, starts int, bytes binary"
RANGE_SCHEMA = "row_key binary, first int, last int, more array<int>"
TOKEN = re.compile(r"\S+")
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * MIX)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (or WORD_GRAM word hashes) from each position that has so many."""
    h, width, gram = (_BYTES[data], 1, GRAM) if data.dtype == np.uint8 else (mix64(data), 1, WORD_GRAM)
    while width < gram:
        h = h[:-width] * (MIX + np.uint64(2 * width)) + h[width:]
        width *= 2
    return mix64(h)


def windows_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, and anchor hash of every window of a text."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(data)
    bits = np.uint64(max(1, len(hashes).bit_length()))
    # high bits of the hash, then the position: the least key is the leftmost gram of least hash
    key = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - (GRAM if data.dtype == np.uint8 else WORD_GRAM) + 1, 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:n], least[span - width:span - width + n])
    at = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    return first, np.diff(np.concatenate([first, [n]])), hashes[at[first]]


NAMES = ["anchor", "digest", "copies", "row_key", "first", "starts", "bytes", "gram"]
KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text without nulls, and row_key (128 bits of both)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"),
                       F.unhex(F.md5(F.concat(name, F.lit("\n"), body))).alias("row_key"))


def _windows(docs: DataFrame, length: int, by_word: bool) -> DataFrame:
    unit = WORD_BYTES if by_word else 1
    least = 2 * length - 1 if by_word else length  # bytes of so many words, or of so many bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        hasher = WordHasher()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, anchors, digests, firsts, counts, more = [], [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = hasher(text) if by_word else np.frombuffer(text.encode(), np.uint8)
                    first, count, anchor = windows_of(data, length)
                    view = memoryview(data.tobytes())
                    own = [xxhash.xxh3_128_digest(view[s * unit:(s + c + length - 1) * unit]) for s, c in zip(first.tolist(), count.tolist())]
                    others = [None] * len(own)
                    if len(set(own)) < len(own):
                        place, kept = {}, []
                        for i, digest in enumerate(own):
                            at = place.setdefault(digest, i)
                            if at == i:
                                kept.append(i)
                            elif others[at]:
                                others[at].append(int(first[i]))
                            else:
                                others[at] = [int(first[i])]
                        first, count, anchor = first[kept], count[kept], anchor[kept]
                        own, others = [own[i] for i in kept], [others[i] for i in kept]
                    keys += [key] * len(first)
                    anchors.append(anchor)
                    firsts.append(first)
                    counts.append(count)
                    digests += own
                    more += others
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(np.concatenate(anchors).view(np.int64)), pa.array(digests, pa.binary()),
                         pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32)),
                         pa.array(more, pa.list_(pa.int32()))], ["row_key", "anchor", "digest", "first", "starts", "more"])

    return docs.filter(F.octet_length("text") >= least).select("row_key", "text").mapInArrow(run, WINDOW_SCHEMA)


def _unit_marks(rows: list[dict], left: int, right: int, length: int, by_word: bool) -> list[np.ndarray]:
    """For each window of a unit, which of its starts repeat."""
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint64 if by_word else np.uint8)
    sizes = np.array([len(r["bytes"]) for r in rows]) // data.itemsize
    begin = np.cumsum(sizes) - sizes
    counts = np.array([r["starts"] for r in rows])
    if left == right:
        marks = repeated_starts(data, begin, counts, length)
    else:
        part = np.array([r["part"] for r in rows])
        marks, orders = np.zeros(len(data), bool), []
        for side in (left, right):
            mine = np.nonzero(part == side)[0]
            valid = np.zeros(len(data), bool)
            for w in mine.tolist():
                valid[begin[w]:begin[w] + counts[w]] = True
            where = np.concatenate([np.arange(begin[w], begin[w] + sizes[w]) for w in mine]) if len(mine) else np.empty(0, np.int64)
            sa = where[suffix_array(data[where], length)]
            orders.append(sa[valid[sa]])
        for hit in found_in(data, *orders, length):
            marks[hit] = True
    return [marks[b:b + c] for b, c in zip(begin.tolist(), counts.tolist())]


def runs_around(data: np.ndarray, anchor: int, starts: int, length: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(run, first start, starts, first and last unit of its stretch) of a window, by the distance of its starts to the anchor."""
    hashes = gram_hashes(data)[starts - 1:]
    at = starts - 1 + int(np.argmax(hashes == np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)))
    for run in range((at - starts + 1) // width, at // width + 1):
        a, b = max(0, at - (run + 1) * width + 1), min(starts - 1, at - run * width)
        yield run, a, b - a + 1, at - run * width, at - (run + 1) * width + 1 + length


def _pieces(classes: DataFrame, length: int, width: int, by_word: bool) -> DataFrame:
    """The windows of ``classes`` cut into runs of starts; each run's anchor is the stretch that all its strings contain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(a, 512).to_pylist():
                    data = np.frombuffer(r["bytes"], np.uint64 if by_word else np.uint8)
                    unit, raw = data.itemsize, memoryview(r["bytes"])
                    for k, s, count, begin, end in runs_around(data, r["gram"], r["starts"], length, width):
                        mine = bytes(raw[s * unit:(s + count - 1 + length) * unit])
                        stretch = xxhash.xxh3_64_intdigest(raw[begin * unit:end * unit], seed=k)
                        out.append((stretch - (1 << 63), xxhash.xxh3_128_digest(mine), r["copies"], r["row_key"], r["first"] + s, count, mine, r["gram"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), KINDS)], NAMES)

    return classes.select("row_key", "gram", "copies", "first", "starts", "bytes").mapInArrow(run, PIECE_SCHEMA + ", gram long")


def _cut(rows: DataFrame, lengths: dict[bool, int]) -> DataFrame:
    """row_key and the windows of each row, with their bytes or word hashes."""
    kind = dict(rows.dtypes)["windows"].removeprefix("array<struct<").removesuffix(">>").replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, cuts, at = batch.slice(a, 512), [], 0
                lists = part.column("windows")
                windows, sizes = lists.flatten(), lists.value_lengths().to_numpy()
                found = list(zip(*(windows.field(c).to_pylist() for c in ("by_word", "first", "starts"))))
                for text, size in zip(part.column("text").to_pylist(), sizes.tolist()):
                    mine, at = found[at:at + size], at + size
                    units = {w: hasher(text).tobytes() if w else text.encode() for w in {w for w, _, _ in mine}}
                    for w, first, starts in mine:
                        unit = WORD_BYTES if w else 1
                        cuts.append(units[w][first * unit:(first + starts + lengths[w] - 1) * unit])
                keys = part.column("row_key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([keys, *windows.flatten(), pa.array(cuts, pa.binary())],
                                                 ["row_key", *(f.name for f in windows.type), "bytes"])

    return rows.mapInArrow(run, f"row_key binary, {kind}, bytes binary")


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held, key = [], None
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            for row in batch.slice(a, 1024).to_pylist():
                own = (row["group"], row["left"], row["right"])
                if own != key and held:
                    yield held
                    held = []
                key = own
                held.append(row)
    if held:
        yield held


def repeated_ranges(docs: DataFrame, lengths: dict[bool, int], classes: int = CLASSES, shard_bytes: int = SHARD_BYTES,
                    levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """row_key, by_word and ranges ``[first, last)`` of starts whose strings repeat, ``more``: the first starts of other ranges of the same size.

    ``docs`` as ``_keyed`` gives them.  ``lengths``: of the strings, by whether they and the ranges count words.
    """
    ship(docs.sparkSession)
    found = {by_word: _classes(docs, length, by_word) for by_word, length in lengths.items()}
    several = reduce(DataFrame.unionByName, (one.withColumn("by_word", F.lit(by_word)) for by_word, (_, one) in found.items()))
    of_text = several.groupBy("row_key").agg(
        F.collect_list(F.struct("by_word", "anchor", "digest", "copies", "classes", "first", "starts")).alias("windows"))
    # one exchange of the texts for all lengths; equal rows are cut once
    joined = docs.select("row_key", "text").join(of_text, "row_key").dropDuplicates(["row_key"])
    cut = written(_cut(joined, lengths), "close-windows")
    parts = []
    for by_word, (ranges, _) in found.items():
        mine = cut.filter(F.col("by_word") == by_word).drop("by_word").withColumn("gram", F.col("anchor"))
        close = _close_ranges(mine, lengths[by_word], classes, shard_bytes, by_word, levels)
        parts.append(ranges.unionByName(close).withColumn("by_word", F.lit(by_word)))
    return reduce(DataFrame.unionByName, parts)


def _classes(docs: DataFrame, length: int, by_word: bool) -> tuple[DataFrame, DataFrame]:
    """Ranges of the windows that have equals, and one window per class of the anchors with several classes."""
    windows = written(_windows(docs, length, by_word), "windows")
    members = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    again = windows.groupBy("anchor").agg(F.sum(members).alias("seen")).filter("seen > 1").select("anchor")
    shared = written(windows.join(again, "anchor", "left_semi"), "shared-windows")

    by_class = written(shared.groupBy("anchor", "digest").agg(F.sum(members).alias("copies"), F.min(F.struct("row_key", "first", "starts")).alias("at"))
                       .select("anchor", "digest", "copies", "at.*"), "window-classes")
    ranges = (shared.join(by_class.filter("copies > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
              .select("row_key", "first", (F.col("first") + F.col("starts")).alias("last"), "more"))
    return ranges, by_class.join(_several(by_class), "anchor")


def _close_ranges(cut: DataFrame, length: int, classes: int, shard_bytes: int, by_word: bool, levels: tuple[int, ...]) -> DataFrame:
    """Ranges of starts whose strings repeat between the classes of an anchor; ``cut``: one window per class, with its bytes."""
    spark = cut.sparkSession
    columns = ["anchor", "digest", "copies", "classes", "row_key", "first", "starts", "bytes"]
    close, ranges = cut.select(*columns), []
    for level in levels:
        hot = cut.filter(F.col("classes") > classes)
        if hot.isEmpty():
            break
        pieces = written(_pieces(hot, length, max(1, length // level), by_word), "pieces")
        alike = pieces.groupBy("anchor", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("row_key", "first", "starts", "bytes", "gram")).alias("at"))
        alike = written(alike.select("anchor", "digest", "copies", "at.*"), "piece-classes")
        found = (pieces.filter("copies = 1").join(alike.filter("copies > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
                 .select("row_key", "first", (F.col("first") + F.col("starts")).alias("last"), F.lit(None).cast("array<int>").alias("more")))
        ranges.append(found)
        close = close.filter(F.col("classes") <= classes)
        cut = written(alike.join(_several(alike), "anchor"), "close-pieces")
        close = close.unionByName(cut.select(*columns))

    total = close.agg(F.sum(F.octet_length("bytes"))).collect()[0][0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    parts = F.ceil(F.col("classes") / classes).cast("int")
    dealt = (close.withColumn("parts", parts)
             .withColumn("group", F.when(F.col("parts") > 1, F.concat(F.lit("a"), F.col("anchor").cast("string")))
                         .otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("string"))))
             .withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
             .select("group", "left", "right", "part", "row_key", "copies", "first", "starts", "bytes")
             .repartition(partitions(spark), "group", "left", "right").sortWithinPartitions("group", "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units(batches):
            found = [(r["row_key"], r["first"] + a, r["first"] + b)
                     for r, marks in zip(rows, _unit_marks(rows, rows[0]["left"], rows[0]["right"], length, by_word)) if r["copies"] == 1
                     for a, b in _runs(marks)]
            if found:
                keys, a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.nulls(len(a), pa.list_(pa.int32()))],
                                                 ["row_key", "first", "last", "more"])

    return reduce(DataFrame.unionByName, ranges, dealt.mapInArrow(run, RANGE_SCHEMA))


def _several(classes: DataFrame) -> DataFrame:
    """anchor and classes, of the anchors that have several."""
    return classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")


def covered(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the strings that start in the ranges."""
    return merged([(a, a + r["last"] - r["first"] - 1 + length) for r in ranges or () for a in (r["first"], *(r["more"] or ()))])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_bytes(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte runs of runs of words; words are counted as ``WordHasher`` does."""
    places = [m.span() for m in TOKEN.finditer(text) if any(map(str.isalnum, m.group().lower()))]
    out, at, chars = [], 0, 0
    for a, b in runs:
        edges = []
        for edge in (places[a][0], places[b - 1][1]):
            at, chars = at + len(text[chars:edge].encode()), edge
            edges.append(at)
        out.append(tuple(edges))
    return out


def _apply(docs: DataFrame, length: int, classes: int, columns: list[str], describe, words: int | None = None,
           levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``columns`` of every row of ``docs`` and what ``describe(text, spans, passages)`` says of its bytes."""
    keyed = _keyed(docs)
    repeated = repeated_ranges(keyed, {False: length, True: words} if words else {False: length}, classes, levels=levels)
    ranges = written(repeated, "ranges").groupBy("row_key").agg(
        F.collect_set(F.struct("first", "last", "more", "by_word")).alias("ranges"))  # bounded: bytes of a document
    others = [c for c in columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *others)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("text", body).withColumn("row_key", F.unhex(F.md5(F.concat(name, F.lit("\n"), F.col("text")))))
    joined = rows.join(ranges, "row_key", "left").select("doc_id", "text", *others, "ranges")
    kinds = dict(joined.dtypes)
    passed = ["doc_id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, said = batch.slice(start, 512), []
                for text, found in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    spans = covered([r for r in found or () if not r["by_word"]], length)
                    passages = covered([r for r in found or () if r["by_word"]], words or 0)
                    said.append(describe(text, spans, passages))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in passed] + [pa.array(x) for x in zip(*said)], [*passed, *describe.names])

    return joined.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in passed] + describe.kinds))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _figures(text: str, spans: list[tuple[int, int]], passages: list[tuple[int, int]]):
    raw = text.encode()
    kept = _kept(raw, spans)
    return len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def _remaining(text: str, spans: list[tuple[int, int]], passages: list[tuple[int, int]]):
    spans = merged(spans + word_bytes(text, passages)) if passages else spans
    return (_kept(text.encode(), spans).decode("utf-8", "ignore"),)


def _both(text: str, spans: list[tuple[int, int]], passages: list[tuple[int, int]]):
    return *_figures(text, spans, passages), *_remaining(text, spans, [])


def _all(text: str, spans: list[tuple[int, int]], passages: list[tuple[int, int]]):
    return *_both(text, spans, passages), len(passages), sum(b - a for a, b in passages)


_figures.names, _figures.kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
_remaining.names, _remaining.kinds = ["text"], ["text string"]
_both.names, _both.kinds = _figures.names + _remaining.names, _figures.kinds + _remaining.kinds
_all.names, _all.kinds = [*_both.names, "n_passages", "passage_words"], [*_both.kinds, "n_passages long", "passage_words long"]


def remove_repeats(docs: DataFrame, length: int = 400, classes: int = CLASSES, with_text: bool = False,
                   levels: tuple[int, ...] = LEVELS, words: int | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes, concatenated).

    ``with_text`` adds text: what remains, without characters that lost a part of their bytes.
    ``words`` adds text and, of the passages of so many words or more that start anywhere else, n_passages (maximal runs in the
    whole text) and passage_words (words in them); these are told, not removed.
    """
    return _apply(docs, length, classes, ["doc_id"], _all if words else _both if with_text else _figures, words, levels)


def without_repeats(docs: DataFrame, length: int = 400, classes: int = CLASSES, words: int | None = None,
                    levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``docs`` with their remaining texts; characters that lost a part of their bytes go too.

    ``words``: passages of so many words or more that repeat go too, however few bytes they have.
    """
    return _apply(docs, length, classes, docs.columns, _remaining, words, levels).select(*docs.columns)
