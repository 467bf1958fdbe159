"""Collocations from FM-indexes over word ids.

Texts are lower-cased (A-Z) and split into pieces and words; a *shard* is what
one task has read of one language, up to ``SHARD_WORDS`` words.  Its words
become small ids (0 for piece ends and for words below the least count, which
are in no candidate), and two indexes are kept: the Burrows-Wheeler transform
of the ids, and that of the ids reversed, both for suffixes ordered by their
first five ids (a phrase has no more).

A phrase is a pair of intervals, its rows in either index.  The transform's
ids within one interval are the words that extend the phrase to the left, in
the other one those to the right, with their counts; the extension's own
interval is one LF step away in that index, and in the other it starts as many
rows later as smaller ids stand in the interval.  All phrases of a shard are
extended at once, by one sort of the ids in their intervals.

Phrases go up a length at a time, to the right and to the left in turn.  A
pass extends the phrases that occur often enough in the whole corpus and hands
on 64-bit codes and counts of the extensions whose other part does so too; the
shards' counts are added up by code.  Codes that reach the least count are
told to the shards by a bit table of fixed size (``BITS`` bits), and the next
pass hands on the words of those phrases as well, whose counts are added up
once more.  A phrase that a code or a bit lets pass wrongly falls out there,
so results are exact at any size.

Scores use exact decimals.  Rows without a language are ``und``, null and empty
texts have no words, texts of any length count whole, repeated rows count as
often as they stand there, ties follow the phrase's UTF-8 bytes, an empty table
gives an empty result, and further columns are ignored.  Two words with the
same 64-bit hash would be taken for one: their counts are checked and another
seed is used if there are any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import mix64, ship, written

MOST_WORDS = 5
SHARD_WORDS = 1 << 21
BITS = 26  # of the table of frequent phrases: 8 MB
FOLDED = 400_000  # distinct words that a task holds before it hands on their counts
# Fixed values of the contract: A-Z to lower case, tab as space, the ends of pieces.
PIECE_ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"  # no byte of UTF-8 text
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + MARK * len(PIECE_ENDS))


def tokens(text: str | None) -> list[bytes]:
    """Words, with MARK at the ends of pieces and of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    return [w for w in raw.replace(MARK, b" " + MARK + b" ").split(b" ") if w] + [MARK]


def word_hash(word: bytes, seed: int) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word, seed)


def chain(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of phrases lengthened by a word to the right; a language's own code stands for no words."""
    return mix64(codes * np.uint64(0x9E3779B97F4A7C15) + words)


def lang_code(lang: str) -> np.uint64:
    import xxhash
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def holds(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    place = codes >> np.uint64(64 - BITS)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


# ------------------------------------------------------------------ index of a shard
def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def transform(ids: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of ids (closed by a 0) whose suffixes are ordered by their first five ids."""
    n, width = len(ids), int(ids.max(initial=0)) + 1

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])[:n]

    two = dense(ids * width + ahead(ids, 1))
    four = dense(two * (int(two.max(initial=0)) + 1) + ahead(two, 2))
    order = np.argsort(four * width + ahead(ids, 4), kind="stable")
    return ids[order - 1]  # the id before each suffix; before the first stands the last, a 0


class Index:
    """Transform of one direction, with LF steps."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.argsort(bwt, kind="stable")
        self.step = np.empty(len(bwt), np.int64)
        self.step[order] = np.arange(len(bwt))


def extend(index: Index, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every extension by one id of the phrases with rows [low, high) here and from ``other`` on in the opposite index.

    Returns owner (which phrase), id, count, low here, low in the opposite index.
    """
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    rows = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
    ids = index.bwt[rows].astype(np.int64)
    width = int(ids.max(initial=0)) + 1
    order = np.argsort(owner * width + ids, kind="stable")
    key = (owner * width + ids)[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    of, word = np.divmod(key[first], width)
    smaller = first - (np.cumsum(sizes) - sizes)[of]  # ids of the interval that sort before this one
    live = word > 0
    return of[live], word[live], count[live], index.step[rows[order[first]]][live], (other[of] + smaller)[live]


def enumerate_phrases(forward: np.ndarray, backward: np.ndarray, vocabulary: np.ndarray, lang: str, length: int, tables: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For every number of words up to ``length``: the phrases whose two parts one word shorter may be frequent.

    Yields the number, word ids (a row each), counts and codes; where
    ``tables`` reaches that number, only phrases that may be frequent.

    ``forward`` and ``backward`` are the transforms of the ids and of the ids
    reversed; ``tables[k - 1]`` tells which phrases of k words may be frequent.
    """
    ahead, back, start = Index(forward), Index(backward), lang_code(lang)

    def code(words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), start)
        for k in range(words.shape[1]):
            out = chain(out, vocabulary[words[:, k]])
        return out

    # single words: their rows are the same in both indexes
    count = np.bincount(forward, minlength=len(vocabulary))[1:]
    words = np.nonzero(count)[0][:, None] + 1
    low = (np.cumsum(count) - count + np.count_nonzero(forward == 0))[words[:, 0] - 1]
    count, other = count[words[:, 0] - 1], low
    for k in range(1, length + 1):
        codes = code(words)
        if k <= len(tables):
            keep = holds(tables[k - 1], codes)
            words, count, low, other, codes = words[keep], count[keep], low[keep], other[keep], codes[keep]
        yield k, words, count, codes
        if k == length:
            return
        if k % 2:  # to the right: the index of the reversed ids
            of, word, new_count, new_other, new_low = extend(back, other, other + count, low)
            words = np.concatenate([words[of], word[:, None]], 1)
            part = words[:, 1:]
        else:  # to the left
            of, word, new_count, new_low, new_other = extend(ahead, low, low + count, other)
            words = np.concatenate([word[:, None], words[of]], 1)
            part = words[:, :-1]
        keep = holds(tables[k - 1], code(part))
        words, count, low, other = words[keep], new_count[keep], new_low[keep], new_other[keep]


# ------------------------------------------------------------------ passes over the corpus
def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of every word."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        found: dict[str, Counter] = {}

        def hand_on():
            for lang, counts in found.items():
                counts.pop(MARK, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                                 ["lang", "word", "f"])
            found.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    found.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, found.values())) > FOLDED:
                    yield from hand_on()
        yield from hand_on()

    return _rows(docs).mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def hashed(words: DataFrame, seed: int) -> DataFrame:
    """``words`` with the key (8 bytes) and the code of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([word_hash(w, seed) for w in batch.column("word").to_pylist()], np.uint64)
            codes = chain(np.array([lang_code(x) for x in batch.column("lang").to_pylist()], np.uint64), hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array(codes.view(np.int64))],
                                             [*batch.schema.names, "key", "code"])
    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word binary, f long, key binary, code long")


def bit_table(codes: DataFrame) -> np.ndarray:
    """Bits of ``codes (code)``; 2**BITS bits, however many there are."""
    places = codes.select(F.shiftrightunsigned("code", 64 - BITS).alias("place"))
    maps = places.groupBy(F.shiftright("place", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    table = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for batch in maps.toArrow().to_batches():  # bounded: 2**(BITS - 15) pages of 4 KB
        for page, bits in zip(*(c.to_pylist() for c in batch.columns)):
            table[page] = np.frombuffer(bits, np.uint8)
    return table.reshape(-1)


SHARD = "lang string, vocabulary binary, forward binary, backward binary"


def shards(docs: DataFrame, frequent_words: np.ndarray, seed: int, size: int = SHARD_WORDS) -> DataFrame:
    """The index of every shard: lang, vocabulary (hash of each id's word), transforms of the ids and of the ids reversed."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words)  # bounded: 2**BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {MARK: 0}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def hash_of(word: bytes) -> int:
            if len(known) > FOLDED:
                known.clear()
                known[MARK] = 0
            value = known[word] = word_hash(word, seed) or 1
            return value

        def built(lang: str) -> pa.RecordBatch:
            hashes = np.concatenate(held.pop(lang))
            del sizes[lang]
            codes = chain(np.full(len(hashes), lang_code(lang)), hashes)
            hashes = np.where((hashes != 0) & holds(table, codes), hashes, np.uint64(0))
            hashes = hashes[np.concatenate([[True], (hashes[1:] != 0) | (hashes[:-1] != 0)])]  # runs of ends are one
            vocabulary = np.unique(np.concatenate([[np.uint64(0)], hashes]))
            ids = np.searchsorted(vocabulary, hashes).astype(np.int64)
            kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
            forward = transform(np.concatenate([[0], ids, [0]]))
            backward = transform(np.concatenate([[0], ids[::-1], [0]]))
            return pa.RecordBatch.from_pylist([{"lang": lang, "vocabulary": vocabulary.tobytes(), "forward": forward.astype(kind).tobytes(), "backward": backward.astype(kind).tobytes()}],
                                              schema=pa.schema([("lang", pa.string()), ("vocabulary", pa.binary()), ("forward", pa.binary()), ("backward", pa.binary())]))

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    words = tokens(text)
                    get = known.get
                    found = np.fromiter([v if (v := get(w)) is not None else hash_of(w) for w in words], np.uint64, len(words))
                    held.setdefault(lang, []).append(found)
                    sizes[lang] = sizes.get(lang, 0) + len(found)
                    if sizes[lang] >= size:
                        yield built(lang)
                if sum(sizes.values()) >= size:  # of many languages: the largest first
                    yield built(max(sizes, key=sizes.get))
        for lang in list(held):
            yield built(lang)

    return _rows(docs).mapInArrow(run, SHARD)


def counted(index: DataFrame, length: int, last: bool, tables: list[np.ndarray], least: int) -> DataFrame:
    """Over all shards: code, f of the phrases of ``length`` words (not for the ``last`` pass); lang, key, f of those a word shorter (from two)."""
    shared = index.sparkSession.sparkContext.broadcast(tables)  # bounded: 2**BITS bits a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["code", "lang", "key", "f"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
                kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
                found = enumerate_phrases(np.frombuffer(row["forward"], kind).astype(np.int64), np.frombuffer(row["backward"], kind).astype(np.int64),
                                          vocabulary, row["lang"], length - last, shared.value)
                for k, words, count, codes in found:
                    for a in range(0, len(words), 100_000) if k == length or k == length - 1 > 1 else ():
                        some = count[a:a + 100_000].astype(np.int64)
                        if k == length:
                            yield pa.RecordBatch.from_arrays([pa.array(codes[a:a + 100_000].view(np.int64)), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.binary()), pa.array(some)], names)
                        else:
                            raw = np.ascontiguousarray(vocabulary[words[a:a + 100_000]])
                            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * k), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
                            lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(raw), np.int32)), pa.array([row["lang"]])).cast(pa.string())
                            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), lang, keys, pa.array(some)], names)

    rows = index.mapInArrow(run, "code long, lang string, key binary, f long")
    return written(rows.groupBy("code", "lang", "key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), f"counted-{length}")


class Phrases:
    """Frequent phrases of one to ``most`` words: ``levels[k - 1]`` has lang, key, words, f, prefixes and suffixes (their counts by length)."""

    def __init__(self, docs: DataFrame, least: int = 100, most: int = MOST_WORDS, size: int = SHARD_WORDS):
        if not 2 <= most <= MOST_WORDS:
            raise ValueError(f"phrases have 2 to {MOST_WORDS} words")
        for seed in range(8):
            words = written(hashed(word_counts(docs), seed), "words")
            if not words.groupBy("key").agg(F.count_distinct("word").alias("k")).filter("k > 1 or key = X'0000000000000000'").head(1):
                break
        else:
            raise RuntimeError("words collide under every seed")
        self.totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        none = F.array().cast("array<bigint>")
        frequent = words.filter(F.col("f") >= least)
        self.levels = [frequent.select("lang", "key", F.array(F.col("word").cast("string")).alias("words"), "f", none.alias("prefixes"), none.alias("suffixes"))]
        tables = [bit_table(frequent)]
        index = written(shards(docs, tables[0], seed, size), "phrase-index", compression="zstd")
        for length in range(2, most + 2):
            found = counted(index, length, length > most, tables, least)
            if length > 2:
                self.levels.append(self._level(found.filter(F.col("code").isNull()), length - 1))
            tables.append(bit_table(found.filter(F.col("code").isNotNull())))

    def _level(self, frequent: DataFrame, length: int) -> DataFrame:
        """Frequent phrases with the words and counts of their parts, from the level below."""
        shorter, cut = self.levels[-1], 8 * (length - 1)
        left = shorter.select("lang", F.col("key").alias("_left"), F.col("words").alias("_words"), F.concat("prefixes", F.array("f")).alias("prefixes"))
        right = shorter.select("lang", F.col("key").alias("_right"), F.element_at("words", -1).alias("_word"), F.concat("suffixes", F.array("f")).alias("suffixes"))
        found = (frequent.withColumn("_left", F.substring("key", 1, cut)).withColumn("_right", F.substring("key", 9, cut))
                 .join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
                 .select("lang", "key", F.concat("_words", F.array("_word")).alias("words"), "f", "prefixes", "suffixes"))
        return written(found, f"phrases-{length}")

    def maximal(self) -> DataFrame:
        """Candidates (two words or more) that no longer candidate holds as often as they occur."""
        out = None
        for k in range(2, len(self.levels) + 1):
            level = self.levels[k - 1]
            if k < len(self.levels):
                longer = self.levels[k]
                # as often as its extension: an extension of more words that occurs as often has one of one word more that does
                held = (longer.filter(F.col("f") == F.element_at("prefixes", -1)).select("lang", F.substring("key", 1, 8 * k).alias("key"))
                        .unionByName(longer.filter(F.col("f") == F.element_at("suffixes", -1)).select("lang", F.substring("key", 9, 8 * k).alias("key"))).distinct())
                level = level.join(held, ["lang", "key"], "left_anti")
            out = level if out is None else out.unionByName(level)
        return out


def collocations(docs: DataFrame, least: int = 100, most: int = MOST_WORDS, top: int = 2000, size: int = SHARD_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases of ``docs (lang, text)``: lang, rank, phrase, a, l, r, n, score.

    n counts the words of the language, a, l and r the occurrences of the
    phrase, of its first words up to the cut and of the rest; score is
    floor(1000 * a * n / (l * r)) at the lowest-scoring cut.
    """
    found = Phrases(docs, least, most, size)
    wide = "decimal(19,0)"
    k = F.size("words")
    cuts = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.struct(
        i.alias("k"), F.element_at("prefixes", i).alias("l"), F.element_at("suffixes", k - i).alias("r")))
    rows = (found.maximal().join(found.totals, "lang").withColumn("cut", F.explode(cuts))
            .select("lang", "words", "key", F.col("f").alias("a"), "n", "cut.k", "cut.l", "cut.r")
            .withColumn("score", F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {wide}) * cast(n as decimal(15,0))) div (cast(l as {wide}) * cast(r as {wide}))")))
    best = rows.groupBy("lang", "key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "words")).alias("b")).select("lang", "b.*")
    best = best.withColumn("phrase", F.array_join("words", " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = best.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
