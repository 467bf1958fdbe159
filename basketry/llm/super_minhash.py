"""Near-duplicate groups by SuperMinHash signatures, bands, exact verification and union-find.

A signature has one value per slot.  Every element deals its random ranks to
the slots by a random permutation of its own, worked out step by step: in step
j it offers j + r (r uniform in [0, 1)) to the j-th slot of its permutation,
and a slot keeps its least offer.  Offers of one element are thus spread over
different slots, which makes the share of equal slots a less varying estimate
of the Jaccard similarity than independent hash functions do.  Once every slot
is filled, later steps cannot change anything and the set is done.

1. Documents with equal shingle sets are one class; only classes go on.
2. Signatures are cut into bands; classes that share a band are candidates.
3. In each of ``rounds`` rounds every class is verified, on the full sets,
   against the one head of another component that it shares most bands with,
   and the components are joined.  A band's head is the class that shares
   bands with most others first, a random one in later rounds.  Large groups
   of near copies collapse here, with a comparison a class and round.
4. Components that still meet in a band are tied to clusters.  Within one, the
   classes of different components are compared in bounded blocks: of the
   pairs that share a band, those whose equal slots are too few for the
   threshold (probability below ``tolerance``) are left out, the others are
   verified on the full sets, unless earlier links of the block join them.
5. The components of all links are the groups, named by their smallest doc_id.

Words are runs without white space (``[^\\x20\\x09-\\x0D]+``) after A-Z became
lower case; an element is a run of ``n`` words, or the whole sequence where
there are fewer.  Sets are exact but for 64-bit hashes of their elements.

Nulls and empty texts, and texts without words, have empty sets and are linked
with nothing.  Rows without a doc_id take no part: their component is null and
they are kept.  Rows of one doc_id are documents of their own if their sets
differ.  Repeated rows and ties of a class fall to its smallest doc_id.  Texts
of any length count whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import mix64, partitions, ship, written
from basketry.llm.components import components

BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
TOLERANCE = 1e-9  # of leaving out a pair at the threshold by its equal slots
BLOCK = 1024  # classes of a cluster in one block
ROUNDS = 2  # of heads, before what is left goes pair by pair
WEIGHT = 1 << 20  # shingles in one block
GROUP = 4096  # classes verified against one copy of their head
WHITE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")  # bytes.split() knows the rest


class ShingleSets:
    """Texts -> sorted distinct 64-bit hashes of their word n-grams."""

    def __init__(self, n: int, limit: int = 300_000):
        self.n, self.limit, self.known = n, limit, {}

    def _word(self, word: bytes) -> int:
        import xxhash
        if len(self.known) >= self.limit:
            self.known.clear()
        value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(WHITE).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        get, learn = self.known.get, self._word
        hashes = np.fromiter([v if (v := get(w)) is not None else learn(w) for w in words], np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)  # the number of words tells short sequences apart
        for i in range(n):
            out = mix64(out + hashes[i:len(words) - n + 1 + i])
        return np.unique(out)


def super_min_hashes(sets: list[np.ndarray], slots: int, seed: int = 13) -> np.ndarray:
    """Signatures (a row of ``slots`` 64-bit values per set) of non-empty sets.

    All elements take a step at a time.  The permutation is a Fisher-Yates
    shuffle: step j takes the slot at a random place of j, ..., slots - 1 and
    puts the slot at place j there, so the slot is found by walking the
    earlier swaps backward.
    """
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = mix64(np.concatenate(sets) ^ np.uint64(seed)) if len(sets) else np.empty(0, np.uint64)
    swaps: list[np.ndarray] = []
    low = np.uint64((1 << 56) - 1)
    for j in range(slots):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        place = (j + ((state >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int16)
        slot = place.copy()
        for t in range(j - 1, -1, -1):
            slot[swaps[t] == slot] = t
        offer = (np.uint64(j) << np.uint64(56)) | (mix64(state) & low)  # j + r, as an integer
        np.minimum.at(signature.reshape(-1), owner * slots + slot, offer)
        swaps.append(place)
        open_ = (signature == np.iinfo(np.uint64).max).any(1)  # a set is done when all its slots are filled
        stay = open_[owner]
        if not stay.any():
            break
        if not stay.all():
            owner, state, swaps = owner[stay], state[stay], [s[stay] for s in swaps]
    return signature


def least_equal(slots: int, threshold: float, tolerance: float) -> int:
    """Fewest equal slots that a pair at the threshold shows with probability 1 - ``tolerance`` or more."""
    tail, m = 0.0, -1
    while tail <= tolerance:
        m += 1
        tail += math.comb(slots, m) * threshold ** m * (1 - threshold) ** (slots - m)
    return m


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


SIGNED = "doc_id long, text_hash long, text_key binary, n_shingles long, signature binary"


def sign(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """doc_id, text_hash, text_key (128 bits of the set), n_shingles, signature (32 bits a slot); key and signature null for empty sets."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        sets_of = ShingleSets(n)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [sets_of(t) for t in part.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                values = (mix64(super_min_hashes([sets[i] for i in full], slots)) >> np.uint64(32)).astype(np.uint32)
                keys, raw = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, values):
                    keys[i], raw[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "text_hash", "text_key", "n_shingles", "signature"])

    return _texts(docs).mapInArrow(run, SIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def bands_of(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """node, i, band: a row per class and band."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(
        i.alias("i"), F.xxhash64(i, F.substring(F.col("signature"), i * (4 * rows) + 1, F.lit(4 * rows))).alias("band")))
    return classes.select("node", F.explode(cut).alias("b")).select("node", "b.i", "b.band")


def candidate_texts(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text (of the class's first row) of the classes that share a band."""
    first = classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    need = first.join(members.select("node").distinct(), "node")
    return written(_texts(docs).join(need, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"), "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets reach the threshold.

    Groups of at most about GROUP pairs share one copy of the text of ``b``;
    a group streams past it.
    """
    spark = pairs.sparkSession
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("deals"))
    dealt = pairs.join(sizes, "b").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    heads = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("b").alias("node"), F.lit(0).alias("kind"))
    asked = dealt.select("b", "deal", F.col("a").alias("node"), F.lit(1).alias("kind")).unionByName(heads)
    rows = (asked.join(texts, "node").repartition(partitions(spark), "b", "deal").sortWithinPartitions("b", "deal", "kind", "node")
            .select("b", "deal", "kind", "node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of, head = ShingleSets(n), np.empty(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                a, b = [], []
                for own, _, kind, node, text in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns)):
                    found = sets_of(text)
                    if kind == 0:
                        head = found
                    elif reaches(found, head, percent):
                        a.append(node)
                        b.append(own)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return written(rows.mapInArrow(run, "a long, b long"), "near-links")


class Forest:
    """Union-find over the components seen in one unit."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def links_between(held: list[dict], bands: int, rows: int, least: int, percent: int) -> list[tuple[int, int]]:
    """Links (node, node) that join the components of one unit's left and right block, by exact verification."""
    component = [r["component"] for r in held]
    left, right = (np.array([r[c] for r in held]) for c in ("left", "right"))
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in held]
    size = np.array([len(x) for x in sets])
    signature = np.frombuffer(b"".join(r["signature"] for r in held), np.uint32).reshape(len(held), -1)
    forest, out, same = Forest(), [], bool((left & right).any())
    of = np.array(component)
    for x in np.nonzero(left)[0]:
        ys = np.nonzero(right & (of != of[x]))[0]
        ys = ys[ys > x] if same else ys
        ys = ys[100 * np.minimum(size[ys], size[x]) >= percent * np.maximum(size[ys], size[x])]
        equal = signature[ys] == signature[x]
        ys = ys[(equal.sum(1) >= least) & equal.reshape(len(ys), bands, rows).all(2).any(1)]
        for y in ys:
            if forest.find(component[x]) != forest.find(component[y]) and reaches(sets[x], sets[y], percent):
                forest.join(component[x], component[y])
                out.append((held[x]["node"], held[y]["node"]))
    return out


def clusters_of(known: DataFrame) -> DataFrame:
    """cluster, component of the components that meet others in a band of ``known (i, band, node, component)``."""
    heads = known.groupBy("i", "band").agg(F.min("component").alias("b"), F.max("component").alias("y")).filter("b < y").select("i", "band", "b")
    ties = known.select("i", "band", F.col("component").alias("a")).distinct().join(heads, ["i", "band"]).filter("a != b").select("a", "b").distinct()
    return components(ties).select(F.col("component").alias("cluster"), F.col("node").alias("component"))


def close_links(known: DataFrame, classes: DataFrame, texts: DataFrame, n: int, bands: int, rows: int, percent: int, block: int, tolerance: float) -> DataFrame:
    """Links (a, b) that join different components of one cluster.

    A component with ``block`` classes or WEIGHT shingles or more stands in
    blocks of its own, which never meet each other; the rest are mixed.
    """
    spark = known.sparkSession
    mixed = (known.select("node", "component").distinct().join(clusters_of(known), "component")
             .join(classes.select("node", "n_shingles", "signature"), "node"))
    mixed = written(mixed, "mixed")
    per = mixed.groupBy("cluster", "component").agg(F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / WEIGHT).alias("k"))
    small = F.sum(F.when(F.col("k") < 1, F.col("k")).otherwise(0))
    rest = per.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(small)).cast("int").alias("rest"))
    label = F.when(F.col("k") >= 1, F.struct(F.col("component"), F.pmod(F.xxhash64("node"), F.ceil("k")).cast("int").alias("sub"))) \
        .otherwise(F.struct(F.lit(None).cast("long").alias("component"), F.pmod(F.xxhash64("component"), F.col("rest")).cast("int").alias("sub")))
    dealt = mixed.join(per, ["cluster", "component"]).join(rest, "cluster").select("cluster", "node", "component", "signature", label.alias("own"))
    labels = dealt.groupBy("cluster").agg(F.collect_set("own").alias("labels"))  # one for every ``block`` classes
    meets = dealt.join(labels, "cluster").withColumn("other", F.explode(F.filter("labels", lambda x: x["component"].isNull() | ~x["component"].eqNullSafe(F.col("own.component")))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    units = meets.select("cluster", F.to_json(F.struct(low.alias("low"), high.alias("high"))).alias("unit"), (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"),
                         "node", "component", "signature")
    least = least_equal(bands * rows, percent / 100, tolerance)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = ShingleSets(n)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sets_of(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    sets = texts.join(mixed.select("node"), "node").select("node", "text").mapInArrow(with_sets, "node long, shingles binary")
    units = units.join(sets, "node").repartition(partitions(spark), "cluster", "unit").sortWithinPartitions("cluster", "unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            found = links_between(held, bands, rows, least, percent)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    own = (row["cluster"], row["unit"])
                    if own != key and held:
                        yield done()
                        held = []
                    key = own
                    held.append(row)
        if held:
            yield done()

    return written(units.mapInArrow(run, "a long, b long"), "near-links")


def _joined(links: DataFrame, every: DataFrame) -> DataFrame:
    """``every (node, component)`` with the components that ``links (a, b)`` of nodes tie together."""
    side = every.select(F.col("node").alias("a"), F.col("component").alias("x"))
    other = every.select(F.col("node").alias("b"), F.col("component").alias("y"))
    ties = links.join(side, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    merged = components(ties).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return written(every.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "near-components")


def near_groups(docs: DataFrame, percent: int = 80, n: int = 5, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
                tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links (100 * intersection >=
    ``percent`` * union) reach; kept tells whether it is the document's own.
    """
    signed = written(sign(docs, n, bands * rows), "signed")
    firsts = (signed.filter("doc_id is not null and text_key is not null").groupBy("text_key")
              .agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "signature")).alias("first")))
    classes = written(firsts.select(F.monotonically_increasing_id().alias("node"), "text_key", "first", "first.n_shingles", "first.signature"), "classes")
    shared = bands_of(classes, bands, rows)
    sizes = shared.groupBy("i", "band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = written(shared.join(sizes, ["i", "band"]), "members")
    texts = candidate_texts(members, classes, docs)
    scores = members.groupBy("node").agg(F.sum("k").alias("score"))
    known = written(members.join(scores, "node").select("i", "band", "node", "score", F.col("node").alias("component")), "known")
    every = known.select("node", "component").distinct()
    for turn in range(rounds):
        order = F.col("score") if turn == 0 else F.xxhash64("node", F.lit(turn))
        heads = known.groupBy("i", "band").agg(F.max(F.struct(order.alias("order"), "node", "component")).alias("h"))
        most = (known.join(heads, ["i", "band"]).filter("component != h.component").groupBy("node", F.col("h.node").alias("head"))
                .agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max(F.struct("k", "head")).alias("m")))
        links = verified(most.select(F.col("node").alias("a"), F.col("m.head").alias("b")), texts, n, percent)
        every = _joined(links, every)
        known = written(known.drop("component").join(every, "node"), "known")
    every = _joined(close_links(known, classes, texts, n, bands, rows, percent, block, tolerance), every)
    named = classes.select("node", "text_key", F.col("first.doc_id").alias("doc_id")).join(every, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    keyed = named.join(least, "component").select("text_key", "component_id")
    own = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("text_key")).alias("text_key"))
    found = own.join(keyed, "text_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
