"""Least-cost repair of conversation structure by a rank-convergence parallel Viterbi.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Edits of a row
are Keep (0), Rerole to user or assistant (1) and Delete (2, required for
blank rows and duplicates); an empty user or assistant turn may be Inserted
anywhere (5); a truncated row that is not deleted adds 5.  Among the cheapest
edit scripts the one of the ASCII-least audit (initials of the edits) is taken.

1. Rows are ordered by conversation, turn (nulls first), role and text over
   range partitions; equal rows are folded to one with a count first.  The
   rows of a conversation within one partition are a chunk: a byte a row.
2. Every chunk runs backward from a speculative vector of costs, one per
   state, and keeps the vectors of all its rows.  Fix-up passes run a chunk
   again from the vector its right neighbour begins with, until a vector
   differs from the kept one by a constant only: what lies before is settled
   but for that constant.  A pass takes 2, 4, 8, ... neighbours in one go, so
   the passes are logarithmic in the chunks of the longest conversation.
3. The stitched vectors say which edits lie on a cheapest script; each chunk
   traces the least audit forward from every state it may be entered in.
4. A last pass streams every conversation's rows in order past its chunks'
   audits.  It holds one row at a time; only the audit itself (a byte a row,
   a column of the result) stays with the conversation.

Nulls of conv_id, turn, role and text read as one space; a null conv_id is a
conversation, and rows of a null turn come first.  Rows of one turn stand by
role, then text (UTF-8 byte order).  A role that starts with none of s, u, a
(an empty one too) must be reroled or deleted.  Empty texts are blank; texts
of any length count whole.  Repeated rows are duplicates after the first.  An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import partitions, ship, written

DELETE, KEEP, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows ended with
FREE = 1 << 20  # more than any difference of costs between states
KEPT_BY = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of a reroled or inserted row
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = ["", "s", "u", "a"]
CUT, FORCED, BLANK = 4, 8, 16  # bits of a row's code; the lowest two hold its initial
ROWS_PER_PART = 500_000


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs after any insertions."""
    for _ in range(3):
        costs = [min(costs[s], costs[NEXT[s]] + INSERT) for s in range(4)]
    return tuple(costs)


def _options(state: int, code: int, after) -> dict[str, tuple[int, int]]:
    """Edit -> (cost from here on, next state) of a live row."""
    extra, kept = TRUNCATED * bool(code & CUT), KEPT_BY.get(INITIALS[code & 3], {}).get(state)
    found = {"D": (DELETE + after[state], state), "R": (REROLE + extra + after[NEXT[state]], NEXT[state])}
    return found if kept is None else found | {"K": (KEEP + extra + after[kept], kept)}


class Steps:
    """Backward steps and forward choices, each worked out once for a code and vector (differences are few)."""

    def __init__(self):
        self.back: dict = {}
        self.choices: dict = {}

    def before(self, code: int, after: bytes) -> bytes:
        """Vector before a row, less its least entry."""
        found = self.back.get((code, after))
        if found is None:
            costs = _closed([min(c for c, _ in _options(s, code, after).values()) for s in range(4)])
            found = self.back[code, after] = bytes(c - min(costs) for c in costs)
        return found

    def choose(self, state: int, code: int, after: bytes) -> tuple[str, int]:
        """Least letters of a cheapest script up to and with a row, and the state behind it."""
        found = self.choices.get((state, code, after))
        if found is None:
            whole = _closed([min(c for c, _ in _options(s, code, after).values()) for s in range(4)])
            letters, at = "", state
            while True:
                ways = _options(at, code, after) | {"I": (INSERT + whole[NEXT[at]], NEXT[at])}
                letter = min(k for k, (cost, _) in ways.items() if cost == whole[at])
                letters, at = letters + letter, ways[letter][1]
                if letter != "I":
                    break
            found = self.choices[state, code, after] = letters, at
        return found


END = bytes(_closed([0, FREE, FREE, 0]))  # nothing follows


def closing(state: int) -> str:
    """Insertions at the end of a conversation."""
    return "I" * (END[state] // INSERT)


def run_back(steps: Steps, codes: bytes, end: bytes, kept: bytes | None = None) -> tuple[bytes, int]:
    """Vectors before each row (four bytes a row) from the vector behind the last, and how many rows were run.

    With the ``kept`` vectors of an earlier run it stops at the first equal
    one: before that nothing changes but a constant.
    """
    out, vector = [], end
    for i in range(len(codes) - 1, -1, -1):
        if not codes[i] & FORCED:
            vector = steps.before(codes[i] & 7, vector)
        if kept is not None and kept[4 * i:4 * i + 4] == vector:
            return kept[:4 * i + 4] + b"".join(reversed(out)), len(out) + 1
        out.append(vector)
    return b"".join(reversed(out)), len(out)


def trace(steps: Steps, codes: bytes, vectors: bytes, end: bytes, state: int) -> tuple[str, int]:
    """Audit letters of a chunk entered in ``state``, and the state it is left in."""
    out = []
    for i, code in enumerate(codes):
        if code & FORCED:
            out.append("D")
        else:
            letters, state = steps.choose(state, code & 7, vectors[4 * i + 4:4 * i + 8] or end)
            out.append(letters)
    return "".join(out), state


# ------------------------------------------------------------------ rows in order
SPACE = " "
# Fixed patterns of the contract: a character that is no white space, an end of a sentence.
NOT_BLANK, LAST_IS_END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _row_code() -> Column:
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(NOT_BLANK)
    return (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
            + F.when(blank, FORCED + BLANK).when(F.col("text").rlike(LAST_IS_END), 0).otherwise(CUT)).cast("int")


def in_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Folded rows with their place: conv, part, seq, turn, role, text, n, code, digest (of role and text), seen.

    ``rows`` has conv_id, turn, role, text and n (how often the row stands
    there; 0 only keeps the conversation).  ``seen`` marks a row whose role
    and text came earlier in its conversation and partition.
    """
    spark = rows.sparkSession
    ship(spark)
    plain = rows.select(
        F.concat(F.lit("="), F.col("conv_id").cast("string")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(SPACE)).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(SPACE)).alias("text"),
        F.col("n").cast("long").alias("n")).withColumn("conv", F.coalesce("conv", F.lit("")))
    folded = plain.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    parts = parts or max(partitions(spark), math.ceil(rows.count() / ROWS_PER_PART))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = folded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("code", _row_code()) \
        .withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, current, known = TaskContext.get().partitionId(), 0, None, set()
        for batch in batches:
            seen = []
            for conv, n, digest in zip(*(batch.column(c).to_pylist() for c in ("conv", "n", "digest"))):
                if conv != current:
                    current, known = conv, set()
                seen.append(n > 0 and digest in known)
                if n:
                    known.add(digest)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * size, pa.int32()), pa.array(range(seq, seq + size), pa.int64()), pa.array(seen, pa.bool_())],
                [*batch.schema.names, "part", "seq", "seen"])
            seq += size

    return written(spread.mapInArrow(number, "conv string, turn long, role string, text string, n long, code int, digest binary, part int, seq long, seen boolean"), "turns")


def seen_before(ordered: DataFrame) -> DataFrame:
    """conv, part, seq of the rows whose role and text came in an earlier partition (conversations of several only)."""
    wide = ordered.groupBy("conv").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").select("conv")
    local = ordered.filter("not seen and n > 0").select("conv", "part", "seq", "digest").join(wide, "conv")
    first = local.groupBy("conv", "digest").agg(F.min("part").alias("first"))
    return local.join(first, ["conv", "digest"]).filter("part > first").select("conv", "part", "seq")


# ------------------------------------------------------------------ chunks
CHUNK_SCHEMA = "conv string, part int, last boolean, codes binary, vectors binary, end binary"


def _consecutive(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[bool, dict]]:
    """Rows one at a time, with a mark on the first of each run of ``key``."""
    before = None
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            for row in batch.slice(a, 1024).to_pylist():
                own = tuple(row[k] for k in key)
                yield own != before, row
                before = own


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


CHUNKS = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("last", pa.bool_()), ("codes", pa.binary()), ("vectors", pa.binary()), ("end", pa.binary())])


def chunks(ordered: DataFrame, repeated: DataFrame) -> DataFrame:
    """A row per conversation and partition: codes of its rows, vectors from the speculative end (the true one for the last)."""
    marked = ordered.select("conv", "part", "seq", "n", "code", "seen").join(repeated.withColumn("_again", F.lit(True)), ["conv", "part", "seq"], "left")
    ends = ordered.groupBy("conv").agg(F.max("part").alias("last_part"))
    thin = (marked.filter("n > 0").join(ends, "conv")
            .select("conv", "part", "seq", (F.col("part") == F.col("last_part")).alias("last"),
                    F.col("code").bitwiseOR(F.when(F.col("seen") | F.col("_again"), FORCED).otherwise(0)).alias("code"))
            .repartition(partitions(ordered.sparkSession), "conv", "part").sortWithinPartitions("conv", "part", "seq"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held, out = Steps(), None, []

        def close():
            conv, part, last, codes = held
            vectors, _ = run_back(steps, bytes(codes), END)
            out.append({"conv": conv, "part": part, "last": last, "codes": bytes(codes), "vectors": vectors, "end": END})

        for new, row in _consecutive(batches, ("conv", "part")):
            if new:
                if held:
                    close()
                held = (row["conv"], row["part"], row["last"], bytearray())
                if len(out) >= 1000:
                    yield _emit(out, CHUNKS)
                    out.clear()
            held[3].append(row["code"])
        if held:
            close()
        if out:
            yield _emit(out, CHUNKS)

    return written(thin.mapInArrow(build, CHUNK_SCHEMA), "chunks")


def settle(found: DataFrame, most: int = 64) -> DataFrame:
    """``found`` with the vectors of the whole conversations, up to a constant, by fix-up passes."""
    spark = found.sparkSession
    wide = found.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("conv")
    single = found.join(wide, "conv", "left_anti")
    open_, level = written(found.join(wide, "conv"), "chunks"), 0
    while open_.head(1):
        level += 1
        if level > most:
            raise RuntimeError(f"costs did not settle in {most} passes")
        group = F.shiftright("part", level)
        # the first chunk of a group hands its vector to the group before it
        heads = open_.groupBy("conv", group.alias("group")).agg(F.min(F.struct("part", F.substring("vectors", 1, 4).alias("end"))).alias("h"))
        given = F.lead("h.end").over(Window.partitionBy("conv").orderBy("group"))  # at most a row a range partition
        heads = heads.select("conv", "group", given.alias("given"))
        work = (open_.withColumn("group", group).join(heads, ["conv", "group"], "left")
                .repartition(partitions(spark), "conv", "group").sortWithinPartitions("conv", "group", F.col("part").desc()))

        def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps, vector = Steps(), END
            for new, row in _consecutive(batches, ("conv", "group")):
                if new:
                    vector = row["given"] or END
                changed = 0
                if vector != row["end"]:
                    row["vectors"], changed = run_back(steps, row["codes"], vector, row["vectors"])
                out = {k: row[k] for k in CHUNKS.names} | {"end": vector, "ran": changed, "head": row["vectors"][:4]}
                vector = row["vectors"][:4]
                yield _emit([out], FIXED)

        fixed = written(work.mapInArrow(fix, CHUNK_SCHEMA + ", ran long, head binary"), "chunks")
        # settled once every chunk ends with the vector that the next one begins with
        behind = F.lead("head").over(Window.partitionBy("conv").orderBy("part"))
        open_now = fixed.select("conv", "end", behind.alias("behind")).filter("end != behind").select("conv").distinct()
        single = single.unionByName(fixed.join(open_now, "conv", "left_anti").select(*CHUNKS.names))
        open_ = written(fixed.join(open_now, "conv").select(*CHUNKS.names), "chunks")
    return single


FIXED = pa.schema([*CHUNKS, ("ran", pa.int64()), ("head", pa.binary())])


def traced(settled: DataFrame) -> DataFrame:
    """conv, part, and for every state a chunk may be entered in its audit and the state behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(a, 256).to_pylist():
                    ways = [trace(steps, row["codes"], row["vectors"], row["end"], s) for s in range(4 if row["part"] != row["first"] else 1)]
                    out.append({"conv": row["conv"], "part": row["part"], "audits": [w[0] for w in ways], "states": [w[1] for w in ways]})
                yield _emit(out, TRACED)

    first = settled.groupBy("conv").agg(F.min("part").alias("first"))
    return settled.join(first, "conv").mapInArrow(run, "conv string, part int, audits array<string>, states array<int>")


TRACED = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("audits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))])


# ------------------------------------------------------------------ replay
class Report:
    """Digests of one conversation, fed row by row."""

    def __init__(self, conv: str):
        self.conv, self.audit, self.hash, self.kept = conv, [], hashlib.sha256(), 0
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.counts, self.illegal, self.cost, self.before = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, None

    def row(self, row: dict, letter: str) -> None:
        turn, code, n = row["turn"], row["code"], row["n"]
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        copies, initial = n - 1, row["role"][:1]
        if code & BLANK:
            self.counts["blank"] += n
        else:
            self.counts["duplicate"] += copies + row["forced"]
            self.counts["truncated"] += bool(code & CUT) and not row["forced"]
        legal = ("su", "ua", "au")
        self.illegal += (self.before is not None and self.before + initial not in legal) + copies * (initial + initial not in legal)
        self.before = initial
        self.edit(letter, code)
        if copies:
            self.audit.append("D" * copies)
            self.cost += DELETE * copies

    def edit(self, letter: str, code: int = 0) -> None:
        self.audit.append(letter)
        self.cost += {"D": DELETE, "K": KEEP, "R": REROLE, "I": INSERT}[letter] + (TRUNCATED if letter in "KR" and code & CUT else 0)

    def repaired(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.kept else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.kept += 1

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


REPORT = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROWS = pa.schema([("conv", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Report, tuple]]:
    """('row', report, (role, text, edit)) of every repaired row, ('end', report, ()) of every conversation."""
    report, state, ways, at = None, START, None, 0

    def inserted():
        nonlocal state
        state = NEXT[state]
        report.edit("I")
        report.repaired(NAMES[state], "")
        return "row", report, (NAMES[state], "", "I")

    for new, row in _consecutive(batches, ("conv",)):
        if new:
            if report:
                for _ in closing(state):
                    yield inserted()
                yield "end", report, ()
            report, state, ways = Report(row["conv"]), START, None
        if row["audits"] is not None:  # a chunk's audits come before its rows
            way = state if len(row["audits"]) > 1 else 0
            ways, at = row["audits"][way], 0
            continue
        if not row["n"]:
            continue
        while ways[at] == "I":
            at += 1
            yield inserted()
        letter, at = ways[at], at + 1
        report.row(row, letter)
        if letter == "K":
            state = KEPT_BY[row["role"][:1]][state]
        elif letter == "R":
            state = NEXT[state]
        if letter != "D":
            role = row["role"] if letter == "K" else NAMES[state]
            report.repaired(role, row["text"])
            yield "row", report, (role, row["text"], letter)
    if report:
        for _ in closing(state):
            yield inserted()
        yield "end", report, ()


class Repair:
    """The edits of all conversations; ``rows()`` are the repaired ones, ``report()`` has a row per conversation."""

    def __init__(self, rows: DataFrame, parts: int | None = None):
        self.type = rows.schema["conv_id"].dataType.simpleString()
        self.ordered = in_order(rows, parts)
        self.repeated = written(seen_before(self.ordered), "seen")
        self.edits = written(traced(settle(chunks(self.ordered, self.repeated))), "edits")

    def _stream(self, run: Callable, schema: str) -> DataFrame:
        again = self.repeated.withColumn("_again", F.lit(True))
        rows = self.ordered.drop("digest").join(again, ["conv", "part", "seq"], "left").select(
            "conv", "part", "seq", "turn", "role", "text", "n", "code", (F.col("seen") | F.col("_again").isNotNull()).alias("forced"),
            F.lit(None).cast("array<string>").alias("audits"))
        edits = self.edits.select("conv", "part", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                                  F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("code"), F.lit(False).alias("forced"), "audits")
        spark = self.ordered.sparkSession
        streamed = rows.unionByName(edits).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(run, schema)
        conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(self.type)
        return streamed.select(conv_id.alias("conv_id"), *[c for c in streamed.columns if c != "conv"])

    def rows(self) -> DataFrame:
        """conv_id, position (from 0), role, text, edit (K, R or I) of the repaired conversations."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for kind, report, what in _replay(batches):
                if kind == "row":
                    out.append({"conv": report.conv, "position": report.kept - 1, "role": what[0], "text": what[1], "edit": what[2]})
                    if len(out) >= 256:
                        yield _emit(out, ROWS)
                        out = []
            if out:
                yield _emit(out, ROWS)
        return self._stream(run, "conv string, position long, role string, text string, edit string")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for kind, report, _ in _replay(batches):
                if kind == "end":
                    out.append(report.result())
                    if len(out) >= 512:
                        yield _emit(out, REPORT)
                        out = []
            if out:
                yield _emit(out, REPORT)
        return self._stream(run, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(rows: DataFrame, parts: int | None = None) -> Repair:
    """Repair conversations ``rows (conv_id, turn, role, text)``; a column ``n`` gives how often a row stands there (default once)."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    return Repair(rows.select("conv_id", "turn", "role", "text", "n"), parts)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage of crc32(``conv_id:turn``) % 20; a dropped row stays with n = 0, so that its conversation stays."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(SPACE))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind"))
    drop = F.col("_kind") == 0
    return plain.select(
        "conv_id", F.when(~drop, F.col("turn")).alias("turn"),
        F.when(drop, "").when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(drop | (F.col("_kind") == 1), "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(drop, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("n"))
