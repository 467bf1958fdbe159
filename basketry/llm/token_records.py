"""Token ids as length-delimited binary records with a separate offset index.

Record files hold one frame per document:

    u64 length | u32 masked CRC-32C of those 8 bytes | data | u32 masked CRC-32C of data

``data`` is ``u8 flags | i64 doc_id | ids`` with ids as little-endian u16, or
u32 when the vocabulary has more than 65,536 ids (flag 2); flag 1 marks a null
doc_id.  ``<file>.idx`` has ``u64 offset, u64 frame length, u64 ids`` per
record, so a shuffled reader can seek to any record without reading others.

Documents are dealt to files by ranges of doc_id and sorted in each, so ids
ascend within and across files.  A null text is encoded as the empty one;
a null doc_id sorts before all others; equal doc_ids sort by the text's hash;
an empty table gives no files and an empty result.  The tokenizer's added
tokens (``<|endoftext|>``) in a text get their ids, as the library's encode
without special tokens of its own gives them.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.common import AtomicFile, filesystem, partitions, shared_folder, ship, written
from basketry.llm.crc import crc32c_many, masked
from basketry.llm.pieces import PieceCodes, splitter

NULL_ID, WIDE = 1, 2
HEAD = np.dtype([("length", "<u8"), ("length_crc", "<u4")])
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
# Fixed value: the public pattern by which byte-level tokenizer definitions split a text into words.
BYTE_LEVEL = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
FLUSH = 4 << 20  # bytes of data framed at once
FILES_SCHEMA = "file_no int, path string, records long, tokens long"
ROWS_SCHEMA = "file_no int, seq long, doc_id long, n_tokens long, start_in_file long, ids_crc32 long"

_ENCODERS: dict = {}


def added_tokens(vocabulary: str) -> list[str]:
    """Contents of the added tokens of a tokenizer definition (JSON text)."""
    return [t["content"] for t in json.loads(vocabulary).get("added_tokens") or [] if t["content"]]


def piece_encoder(vocabulary: str) -> tuple[Callable[[list[str], list[bool]], list[bytes]], str]:
    """Encoder of this worker for the tokenizer definition (JSON text), and the type of its ids.

    It takes texts and whether each is to be encoded whole: no cut may go
    through an added token.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core of its own; more threads only wait
    from tokenizers import Tokenizer
    key = hash(vocabulary)
    if key not in _ENCODERS:
        tok = Tokenizer.from_str(vocabulary)
        kind = "<u4" if tok.get_vocab_size() > 65_536 else "<u2"

        def encode(texts: list[str]) -> list[bytes]:
            return [array("I" if kind == "<u4" else "H", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        pieces = PieceCodes(splitter(BYTE_LEVEL), encode)

        def encode_texts(texts: list[str], whole: list[bool]) -> list[bytes]:
            if not any(whole):
                return pieces(texts)
            rest = iter(pieces([t for t, w in zip(texts, whole) if not w]))
            return [encode([t])[0] if w else next(rest) for t, w in zip(texts, whole)]
        _ENCODERS.clear()
        _ENCODERS[key] = (encode_texts, kind)
    return _ENCODERS[key]


class RecordFile:
    """One record file and its index, written in bounded pieces."""

    def __init__(self, uri: str):
        self.records, self.index = AtomicFile(uri), AtomicFile(uri + ".idx")
        self.count = self.tokens = self.offset = self.held = 0
        self.waiting: list[tuple[bytes, int]] = []

    def add(self, data: bytes, tokens: int) -> None:
        self.waiting.append((data, tokens))
        self.held += len(data)
        if self.held >= FLUSH:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        datas = [d for d, _ in self.waiting]
        size = np.array([len(d) for d in datas], np.int64)
        body = np.frombuffer(b"".join(datas), np.uint8)
        head = np.zeros(len(datas), HEAD)
        head["length"] = size
        raw = np.frombuffer(head["length"].tobytes(), np.uint8)
        head["length_crc"] = masked(crc32c_many(raw, np.arange(len(datas)) * 8, np.full(len(datas), 8)))
        tail = masked(crc32c_many(body, np.cumsum(size) - size, size)).astype("<u4")
        heads, tails = head.tobytes(), tail.tobytes()
        self.records.write(b"".join(x for i, d in enumerate(datas)
                                    for x in (heads[12 * i:12 * i + 12], d, tails[4 * i:4 * i + 4])))
        entry = np.zeros(len(datas), ENTRY)
        entry["length"] = size + 16
        entry["offset"] = self.offset + np.cumsum(size + 16) - (size + 16)
        entry["tokens"] = [t for _, t in self.waiting]
        self.index.write(entry.tobytes())
        self.offset += int((size + 16).sum())
        self.count += len(datas)
        self.tokens += int(entry["tokens"].sum())
        self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.records.close()
        self.index.close()


def _pack(doc_id: int | None, codes: bytes, kind: str, end_id: int) -> tuple[bytes, int]:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if kind == "<u4" else 0)
    ids = codes + np.array([end_id], kind).tobytes()
    return bytes([flags]) + int(doc_id or 0).to_bytes(8, "little", signed=True) + ids, len(ids) // int(kind[2])


def write_records(docs: DataFrame, folder: str, vocabulary_json: str, end_id: int = 0,
                  files: int | None = None) -> DataFrame:
    """Encode ``doc_id, text`` of ``docs`` and write record files below ``folder``.

    Returns the manifest, one row per file: file_no, path, records, tokens.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(vocabulary_json)  # bounded: a vocabulary file

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, out = TaskContext.get(), None
        number = task.partitionId()
        # each attempt writes a file of its own, and the manifest names that of the attempt that counted
        path = f"{folder}/part-{number:05d}-{task.taskAttemptId()}.rec"
        gc.disable()  # the dictionaries hold no cycles, and scanning them costs a tenth of the time
        try:
            encode, kind = piece_encoder(vocabulary.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    out = out or RecordFile(path)
                    codes = encode([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist())
                    for doc_id, c in zip(part.column(0).to_pylist(), codes):
                        out.add(*_pack(doc_id, c, kind, end_id))
        finally:
            gc.enable()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([path]), pa.array([out.count]), pa.array([out.tokens])],
                ["file_no", "path", "records", "tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order)
    whole = reduce(Column.__or__, [F.contains("text", F.lit(x)) for x in added_tokens(vocabulary_json)], F.lit(False))
    marked = dealt.withColumn("whole", F.coalesce(whole, F.lit(False)))
    return written(marked.mapInArrow(write, FILES_SCHEMA), "record-manifest")


def _check(ok: np.ndarray, what: str, path: str) -> None:
    if not ok.all():
        raise ValueError(f"{path}: {what} of record {int(np.argmin(ok))} does not match")


def read_frames(path: str, chunk: int = 8 << 20) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """Runs of records of one file: index entries, their bytes, and data starts; checksums are verified."""
    fs, at = filesystem(path)
    with fs.open_input_file(at + ".idx") as f:
        index = np.frombuffer(f.read(), ENTRY)
    ends = np.cumsum(index["length"])
    with fs.open_input_file(at) as f:
        a = 0
        while a < len(index):
            base = int(index["offset"][a])
            b = max(a + 1, int(np.searchsorted(ends, base + chunk)))
            part = index[a:b]
            f.seek(base)
            raw = f.read(int(part["length"].sum()))
            data = np.frombuffer(raw, np.uint8)
            starts = (part["offset"] - base).astype(np.int64)
            size = part["length"].astype(np.int64) - 16
            word = lambda at, kind, w: data[at[:, None] + np.arange(w)].copy().view(kind)[:, 0]
            _check(word(starts, "<u8", 8) == size, "length", path)
            _check(word(starts + 8, "<u4", 4) == masked(crc32c_many(data, starts, np.full(len(part), 8))), "length checksum", path)
            _check(word(starts + 12 + size, "<u4", 4) == masked(crc32c_many(data, starts + 12, size)), "data checksum", path)
            yield part, raw, starts + 12
            a = b


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (unsigned 32-bit) of one record's data."""
    ids = np.frombuffer(data, "<u4" if data[0] & WIDE else "<u2", offset=9).astype("<u4")
    return (None if data[0] & NULL_ID else int.from_bytes(data[1:9], "little", signed=True)), ids


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record, by seeking through the offset index."""
    fs, at = filesystem(path)
    with fs.open_input_file(at + ".idx") as f:
        f.seek(number * ENTRY.itemsize)
        entry = np.frombuffer(f.read(ENTRY.itemsize), ENTRY)[0]
    with fs.open_input_file(at) as f:
        f.seek(int(entry["offset"]))
        return unpack(f.read(int(entry["length"]))[12:-4])


def read_records(manifest: DataFrame) -> DataFrame:
    """Read every record of the manifest's files back; one row per record.

    Columns: file_no, seq (position in the file), doc_id, n_tokens,
    start_in_file (ids before it in the file), ids_crc32.
    """
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = tokens = 0
                for entries, raw, starts in read_frames(path):
                    ids_of, crcs = [], []
                    for s, size in zip(starts.tolist(), (entries["length"] - np.uint64(16)).tolist()):
                        doc_id, ids = unpack(raw[s:s + int(size)])
                        ids_of.append(doc_id)
                        crcs.append(zlib.crc32(ids.tobytes()))
                    n = entries["tokens"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), number, np.int32)), pa.array(seq + np.arange(len(n))),
                         pa.array(ids_of, pa.int64()), pa.array(n), pa.array(tokens + np.cumsum(n) - n),
                         pa.array(crcs, pa.int64())],
                        ["file_no", "seq", "doc_id", "n_tokens", "start_in_file", "ids_crc32"])
                    seq, tokens = seq + len(n), tokens + int(n.sum())

    files = manifest.select("file_no", "path").repartitionByRange(partitions(manifest.sparkSession), "file_no")
    return files.mapInArrow(read, ROWS_SCHEMA)


def record_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each file: one row per file, as many as shuffle partitions at most."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("ids_before"))


def token_records(docs: DataFrame, vocabulary_json: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token records, read the files back, and describe every record.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the
    end id), ids_crc32 (of the ids as little-endian u32), file_no, seq.
    """
    spark: SparkSession = docs.sparkSession
    manifest = write_records(docs, folder or shared_folder(spark, "token-records"), vocabulary_json, end_id)
    # broadcast is bounded: one small row per record file
    rows = read_records(manifest).join(F.broadcast(record_starts(manifest)), "file_no")
    return rows.select("doc_id", (F.col("ids_before") + F.col("start_in_file")).alias("start"),
                       "n_tokens", "ids_crc32", "file_no", "seq")
