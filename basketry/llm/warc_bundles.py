"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC/1.1
records, and a skippable frame at its end with the seek table: compressed and
decompressed size of every frame.  ``<bundle>.idx`` (Parquet rows written by
Spark) maps record identifiers to a frame and an offset inside it, so one
record is read by fetching the table, one frame, and no more.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
largest page_id is written as a response, the others as revisits that name it;
smaller payloads are all responses.  A null html is the empty payload.  Pages
with a null page_id are responses unless a page with an id has the same
payload; among several rows with the largest id all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import AtomicFile, filesystem, partitions, shared_folder, ship, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values: magic numbers of the seekable format
FRAME = 256 << 10  # bytes of records in a frame, unless one record is larger
DATE = "2024-01-01T00:00:00Z"
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
ROWS_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PREFIX = "<urn:page:"


def payload_digest(html: str) -> str:
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


class Bundle:
    """One seekable bundle, written frame by frame."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard
        self.out, self.zip = AtomicFile(uri), zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.held = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.waiting and self.held + len(record) > FRAME:
            self.flush()
        at = len(self.table), self.held
        self.waiting.append(record)
        self.held += len(record)
        return at

    def flush(self) -> None:
        if self.waiting:
            frame = self.zip.compress(b"".join(self.waiting))
            self.out.write(frame)
            self.table.append((len(frame), self.held))
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body) + len(footer)) + body + footer)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, from the end of an open file."""
    end = f.size()
    f.seek(end - 9)
    count, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    f.seek(end - 9 - count * width)
    body, at, out = f.read(count * width), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", body, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def make_record(page_id: int | None, serial: str, url: str | None, html: str, refers_to: int | None, digest: str) -> tuple[str, bytes]:
    """Identifier and bytes of a WARC record."""
    payload = b"" if refers_to is not None else html.encode()
    name = f"{PREFIX}{'' if page_id is None else page_id}:{serial}>"
    clean = "".join(c for c in (url or "") if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(html.encode())}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {PREFIX}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return name, "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4:end + 4 + size], end + 8 + size


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for responses).

    Only digests seen twice or more are joined back; Spark counts them map-side
    and splits a digest that fills a partition (adaptive skew join).  Where
    several rows carry the largest page_id of a digest, the first of them by
    url (and task, for rows that are equal) is the response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("_sha1", F.sha1("html"))
    per_id = rows.filter(F.octet_length("html") >= min_bytes).groupBy("_sha1", "page_id").agg(F.count(F.lit(1)).alias("_n"))
    heads = written(per_id.groupBy("_sha1").agg(F.max(F.struct("page_id", "_n")).alias("_h"), F.sum("_n").alias("_copies"))
                    .filter("_copies > 1 and _h.page_id is not null").select("_sha1", F.col("_h.page_id").alias("_head"), F.col("_h._n").alias("_ties")), "warc-heads")
    joined = rows.join(heads, "_sha1", "left")
    at_head = F.col("_head").isNull() | F.col("page_id").eqNullSafe(F.col("_head"))
    if not heads.filter("_ties > 1").head(1):
        return joined.select("page_id", "url", "html", F.when(~at_head, F.col("_head")).alias("refers_to"))
    # equal ids and payloads: the first row of each task, then the first of these
    tied = F.col("_head").isNotNull() & at_head & (F.col("_ties") > 1)
    rest = joined.filter(~F.coalesce(tied, F.lit(False))).select("page_id", "url", "html", F.when(~at_head, F.col("_head")).alias("refers_to"))
    several = joined.filter(tied).withColumn("_task", F.spark_partition_id())
    several = several.withColumn("_r", F.row_number().over(Window.partitionBy("_sha1", "_task").orderBy("url")))
    several = several.withColumn("_deal", F.when(F.col("_r") == 1, -1).otherwise(F.col("_task")))
    first = (F.col("_deal") == -1) & (F.row_number().over(Window.partitionBy("_sha1", "_deal").orderBy("url", "_task")) == 1)
    several = several.withColumn("_first", first).select("page_id", "url", "html", F.when(~F.col("_first"), F.col("_head")).alias("refers_to"))
    return rest.unionByName(several)


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page into bundles below ``folder``; returns the record index."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, bundle, serial = TaskContext.get(), None, 0
        number = task.partitionId()
        # each attempt writes a bundle of its own, and the index names that of the attempt that counted
        path = f"{folder}/bundle-{number:05d}-{task.taskAttemptId()}.warc.zst"
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                index = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns)):
                    bundle = bundle or Bundle(path)
                    name, record = make_record(page_id, f"{number}-{serial}", url, html, refers_to, payload_digest(html))
                    index.append((name, page_id, path, *bundle.add(record), len(record)))
                    serial += 1
                names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names)
        if bundle:
            bundle.close()

    return written(mark_revisits(pages, min_bytes).mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_one(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record: the seek table, one frame, nothing else."""
    import zstandard
    fs, path = filesystem(bundle)
    with fs.open_input_file(path) as f:
        at, packed, plain = seek_table(f)[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    head, payload, _ = parse_record(data, offset)
    return head, payload


def read_bundles(index: DataFrame) -> DataFrame:
    """Read the indexed records back from their bundles, a frame at a time.

    Revisits carry digest, length and the response they refer to; a response's
    digest and length are computed from its payload and must match its headers.
    """
    spark = index.sparkSession
    ship(spark)
    frames = (index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))  # bounded: records of a frame
              .repartitionByRange(partitions(spark), "bundle", "frame"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unzip, name, f, table = zstandard.ZstdDecompressor(), None, None, []
        for batch in batches:
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != name:
                    if f:
                        f.close()
                    fs, path = filesystem(bundle)
                    name, f = bundle, fs.open_input_file(path)
                    table = seek_table(f)
                at, packed, plain = table[frame]
                f.seek(at)
                data, rows = unzip.decompress(f.read(packed), max_output_size=plain), []
                for offset in sorted(offsets):
                    head, payload, _ = parse_record(data, offset)
                    page = head["WARC-Record-ID"][len(PREFIX):].split(":")[0]
                    digest, size = head["WARC-Payload-Digest"][5:], int(head["X-Payload-Length"])
                    refers = head.get("WARC-Refers-To")
                    if refers is None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{bundle}: payload of {head['WARC-Record-ID']} does not match its headers")
                    rows.append((int(page) if page else None, size, digest, head["WARC-Type"],
                                 int(refers[len(PREFIX):-1]) if refers else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return frames.select("bundle", "frame", "offsets").mapInArrow(read, ROWS_SCHEMA)


def warc_bundles(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record, read the bundles back, and return one row per page."""
    index = write_bundles(pages, folder or shared_folder(pages.sparkSession, "warc"), min_bytes)
    return read_bundles(index)
