"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from basketry.session import ensure_checkpoint_dir

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster.

    The package's sources are zipped once per application and handed to
    ``SparkContext.addPyFile``; the driver's own path need not exist on the
    executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="basketry-"), "basketry_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = target


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir`` (not yet created)."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what reads the result survives lost executors without
    running ``df`` again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def filesystem(uri: str):
    """pyarrow file system and path of a shared-folder URI."""
    from pyarrow import fs
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Write a file under a name of its own, then move it to its final name.

    A retried or speculative task writes the same bytes and the last move
    wins, so readers never see half a file.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


# ---------------------------------------------------------------- words
# Multipliers of the polynomial over word hashes (odd 64-bit constants).
MIX = np.uint64(0x9E3779B97F4A7C15)
MASK64 = (1 << 64) - 1


class WordHasher:
    """Text -> one 64-bit hash per normalised word.

    A word is a run of characters between white space, lower-cased, without
    the non-alphanumeric characters at its two ends; runs without any
    alphanumeric character are no words.  Hashes of words seen before come
    from a dictionary of at most ``limit`` entries, which only saves time.
    """

    def __init__(self, limit: int = 300_000):
        self.known = _Known()
        self.known.limit = limit

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.lower().split() if text else []
        found = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        return found[found != 0]


class _Known(dict):
    """Token -> hash of its word, 0 for none; learns what it has not."""

    def __missing__(self, token: str) -> int:
        import xxhash
        a, b = 0, len(token)
        while a < b and not token[a].isalnum():
            a += 1
        while b > a and not token[b - 1].isalnum():
            b -= 1
        value = xxhash.xxh64_intdigest(token[a:b].encode("utf-8", "surrogatepass")) or 1 if b > a else 0
        if len(self) >= self.limit:
            self.clear()
        self[token] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values (splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Order-dependent 64-bit hash of equally long arrays of hashes, element by element."""
    out = None
    for p in parts:
        out = p.copy() if out is None else out * MIX + p
    return mix64(out)
