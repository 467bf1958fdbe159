"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Every vector o is written as c + |r| u with the mean c of all vectors.  A
random rotation turns u, the signs of its components are kept as packed bits,
and b denotes the unit vector of those signs.  With the correction scalars
|r| and <b, u>,

    <o, q>  ~  <c, q> + |r| <b, q'> / <b, u>        (q' is the rotated query)

and the error stays, with high probability, below
|r| |q| sqrt(1 - <b,u>^2) / <b,u> * ``epsilon`` / sqrt(D - 1).  Vectors whose
estimate plus this bound reaches the k-th best exact score seen are reranked
with their original components in double precision.

Every row is indexed.  Queries meet all rows in blocks of bounded size, so no
task depends on the size of either side; each pair of blocks returns at most k
rows per query.  Vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id.  Rows are told by where
they stand: of rows that repeat an id each asks and is found as a row of its
own.  Vectors of one length are searched among themselves.  Equal scores are
ordered by the smaller id; vectors of any length count whole, further columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import ship, written

INDEX_SCHEMA = "vec_id long, code binary, norm double, align double, v array<double>"
HIT_SCHEMA = "query_row long, vec_id long, score double"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norms and <b, u> of vectors (rows)."""
    residual = vectors - centre
    norm = np.sqrt((residual * residual).sum(1))
    unit = (residual / np.where(norm > 0, norm, 1)[:, None]) @ turn
    bits = unit >= 0
    align = np.abs(unit).sum(1) / math.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, align, 1.0)


def estimates(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """<b, q'> for packed codes, one table of 256 partial sums per byte."""
    dim, width = len(query), codes.shape[1]
    padded = np.zeros(width * 8)
    padded[:dim] = query
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    table = padded.reshape(width, 8) @ signs.T
    out = table[0][codes[:, 0]]
    for j in range(1, width):
        out += table[j][codes[:, j]]
    return out / math.sqrt(dim)


def search_block(query_rows, queries, rows, ids, codes, norm, align, vectors, centre, turn, k: int, epsilon: float):
    """The k best of one block for each query: the query's row, ids and exact scores."""
    found, turned = [], queries @ turn
    spread = norm * np.sqrt(np.maximum(0, 1 - align ** 2)) / align * epsilon / math.sqrt(max(1, queries.shape[1] - 1))
    for query_row, query, q in zip(query_rows, queries, turned):
        length = math.sqrt(float(query @ query))
        guess = float(centre @ query) + norm * estimates(codes, q) / align
        other = rows != query_row
        guess[~other] = -np.inf
        if len(guess) > 4 * k:
            first = np.argpartition(-guess, 2 * k)[:2 * k]
            first = first[other[first]]
            exact = np.sort((vectors[first] * query).sum(1))
            least = exact[-k] if len(exact) >= k else -np.inf
            keep = np.nonzero((guess + spread * length >= least) & other)[0]
            keep = np.union1d(keep, first)
        else:
            keep = np.nonzero(other)[0]
        score = (vectors[keep] * query).sum(1)
        best = np.lexsort((ids[keep], -score))[:k]
        found.append((np.full(len(best), query_row), ids[keep][best], score[best]))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    nonzero = F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & nonzero)


def build_index(vectors: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Code and correction scalars of every vector."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(pa.chunked_array([batch.column(1)]))
                codes, norm, align = encode(v, centre, turn)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(align), batch.column(1)],
                    ["vec_id", "code", "norm", "align", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, INDEX_SCHEMA)


def nearest(embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            epsilon: float = 2.5, rows_per_block: int = 16_384, queries_per_block: int = 1_024) -> DataFrame:
    """The k nearest rows of every row that satisfies ``is_query`` (a function of the id column).

    Rows are told by where they stand, not by their id: rows of one id are
    queries and candidates of their own.  Vectors of different lengths have no
    inner product; each length is searched by itself.  Returns query_id, rank
    (from 1), vec_id, score.  ``rows_per_block`` and ``queries_per_block``
    bound what one task holds.
    """
    usable = usable_vectors(embeddings, id_col, vector_col)
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()  # a row per length
    out = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, size in enumerate(sizes):
        found = _nearest(usable.filter(F.size("v") == size.dim), size.dim, size.n, is_query, k, epsilon, rows_per_block, queries_per_block)
        out = found if i == 0 else out.unionByName(found)
    return out


def _nearest(usable: DataFrame, dim: int, n: int, is_query, k: int, epsilon: float, rows_per_block: int, queries_per_block: int) -> DataFrame:
    """``nearest`` among n vectors of one length."""
    means = usable.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).collect()[0]  # one vector
    centre, turn = np.array(means, np.float64), rotation(dim)
    index = written(build_index(usable, centre, turn).withColumn("row", F.monotonically_increasing_id()), "vector-index")

    asking = index.filter(is_query(F.col("vec_id"))).select("row", "vec_id", F.col("v").alias("q"))
    blocks = math.ceil(n / rows_per_block)
    query_blocks = max(1, math.ceil(asking.count() / queries_per_block))

    def block(count: int):
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    left = asking.select(F.col("row").alias("query_row"), "q", block(query_blocks).alias("qb"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    right = index.withColumn("rb", block(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if queries.num_rows and rows.num_rows:
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            out = search_block(queries.column("query_row").to_numpy(), _matrix(queries.column("q")), rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(),
                               codes, rows.column("norm").to_numpy(), rows.column("align").to_numpy(), _matrix(rows.column("v")),
                               centre, turn, k, epsilon)
        return pa.table({"query_row": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    hits = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(search, HIT_SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = asking.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query_row").select("query_id", "rank", "vec_id", "score")
