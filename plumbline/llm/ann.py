"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector of unit length is rotated by a fixed random orthogonal matrix and kept
as the signs of its coordinates, packed into 64-bit words, with one correction
scalar: the inner product of the rotated vector and its own code. A query is
rotated too and its coordinates are rounded to `bits` bits, kept as bit planes,
so that its inner product with a code is a sum of bit counts of masked words.
Divided by the correction that is an unbiased estimate of the cosine, with an
error that shrinks as one over the root of the dimension. A candidate whose estimate
plus `eps` errors cannot reach the k-th best score found so far is passed
over; every other one is scored exactly in double precision.

Queries are taken in blocks of bounded size against all rows; each block is a
broadcast of at most `block` vectors, and each task keeps its k best for each
query, so what is shuffled is k rows for each query and task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.texts import map_arrow, map_rows
from plumbline.session import cut

BITS = 4
EPS = 2.5
BLOCK = 16_384


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def pack_signs(rotated: np.ndarray) -> np.ndarray:
    """Signs as uint64 words, one row for each vector."""
    n, dim = rotated.shape
    bits = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = rotated > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, corrections) of unit vectors."""
    rotated = unit @ turn
    corrections = np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])
    return pack_signs(rotated), corrections


class Query:
    """Bit planes of a block of rotated unit queries."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray, bits: int = BITS):
        rotated = unit @ turn
        self.dim = unit.shape[1]
        self.low = rotated.min(axis=1, initial=0.0)
        self.step = np.maximum((rotated.max(axis=1, initial=0.0) - self.low) / ((1 << bits) - 1), 1e-12)
        levels = np.clip(np.rint((rotated - self.low[:, None]) / self.step[:, None]), 0, (1 << bits) - 1).astype(np.int64)
        self.sums = levels.sum(axis=1)
        self.planes = [pack_signs((levels >> b) & 1) for b in range(bits)]

    def estimate(self, codes: np.ndarray, corrections: np.ndarray, ones: np.ndarray, rows: slice) -> np.ndarray:
        """Estimated cosines of queries `rows` (down) and codes (across)."""
        dots = np.zeros((rows.stop - rows.start, len(codes)))
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                dots += float(1 << b) * np.bitwise_count(plane[rows, w][:, None] & codes[:, w][None, :])
        low, step, sums = self.low[rows, None], self.step[rows, None], self.sums[rows, None]
        signed = step * (2 * dots - sums) + low * (2.0 * ones[None, :] - self.dim)
        return signed / np.sqrt(self.dim) / corrections[None, :]


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 3) -> DataFrame:
    """vec_id, vector, code, correction of every row whose vector can take part.

    Left out: vectors that are null, empty, zero, or hold a null, infinite or NaN
    component, and rows with a null id. All vectors have one dimension, or
    those of the dimension that most rows have take part (ties: the larger).
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    dims = good.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims["dim"] if dims else 1
    good = good.where(F.size("vector") == dim)

    def make():
        turn = rotation(dim, seed)

        def work(batch: pa.RecordBatch) -> dict:
            unit = scaled(matrix(batch.column(1), dim))[0]
            codes, corrections = encode(unit, turn)
            return {"vec_id": batch.column(0), "vector": batch.column(1), "code": [c.tobytes() for c in codes], "correction": corrections}

        return work

    return map_rows(good, make, "vec_id long, vector array<double>, code binary, correction double")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, safely scaled vectors, their norms): the largest component is made 1 first."""
    safe = vectors / np.abs(vectors).max(axis=1, keepdims=True) if len(vectors) else vectors
    norms = np.sqrt((safe * safe).sum(axis=1))
    return safe / norms[:, None], safe, norms


def search(index: DataFrame, queries: DataFrame, k: int = 5, eps: float = EPS, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine.

    index comes from build_index; queries is a subset of its rows by vec_id
    (one column vec_id). A query's own id is no candidate. Ties go to the
    smaller vec_id. Fewer candidates than k give fewer rows, no queries none.
    Rows that repeat an id are candidates each by itself; as queries they are
    taken once.
    """
    spark = index.sparkSession
    asked = index.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    asked = cut(asked.select("vec_id", "vector"))
    count = asked.count()
    blocks = max(1, -(-count // block))
    # Blocks are cut by a hash of the id, with room to spare, and read one at a time.
    if blocks > 1:
        blocks, index = blocks * 2, cut(index)  # each block reads the index again
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows and b:
            continue
        ids = part["vec_id"].to_numpy()
        vectors = part["vector"].combine_chunks()
        dim = len(part["vector"][0]) if len(ids) else 1
        shared = spark.sparkContext.broadcast((ids, matrix(vectors, dim) if len(ids) else np.zeros((0, 1))))
        best = map_arrow(index, _scan(shared, k, eps, seed), "query_id long, vec_id long, score double")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(shared, k: int, eps: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids, vectors = shared.value
        if not len(ids):
            return
        dim = vectors.shape[1]
        turn = rotation(dim, seed)
        unit, safe, norms = scaled(vectors)
        query = Query(unit, turn)
        top_score = np.full((len(ids), k), -np.inf)
        top_id = np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                vec_id = part.column(0).to_numpy()
                _, c_safe, c_norms = scaled(matrix(part.column(1), dim))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(len(vec_id), -1)
                corrections = part.column(3).to_numpy()
                ones = np.bitwise_count(codes).sum(axis=1)
                error = eps * np.sqrt(np.maximum(1 - corrections**2, 0) / corrections**2 / max(1, dim - 1))
                for q0 in range(0, len(ids), 512):
                    rows = slice(q0, min(q0 + 512, len(ids)))
                    upper = query.estimate(codes, corrections, ones, rows) + error[None, :]
                    upper[ids[rows][:, None] == vec_id[None, :]] = -np.inf
                    _rerank(upper, rows, safe, norms, c_safe, c_norms, vec_id, top_score, top_id, k)
        q, j = np.nonzero(top_score > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(top_id[q, j]), pa.array(top_score[q, j])], names=["query_id", "vec_id", "score"])

    return run


def _rerank(upper, rows, safe, norms, c_safe, c_norms, vec_id, top_score, top_id, k) -> None:
    """Score exactly what may enter the k best, the likeliest first so that the rest is passed over."""
    first = min(k * 4, upper.shape[1])
    likely = np.argpartition(-upper, first - 1, axis=1)[:, :first]
    _take(np.repeat(np.arange(len(upper)), first), likely.ravel(), upper, rows, safe, norms, c_safe, c_norms, vec_id, top_score, top_id, k)
    np.put_along_axis(upper, likely, -np.inf, axis=1)
    q, c = np.nonzero(upper >= top_score[rows][:, -1:])
    _take(q, c, upper, rows, safe, norms, c_safe, c_norms, vec_id, top_score, top_id, k)


def _take(q, c, upper, rows, safe, norms, c_safe, c_norms, vec_id, top_score, top_id, k) -> None:
    use = upper[q, c] > -np.inf
    q, c = q[use], c[use]
    if not len(q):
        return
    score = np.empty(len(q))
    for s in range(0, len(q), 1 << 15):
        a, b = q[s : s + (1 << 15)] + rows.start, c[s : s + (1 << 15)]
        score[s : s + (1 << 15)] = (safe[a] * c_safe[b]).sum(axis=1) / (norms[a] * c_norms[b])
    ids = vec_id[c]
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    begin = np.r_[0, np.nonzero(np.diff(q))[0] + 1, len(q)]
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        at = q[a] + rows.start
        all_score = np.r_[top_score[at], score[a : min(b, a + k)]]
        all_id = np.r_[top_id[at], ids[a : min(b, a + k)]]
        keep = np.lexsort((all_id, -all_score))[:k]
        top_score[at], top_id[at] = all_score[keep], all_id[keep]
