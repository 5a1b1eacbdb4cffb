"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Pivot inverted files
hold, for each pivot, the vectors that have it among their first places, and at
which place. A query walks the files of its own first pivots, which adds up the
footrule distance to every vector it meets there (a pivot that one side lacks
counts as the place after the last). Footrule tells the angle; the length of a
vector comes in by a line fitted from footrule to cosine in each block. The
vectors that rank first are reranked by exact inner product. Vectors and queries
meet in blocks; what comes back of a block is each query's nearest, so nothing
grows with the number of candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Pivots (a bounded sample), places posted of a vector and walked of a query, share of a block that is reranked.
PIVOTS, POSTED, WALKED, RERANKED = 512, 40, 40, 0.25
#: Residual deviations that the line from footrule to cosine is raised by.
SPREAD = 1.5
#: Bytes of vectors in a block, and most queries that meet a block in one task.
BLOCK_BYTES, QUERIES = 16 << 20, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows without null, NaN or infinite components that aren't all zero."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)


def dimension(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent dimension (of equally frequent ones the largest) and how many rows have it."""
    row = vectors.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return (row[0], row[1]) if row else (0, 0)


def choose_pivots(vectors: DataFrame, dim: int, pivots: int = PIVOTS) -> np.ndarray:
    """Directions of the vectors with the smallest hashes of vec_id."""
    rows = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).select("embedding").collect()
    if not rows:
        return np.zeros((0, dim))
    found = np.array([r[0] for r in rows], float)
    return np.unique(found / np.maximum(np.abs(found).max(axis=1), 1e-300)[:, None], axis=0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(-1, dim)


def permutations(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector by angle, nearest first."""
    unit = pivots / np.linalg.norm(pivots, axis=1)[:, None]
    return np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :places].astype(np.uint16)


class InvertedFiles:
    """Posting lists of a block: for each pivot the vectors that hold it, and the place they hold it at."""

    def __init__(self, orders: np.ndarray, pivots: int, walked: int):
        self.n, posted = orders.shape
        self.places = max(posted, walked)
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.vector, self.gain = (by // posted).astype(np.int64), (self.places - by % posted).astype(np.float32)
        self.edge = np.searchsorted(flat[by], np.arange(pivots + 1))

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """Half of (a constant minus the footrule distance) of every vector to a query's permutation."""
        lists = [slice(self.edge[p], self.edge[p + 1]) for p in order]
        # both have it, at i and j: |i - j| instead of the two gaps to the place after the last, 2 * min(places - i, places - j) less
        gain = np.concatenate([np.minimum(self.gain[s], self.places - j) for j, s in enumerate(lists)])
        return np.bincount(np.concatenate([self.vector[s] for s in lists]), gain, self.n)


def _cosine_line(files: InvertedFiles, vectors: np.ndarray, norms: np.ndarray, queries: np.ndarray, orders: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of cosine by closeness, over up to 16 queries and all vectors of the block.

    The intercept is raised by ``SPREAD`` residual deviations: a long vector is
    worth a look where its cosine may well be better than its footrule says.
    """
    some = np.linspace(0, len(queries) - 1, min(16, len(queries))).astype(int)
    x = np.concatenate([files.closeness(orders[i]) for i in some])
    y = np.concatenate([vectors @ (queries[i] / np.linalg.norm(queries[i])) / norms for i in some])
    spread = float(x.var())
    slope = max(float(((x - x.mean()) * (y - y.mean())).mean() / spread), 1e-9) if spread > 0 else 1e-9
    rest = y - slope * x
    return float(rest.mean() + SPREAD * rest.std()), slope


def _search_block(pivots: int, dim: int, k: int, walked: int, reranked: float):
    def run(vectors, queries):
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            vectors, queries = vectors.sort_by([("vec_id", "ascending")]), queries.sort_by([("vec_id", "ascending")])
            ids, matrix = np.asarray(vectors["vec_id"]), _matrix(vectors["embedding"], dim)
            # equal vectors are one entry; only the first k + 1 ids of each can be among a query's k nearest
            _, lead, number = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
            number = number.ravel()
            by = np.argsort(number, kind="stable")
            edge = np.searchsorted(number[by], np.arange(len(lead) + 1))
            distinct, norms = matrix[lead], np.linalg.norm(matrix[lead], axis=1)
            files = InvertedFiles(np.stack([np.frombuffer(x.as_py(), np.uint16) for x in vectors["places"].take(pa.array(lead))]), pivots, walked)
            m = min(len(lead), max(20 * k, math.ceil(reranked * len(lead))))
            asking, orders = _matrix(queries["embedding"], dim), [np.frombuffer(x, np.uint16) for x in queries["places"].to_pylist()]
            level, slope = _cosine_line(files, distinct, norms, asking, orders)
            for q, e, o in zip(np.asarray(queries["vec_id"]), asking, orders, strict=True):
                near = np.arange(len(lead))
                if m < len(lead):
                    close = norms * (level + slope * files.closeness(o))
                    near = np.flatnonzero(close >= np.partition(close, len(lead) - m)[len(lead) - m])  # ties with the last come along
                score = distinct[near] @ e
                slack = 1e-10 * np.linalg.norm(e) * norms[near].max()  # beyond what rounding of a product can be
                floor = np.partition(score, -(k + 1))[-(k + 1)] - slack if len(score) > k + 1 else -np.inf
                found = []
                for i in near[score >= floor]:
                    exact = math.fsum(distinct[i] * e)
                    found += [(-exact, int(v)) for v in ids[by[edge[i] : edge[i + 1]][: k + 1]] if v != q]
                for s, v in sorted(set(found))[:k]:
                    out["query_id"].append(int(q))
                    out["vec_id"].append(v)
                    out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, posted: int = POSTED, walked: int = WALKED, reranked: float = RERANKED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest by inner product found for each row of ``queries``.

    Both take vec_id and embedding (other columns are left out); a row of
    ``vectors`` with the query's own vec_id is no candidate; ties go to the
    smaller vec_id. Rows whose vector is null, zero, of another dimension than
    most vectors or holds a null or non-finite component, or whose vec_id is
    null, take no part. Repeated rows count once; of several vectors of one
    vec_id the nearest counts, on either side. Empty tables give no rows. The
    pivots are the only thing taken from a sample; every vector is indexed.
    """
    vectors, queries = usable(vectors), usable(queries)
    dim, n = dimension(vectors)
    chosen = choose_pivots(vectors, dim, pivots)
    count = len(chosen)
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def permute(places):
        def run(batches):
            for batch in batches:
                m = _matrix(batch.column("embedding"), dim)
                orders = permutations(m, shared.value, places) if len(m) else np.zeros((0, 0), np.uint16)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.tobytes() for o in orders], pa.binary())], names=[*batch.schema.names, "places"])

        return run

    def indexed(df: DataFrame, places: int, part, copies: int, other: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)
        return df.where(F.size("embedding") == dim).mapInArrow(permute(places), "vec_id long, embedding array<double>, places binary").select("*", part, each)

    n_v = max(1, math.ceil(n * dim * 8 / block_bytes))
    n_q = max(1, math.ceil(queries.count() / QUERIES))
    left = indexed(vectors, posted, F.pmod(F.xxhash64("vec_id"), F.lit(n_v)).cast("int").alias("v"), n_q, "q")
    right = indexed(queries, walked, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_q)).cast("int").alias("q"), n_v, "v")
    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_search_block(count, dim, k, walked, reranked), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int = 20) -> list[int]:
    """Exact answer for one query, to measure recall on small tables."""
    score = [(-math.fsum(v * query), int(i)) for v, i in zip(vectors, ids, strict=True) if i != own]
    return [i for _, i in sorted(score)[:k]]
