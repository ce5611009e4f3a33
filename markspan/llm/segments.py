"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 4, 8 and 16 segments. With the mean m and deviation s of each segment of length L, the distance of two
vectors is at least the root of the sum of L ((m - m')^2 + (s - s')^2), and so their inner product at most the sum of
L (m m' + s s'). Candidates whose bound stays below the k-th best score known are dropped, coarse level first; the others get
their exact score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 8, 16)
BLOCK, QUERY_BLOCK = 4096, 2048  # rows of a block, on average
EXACT = float(1 << 53)  # up to here doubles hold every whole number

FOUND = "query_id long, vec_id long, score long"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(64 x) of each component, as double."""
    return np.floor(64.0 * vectors.astype(np.float64))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row the weighted means and deviations of its segments; their inner product bounds that of the rows."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    means = np.stack([x[:, p].mean(axis=1) for p in parts], axis=1)
    spreads = np.stack([x[:, p].std(axis=1) for p in parts], axis=1)
    weights = np.sqrt([len(p) for p in parts])
    return np.hstack([means * weights, spreads * weights])


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k highest scores of each query among `rows`, smaller ids first among equals; a query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    width = rows.shape[1]
    top = (np.abs(rows).max(initial=0.0) + 1) * (np.abs(queries).max(initial=0.0) + 1) * max(1, width)
    whole = top < EXACT
    levels = [(segment_features(queries, n), segment_features(rows, n)) for n in LEVELS] if whole and width else []
    if not whole:
        rows, queries = _python_ints(rows), _python_ints(queries)
    out: tuple[list, list, list] = ([], [], [])
    step = 256
    for begin in range(0, len(queries), step):
        coarse = levels[0][0][begin : begin + step] @ levels[0][1].T if levels else None
        for j in range(begin, min(begin + step, len(queries))):
            left = np.flatnonzero(ids != query_ids[j])
            if levels and len(left) > 4 * k:
                bounds = coarse[j - begin, left]
                # The k-th best exact score among the most promising candidates is a floor for the k-th best of all.
                first = left[np.argpartition(bounds, -2 * k)[-2 * k :]]
                floor = np.partition(rows[first] @ queries[j], -k)[-k]
                slack = 1e-9 * top + 1e-6
                left = left[bounds >= floor - slack]
                for theirs, mine in levels[1:]:
                    left = left[mine[left] @ theirs[j] >= floor - slack]
            scores = rows[left] @ queries[j]
            picked = left[np.argsort(-scores, kind="stable")[:k]] if whole else left[sorted(range(len(left)), key=lambda i: -scores[i])[:k]]
            out[0].extend([int(query_ids[j])] * len(picked))
            out[1].extend(ids[picked].tolist())
            out[2].extend(_long(v) for v in (rows[picked] @ queries[j]).tolist())
    return out


def _python_ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _long(v: float) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(v)))


def _matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled vectors."""
    flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return part.column("vec_id").to_numpy(), scaled(flat.reshape(part.num_rows, -1))


def _meet(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            ids, x = _matrix(rows)
            query_ids, q = _matrix(queries)
            found = best(q, query_ids, x, ids, k)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def top_scores(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, the k highest integer
    inner products with the other rows of as many components; fewer if there are fewer.

    Rows without id, without vector, or with null or non-finite components take no part. Rows that repeat an id are candidates each;
    as queries they share one list, the best of all their scores. Scores beyond a long are cut to its range. Empty input gives no rows.

    Ids are hashed into blocks of bounded size; every pair of a query block and a block of rows is one group, so that no
    id or value can crowd a task, and each group returns k rows per query."""
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(sound & finite).withColumn("width", F.size("v"))
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n, m = (max(1, int(x)) for x in rows.agg(F.count(F.lit(1)), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first())
    blocks, query_blocks = -(-n // BLOCK), -(-m // QUERY_BLOCK)

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other)
        return df.select("vec_id", "v", "width", number, each)

    groups = ["width", "block", "query_block"]
    right = dealt(rows, "block", blocks, "query_block", query_blocks).groupBy(*groups)
    left = dealt(queries, "query_block", query_blocks, "block", blocks).groupBy(*groups)
    found = right.cogroup(left).applyInArrow(_meet(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
