"""Nearest neighbours of a stated query set by a block matrix join.

Queries and candidates are dealt into blocks; a tile holds one block of each. The product of the int8 forms of a
tile gives every cosine up to an error bound; only pairs that can still be among a query's nearest are computed again
in double precision, and heaps merge a tile's parts before a ranked window merges the tiles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.shared import written

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024


def usable(vector: str = "embedding") -> Column:
    """True for a vector whose squared length in double precision is finite and above zero; null components make it unusable."""
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.coalesce((square > 0) & (square < float("inf")) & ~F.isnan(square), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale of each row, length of each row's rounding error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(unit - small * scale[:, None], axis=1)


def tile_cosines(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(approximate cosines, error bounds) of all pairs. Sums of int8 products are whole numbers that the chosen float type holds exactly."""
    (a, scale_a, error_a), (b, scale_b, error_b) = left, right
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    # u.v - u'.v' = u.(v - v') + (u - u').v' for unit vectors u, v and their rounded forms u', v'
    return product * scale_a[:, None] * scale_b, error_b + error_a[:, None] * (1 + error_b) + 1e-9


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows in double precision, summed in component order."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        left += a[:, k] * a[:, k]
        right += b[:, k] * b[:, k]
    with np.errstate(over="ignore", under="ignore"):
        length = np.sqrt(left * right)
    length = np.where((length > 0) & np.isfinite(length), length, np.sqrt(left) * np.sqrt(right))
    return np.clip(dot / length, -1.0, 1.0)


def _tile(k: int):
    def nearest(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids, names = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            c, q = (np.array(frame["embedding"].tolist(), np.float64) for frame in (candidates, queries))
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            unit = lambda x: (x / np.abs(x).max(axis=1, keepdims=True)) / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True)
            right = quantised(unit(c))
            for start in range(0, len(q), 256):
                part, own = q[start : start + 256], names[start : start + 256]
                near, bound = tile_cosines(quantised(unit(part)), right)
                near[own[:, None] == ids] = -np.inf
                low = np.maximum.reduceat(near - bound, firsts, axis=1)  # an id that repeats counts once
                least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
                rows, columns = np.nonzero((near + bound >= least[:, None]) & (near > -np.inf))
                scores = np.concatenate([exact_cosines(part[rows[s : s + 65536]], c[columns[s : s + 65536]]) for s in range(0, len(rows), 65536)] or [np.empty(0)])
                best: dict[int, dict[int, float]] = {}
                for row, vec_id, score in zip(rows.tolist(), ids[columns].tolist(), scores.tolist()):
                    found = best.setdefault(row, {})
                    found[vec_id] = max(score, found.get(vec_id, -2.0))
                for row, found in best.items():
                    out += [(int(own[row]), i, s) for i, s in heapq.nsmallest(k, found.items(), key=lambda x: (-x[1], x[0]))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return nearest


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of largest cosine for every row of ``vectors`` where ``queries`` holds.

    Candidates are all rows (vec_id, embedding) with another id. Null, zero and non-finite vectors, vectors with a null
    component and rows with a null id take no part; only vectors of equal length are compared. Ties go to the smaller id; an
    id that repeats is answered and named once, by its nearest vector. Fewer than ``k`` candidates: all of them. An empty
    table gives no rows. Blocks are dealt by hash, so no id or value makes one tile larger than the others.
    """
    known = vectors.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"), queries.alias("asked"),
    )
    known = written(known, "ann-vectors")
    asked = known.where("asked")
    blocks, wanted = (max(1, -(-df.count() // size)) for df, size in ((known, CANDIDATES_PER_BLOCK), (asked, QUERIES_PER_BLOCK)))
    place = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "embedding", "dim", place(wanted, "query").alias("qb"), every(blocks).alias("cb"))
    right = known.select("vec_id", "embedding", "dim", place(blocks, "candidate").alias("cb"), every(wanted).alias("qb"))
    tiles = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb"))
    found = tiles.applyInPandas(_tile(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`nearest`."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
