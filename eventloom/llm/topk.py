"""Exact top-k by inner product: branch and bound over vectors laid out by dimension.

Candidates lie in shards, dimension by dimension. For a query, scores grow block
of dimensions by block of dimensions; after each block, candidates whose score
so far plus the most that the remaining dimensions can add (Cauchy-Schwarz on
the remaining norms) stays below the k-th best known score are dropped, and the
survivors are moved together. Every query block meets every shard in a task of
its own; only the k best of each leave it.

Vectors that are null or hold null or non-finite components take no part.
Components that a shorter vector lacks count as 0. Every row is a candidate and,
if it asks, a query of its own, whether or not others have its id or its vector;
only the query's own row is left out. Ties go to the smaller vec_id. Rows with
a null id take no part; an empty table has no results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Components in a shard of candidates and in a block of queries: 4 million take 32 MB.
SHARD_CELLS = 1 << 18
QUERY_CELLS = 1 << 17
DIM_BLOCK = 16


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, null for vectors that take no part."""
    cells = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(cells, lambda x: F.floor(x * 256.0).cast("bigint")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of(queries: np.ndarray, asked_by: np.ndarray, cands: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple]:
    """(query row, id, score) of the k best candidates of each query, ties to the smaller id; its own row is none."""
    width = cands.shape[1]
    top = max(int(np.abs(queries).max(initial=0)), int(np.abs(cands).max(initial=0)))
    exact = top * top * max(width, 1) < 1 << 53
    kind = np.float64 if exact else object  # beyond 2 ** 53 with Python's whole numbers
    # Long vectors first: the best known scores rise early.
    norms = np.sqrt((cands.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norms))
    ids, rows, columns = ids[order], rows[order], np.ascontiguousarray(cands[order].T).astype(kind)
    blocks = [slice(at, min(at + DIM_BLOCK, width)) for at in range(0, width, DIM_BLOCK)]
    left = lambda m, axis: [np.sqrt((m.astype(np.float64)[b.stop :] ** 2).sum(axis=axis)) for b in blocks]
    rest, out = left(columns, 0), []
    for query, own in zip(queries, asked_by, strict=True):
        q = query.astype(kind)
        q_rest = left(q, 0)
        alive = np.flatnonzero(rows != own)
        score = np.zeros(len(alive), kind)
        floor = -np.inf
        for n, b in enumerate(blocks):
            score = score + q[b] @ (columns[b] if len(alive) == len(ids) else columns[b, alive])
            bound = score.astype(np.float64) + q_rest[n] * rest[n][alive] * (1 + 1e-9) + 1e-3
            if n == 0 and len(alive) > k:
                # The exact scores of the most promising ones give a first floor.
                probe = alive[np.argpartition(-score.astype(np.float64), k - 1)[: 4 * k]]
                floor = float(np.sort((q @ columns[:, probe]).astype(np.float64))[-k:][0])
            keep = bound >= floor * (1 - 1e-12 * np.sign(floor)) if np.isfinite(floor) else slice(None)
            alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k] if exact else sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k]
        out += [(own, ids[alive[i]], int(score[i])) for i in best]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k best other vectors."""
    sound = vectors.select(F.col(vec_id).alias("id"), quantised(F.col(vector)).alias("cells"), is_query.alias("asks")).where(
        "id IS NOT NULL AND cells IS NOT NULL"
    )
    # Written, the rows keep their numbers.
    sound = written(sound.withColumn("row", F.monotonically_increasing_id()))
    n, n_asks, width = sound.agg(F.count("id"), F.count_if("asks"), F.max(F.size("cells"))).head()
    width = max(width or 0, 1)
    shards = max(1, -(-n * width // SHARD_CELLS))
    blocks = max(1, -(-n_asks * width // QUERY_CELLS))
    part = lambda many: F.pmod(F.xxhash64("row"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    asks = sound.where("asks").select("row", "cells", part(blocks).alias("block"), every(shards).alias("shard"))
    cands = sound.select("id", "row", "cells", part(shards).alias("shard"), every(blocks).alias("block"))

    def meet(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        rows = best_of(_matrix(queries["cells"], width), queries["row"].to_numpy(),
                       _matrix(others["cells"], width), others["id"].to_numpy(), others["row"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["row", "vec_id", "score"])

    met = asks.groupBy("block", "shard").cogroup(cands.groupBy("block", "shard"))
    found = met.applyInPandas(meet, "row bigint, vec_id bigint, score bigint")
    ranked = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    names = sound.where("asks").select("row", F.col("id").alias("query_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).join(names, "row").select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
