"""Operator 1: exact top-k search by tiled matrix products.

Queries and shards are packed into tiles; each task multiplies one query tile
with one shard tile, keeps the k best of each query in that tile, and the
per-query lists are merged as a tree. Nothing but k entries per query and tile
leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweft.llm import vectors
from planweft.llm.shared import only, tidy

EXACT = float(2**53)


def quantised(data: np.ndarray) -> np.ndarray:
    """floor(256 * x) in double precision."""
    return np.floor(256.0 * data)


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; exact beyond 2**53 too, then by Python's integers, cut to the range of a long."""
    top = (np.abs(q).max(initial=0.0)) * (np.abs(v).max(initial=0.0)) * q.shape[1]
    if top < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    product = whole(q).astype(object) @ whole(v).astype(object).T
    return np.clip(product, -(2**63), 2**63 - 1).astype(np.int64)


def best_in_tile(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, highest score first, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def exact_topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """The k rows of highest integer inner product for every query row.

    Returns ``query_id long, rank int, vec_id long, score long``. A query isn't
    its own candidate; rows that share its id under another row are not either.
    Null, empty, null-holding and non-finite vectors take no part, nor do rows
    with a null id. Vectors of another dimension than the query's are no
    candidates. Repeated rows each count. Other columns are ignored. An empty
    table gives no rows.
    """
    asked = df.where(is_query)
    rows, asked = (only(x, vec_id=id_col, vector=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), "vector") for x in (df, asked))
    total = rows.count()
    n_slots = vectors.slots(total, tile_rows)
    shards = vectors.tiles(rows, "vec_id", "vector", tile_rows)
    queries = vectors.tiles(asked, "vec_id", "vector", query_rows)

    def multiply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, data = vectors.unpack(row)
                asked, qdata = vectors.unpack(row, "q_")
                data, qdata = quantised(data), quantised(qdata)
                out = []
                for at in range(0, len(asked), 256):  # bounds the product held at once
                    scores = inner(qdata[at : at + 256], data)
                    for i, q in enumerate(asked[at : at + 256]):
                        others = scores[i]
                        best = best_in_tile(others, ids, k + int(np.count_nonzero(ids == q)))
                        best = best[ids[best] != q][:k]
                        out.append((np.full(len(best), q), ids[best], others[best]))
                if out:
                    qs, vs, ss = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(np.full(len(qs), row["slot"]), pa.int32()), pa.array(vs, pa.int64()), pa.array(ss, pa.int64())], names=["query_id", "slot", "vec_id", "score"])

    found = vectors.meet(shards, queries, n_slots).mapInArrow(tidy(multiply), "query_id long, slot int, vec_id long, score long")
    return vectors.merge_top(found, k, n_slots)
