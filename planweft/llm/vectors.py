"""Packing of vector columns into tiles, for the two vector searches.

A tile is one row: the ids and the matrix of up to ``tile_rows`` vectors of one
dimension, as little-endian blobs. Vectors that are null, empty, or hold null or
non-finite components, and rows with a null id, are in no tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweft.llm.shared import tidy

TILE_SCHEMA = "tile string, dim int, n int, ids binary, data binary"


def usable(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, float64 matrix) of each dimension among the valid vectors of a batch."""
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = (lengths > 0) & (bad[ends] == bad[ends - lengths]) & ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(lengths[keep]):
        rows = np.flatnonzero(keep & (lengths == dim))
        yield numbers[rows], values[(ends - lengths)[rows, None] + np.arange(dim)]


def tiles(df: DataFrame, id_col: str, vec_col: str, tile_rows: int) -> DataFrame:
    """Pack the vectors of ``df`` where they are: no shuffle."""

    def pack(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}

        def row(dim, ids, data):
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist(
                [{"tile": f"{task}-{made}", "dim": dim, "n": len(ids), "ids": ids.tobytes(), "data": data.tobytes()}],
                schema=pa.schema([("tile", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]),
            )

        for batch in batches:
            for ids, data in usable(batch.column(0), batch.column(1)):
                dim = data.shape[1]
                if dim in held:
                    ids, data = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], data])
                while len(ids) >= tile_rows:
                    yield row(dim, ids[:tile_rows], data[:tile_rows])
                    ids, data = ids[tile_rows:], data[tile_rows:]
                held[dim] = ids, data
        for dim, (ids, data) in held.items():
            if len(ids):
                yield row(dim, ids, data)

    return df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(tidy(pack), TILE_SCHEMA)


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}data"], "<f8").reshape(row[f"{prefix}n"], row[f"{prefix}dim"])


def slots(total_rows: int, tile_rows: int) -> int:
    """How many slots the shard tiles are dealt to; each query tile visits each slot."""
    return max(1, math.ceil(total_rows / tile_rows))


def slot_of(tile: str, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(tile), F.lit(n_slots)).cast("int")


def meet(shards: DataFrame, queries: DataFrame, n_slots: int) -> DataFrame:
    """Rows of a shard tile beside a query tile: the blocks of a stated query set against all rows.

    Shard tiles stay whole and are dealt to slots; the query tiles are sent to
    every slot, so a task holds one tile of each side whatever the table sizes.
    """
    dealt = shards if "slot" in shards.columns else shards.withColumn("slot", slot_of("tile", n_slots))
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns), F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("q_slot"))
    return dealt.hint("merge").join(asked, (F.col("slot") == F.col("q_slot")) & (F.col("dim") == F.col("q_dim")))


def merge_top(found: DataFrame, k: int, n_slots: int, fan_in: int = 32) -> DataFrame:
    """Tree-merge per-tile top lists ``(query_id, slot, score, vec_id)`` to the k best of each query.

    Each round merges the lists of at most ``fan_in`` slots, so no group holds
    more than ``fan_in * k`` entries times the tiles of a slot. Ties go to the smaller vec_id.
    """
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k)
    while True:
        n_slots = math.ceil(n_slots / fan_in)
        found = found.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int"))
        lists = found.groupBy("query_id", "slot").agg(best.alias("best"))
        found = lists.select("query_id", "slot", F.posexplode("best").alias("pos", "hit")).select(
            "query_id", "slot", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
        )
        if n_slots == 1:
            return found.select("query_id", "rank", "vec_id", "score")
