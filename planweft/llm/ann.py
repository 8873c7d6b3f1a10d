"""Operator 7: approximate nearest neighbours by a hash-prefix forest.

Each shard holds, per tree, a sorted array of long hash strings (32 sign bits of
random projections). A query descends in every tree to its longest prefix match
by binary search, then all trees ascend together, one bit at a time, until the
matches of the common prefix length, over all trees, reach ``want`` times the shard's
distinct vectors. Vectors are ranked by the number of trees in which they match, and only
the best ``share`` of the shard is scored exactly. Equal vectors are one entry of the forest that lists its
smallest ids, so a vector repeated a million times costs one candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweft.llm import vectors
from planweft.llm.shared import only, tidy

BITS = 32
TREES = 96
#: Matches over all trees that end the ascent, and the part of a shard that is scored, both times its distinct vectors.
WANT, SHARE = 4.0, 0.2
INDEX_SCHEMA = "slot int, dim int, n int, ids binary, data binary, first binary, keys binary, places binary, longest double"


def planes(dim: int, tree: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, dim]).standard_normal((dim + 1, BITS))


def hashed(data: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """32-bit strings; the first bit of the string is the highest bit."""
    signs = (data @ planes(data.shape[1] - 1, tree, seed)) > 0
    return np.packbits(signs, axis=1).view(">u4").ravel().astype(np.uint32)


def lifted(data: np.ndarray, longest: float) -> np.ndarray:
    """One more component brings all vectors to one length, so the largest inner product is the smallest angle."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (data**2).sum(axis=1)))
    return np.hstack([data, rest[:, None]])


def forest(ids: np.ndarray, data: np.ndarray, trees: int, seed: int, keep: int) -> dict:
    """The index of one shard. ``first`` has where each distinct vector's ids begin; The ``keep`` - 1 rows of smallest id stay of each, whichever id is left out."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    distinct, inverse = np.unique(data, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[by], np.arange(len(distinct) + 1))
    rank = np.arange(len(by)) - starts[inverse[by]]
    # a row stays if it can be among the first keep - 1 once the rows of any one smaller id are left out
    own, group = ids[by], inverse[by]
    begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])]))
    lengths = np.diff(np.append(begins, len(by)))
    base = group[begins] * (len(by) + 1)
    longest_before = np.maximum(np.concatenate([[0], np.maximum.accumulate(base + lengths)[:-1]]) - base, 0)
    by = by[rank - np.repeat(longest_before, lengths) < keep - 1]
    first = np.searchsorted(inverse[by], np.arange(len(distinct) + 1))
    longest = float(np.sqrt((distinct**2).sum(axis=1).max(initial=0.0)))
    raised = lifted(distinct, longest)
    keys = [hashed(raised, t, seed) for t in range(trees)]
    places = [np.argsort(x, kind="stable").astype(np.uint32) for x in keys]
    return {
        "dim": distinct.shape[1], "n": len(distinct), "ids": ids[by].tobytes(), "data": distinct.tobytes(), "first": first.astype(np.int64).tobytes(), "longest": longest,
        "keys": np.concatenate([x[p] for x, p in zip(keys, places, strict=True)]).tobytes(), "places": np.concatenate(places).tobytes(),
    }


def build_index(df: DataFrame, n_slots: int, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, seed: int = 7, shard_rows: int = 8192, keep: int = 21) -> DataFrame:
    """One row per shard of about ``shard_rows`` rows, whatever the partitions of ``df``: every valid row is indexed."""

    def build(batches):
        kinds = pa.schema([("slot", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("first", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("longest", pa.float64())])
        last, held = None, []

        def shard():
            ids, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if len(ids):
                yield pa.RecordBatch.from_pylist([{"slot": last[0]} | forest(ids, data, trees, seed, keep)], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if held and ((row["slot"], row["dim"]) != last or sum(len(x) for x, _ in held) + row["n"] > shard_rows):
                    yield from shard()
                last = row["slot"], row["dim"]
                ids, data = vectors.unpack(row)
                whole = (data != 0).any(axis=1)
                held.append((ids[whole], data[whole]))
        if held:
            yield from shard()

    dealt = vectors.tiles(df, id_col, vec_col, shard_rows).withColumn("slot", vectors.slot_of("tile", n_slots))
    return dealt.repartition(n_slots, "slot").sortWithinPartitions("slot", "dim", "tile").mapInArrow(tidy(build), INDEX_SCHEMA)


def ascend(keys: np.ndarray, strings: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix length that each query stops at, and the matching ranges (trees x queries) there.

    keys: trees x n sorted; strings: trees x queries.
    """
    trees, n = keys.shape
    asked = strings.shape[1]
    low, high = np.zeros((trees, asked), np.int64), np.full((trees, asked), n, np.int64)
    level = np.zeros(asked, np.int64)
    open_ = np.arange(asked)
    for bits in range(1, BITS + 1):  # descend while the common prefix still has enough matches in all trees together
        mask = np.uint32(((1 << bits) - 1) << (BITS - bits))
        rest = np.uint32((1 << (BITS - bits)) - 1)
        lo = np.stack([np.searchsorted(keys[t], strings[t, open_] & mask, "left") for t in range(trees)])
        hi = np.stack([np.searchsorted(keys[t], (strings[t, open_] & mask) | rest, "right") for t in range(trees)])
        enough = (hi - lo).sum(axis=0) >= want
        open_ = open_[enough]
        low[:, open_], high[:, open_], level[open_] = lo[:, enough], hi[:, enough], bits
        if not len(open_):
            break
    return level, low, high


def candidates(places: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, most: int) -> np.ndarray:
    """The ``most`` vectors of a shard that match in most trees (more where the last ones are equal in that), in place order."""
    votes = np.bincount(np.concatenate([p[a:b] for p, a, b in zip(places, low, high, strict=True)]), minlength=n)
    if most >= n:
        return np.flatnonzero(votes)
    return np.flatnonzero(votes >= max(1, np.partition(votes, n - most)[n - most]))


def search(df: DataFrame, index: DataFrame, is_query: Column, n_slots: int, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, seed: int = 7, share: float = SHARE, want: float = WANT, query_rows: int = 1024) -> DataFrame:
    """The k nearest found for each query row, by exact inner product in double precision."""
    queries = vectors.tiles(df.where(is_query), id_col, vec_col, query_rows)

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], "<f8").reshape(row["n"], row["dim"])
                ids, first = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")
                keys = np.frombuffer(row["keys"], "<u4").reshape(trees, -1)
                places = np.frombuffer(row["places"], "<u4").reshape(trees, -1)
                asked, qdata = vectors.unpack(row, "q_")
                whole = np.flatnonzero((qdata != 0).any(axis=1))
                asked, qdata = asked[whole], qdata[whole]
                if not len(asked):
                    continue
                raised = np.hstack([qdata, np.zeros((len(qdata), 1))])
                strings = np.stack([hashed(raised, t, seed) for t in range(trees)])
                _, low, high = ascend(keys, strings, max(k + 1, math.ceil(want * row["n"])))
                most = max(4 * (k + 1), math.ceil(share * row["n"]))
                out = []
                for i, q in enumerate(asked):
                    near = candidates(places, low[:, i], high[:, i], row["n"], most)
                    if not len(near):
                        continue
                    others = np.concatenate([[0], np.cumsum(ids != q)])
                    near = near[others[first[near + 1]] > others[first[near]]]  # vectors that rows of other ids have
                    if not len(near):
                        continue
                    scores = np.einsum("ij,j->i", data[near], qdata[i])
                    if len(near) > k:  # no more than the k best vectors can give the k best rows, but for ties
                        near_floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                        near, scores = near[scores >= near_floor], scores[scores >= near_floor]
                    counts = first[near + 1] - first[near]
                    at = np.repeat(first[near] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                    hits, points = ids[at], np.repeat(scores, counts)
                    other = hits != q
                    hits, points = hits[other], points[other]
                    top = np.lexsort((hits, -points))[:k]
                    out.append((np.full(len(top), q), hits[top], points[top]))
                if out:
                    qs, vs, ss = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(np.full(len(qs), row["slot"]), pa.int32()), pa.array(vs, pa.int64()), pa.array(ss, pa.float64())], names=["query_id", "slot", "vec_id", "score"])

    found = vectors.meet(index, queries, n_slots).mapInArrow(tidy(look), "query_id long, slot int, vec_id long, score double")
    return vectors.merge_top(found, k, n_slots)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, seed: int = 7, share: float = SHARE, want: float = WANT, shard_rows: int = 8192) -> DataFrame:
    """Index ``df`` and search it for its own query rows.

    Returns ``query_id long, rank int, vec_id long, score double``. Null, zero,
    empty, null-holding and non-finite vectors, and rows with a null id, take no
    part. A query isn't its own candidate, ties go to the smaller id, repeated
    vectors all count. Vectors of another dimension are no candidates. Other
    columns are ignored; an empty table gives no rows. ``want`` sets how many
    matches the ascent gathers in each shard and ``share`` how much of it is scored (four times ``k`` at
    least), both in proportion to its distinct vectors.
    """
    asked = df.where(is_query)
    rows, asked = (only(x, vec_id=id_col, vector=vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), "vector") for x in (df, asked))
    n_slots = vectors.slots(rows.count(), shard_rows)
    index = build_index(rows, n_slots, "vec_id", "vector", trees, seed, shard_rows, k + 1)
    return search(asked, index, F.lit(True), n_slots, k, "vec_id", "vector", trees, seed, share, want)
