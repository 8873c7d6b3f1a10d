"""Operators over tables whose ids repeat."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweft.llm import ann


def test_forest_of_repeated_ids(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same)] * 30 + [(i, same) for i in range(5, 12)] + [(8, same)] * 9
    rows += [(7, [2.0 + i, 3.0, 4.0]) for i in range(12)]  # one id, many vectors, all nearer
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(df.where("vec_id <> 7"), F.col("vec_id").isin(0, 5, 8), k=4, shard_rows=64).collect()
    wanted = {0: [5] * 4, 5: [0] * 4, 8: [0] * 4}  # as in the SQL of operator 1, each row of a query's id brings its own hits
    assert {q: sorted(r.vec_id for r in found if r.query_id == q) for q in wanted} == wanted
    found = ann.nearest(df, F.col("vec_id") == 7, k=4, shard_rows=64).collect()
    assert found and {r.vec_id for r in found} == {0}


@pytest.mark.parametrize("seed", range(20))
def test_kept_rows_of_equal_vectors(seed):
    r = np.random.default_rng(seed)
    ids, data, k = r.integers(0, 6, 60), r.integers(0, 2, (60, 1)) + 1.0, 3
    index = ann.forest(ids, data, 2, 7, k + 1)
    kept, first = np.frombuffer(index["ids"], "<i8"), np.frombuffer(index["first"], "<i8")
    for v, x in enumerate(np.unique(data)):
        for q in range(7):
            mine = kept[first[v] : first[v + 1]]
            assert mine[mine != q][:k].tolist() == sorted(i for i, d in zip(ids, data[:, 0], strict=True) if d == x and i != q)[:k]
