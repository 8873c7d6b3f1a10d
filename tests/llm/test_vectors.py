"""Operators 1 and 7 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweft.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, slot int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, None) for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16)).astype(np.float32)
    x[100:160] = x[5]  # ties
    x[200] = 0
    return x


def odd(rows):
    return [*rows, (9001, None), (9002, []), (9003, [None] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] * 16), (None, [1.0] * 16), (9006, [1.0] * 4)]


def test_exact_topk(spark, points):
    rows = odd(list(enumerate(points)))
    found = topk.exact_topk(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5, tile_rows=64, query_rows=4).collect()
    x = np.floor(256 * points.astype(float)).astype(int)
    for q in range(0, 700, 50):
        best = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == best
    assert {r.query_id for r in found} == set(range(0, 700, 50))


def test_topk_of_few_rows_and_of_none(spark):
    few = frame(spark, [(0, [1, 0]), (1, [2, 0]), (1, [2, 0]), (100, [4, 0])])
    found = topk.exact_topk(few, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 100), (0, 2, 1), (0, 3, 1), (100, 1, 1), (100, 2, 1), (100, 3, 0)]
    assert topk.exact_topk(few.limit(0), F.lit(True)).collect() == []


def test_products_beyond_doubles():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert topk.inner(q, v)[0, 0] == 2**60 + 3


def test_prefix_forest(spark, points):
    rows = odd(list(enumerate(points)))
    found = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20, shard_rows=256).collect()
    x, hits, total = points.astype(float), 0, 0
    for q in (q for q in range(0, 700, 20) if q != 200):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        assert all(r.score == pytest.approx(float(x[r.vec_id] @ x[q]), rel=1e-12) and r.vec_id not in (q, 200) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = sorted((-s, i) for i, s in enumerate(x @ x[q]) if i not in (q, 200))[:20]
        hits += sum(r.score >= -best[-1][0] - 1e-9 for r in mine)
        total += 20
    assert hits / total >= 0.9
    assert not any(r.query_id == 200 or r.query_id > 9000 for r in found)


def test_forest_of_equal_vectors(spark):
    same = frame(spark, [(i, [1.0, 2.0, 3.0]) for i in range(300)])
    found = ann.nearest(same, F.col("vec_id") % 100 == 0, k=4, shard_rows=32).collect()
    assert sorted(r.vec_id for r in found if r.query_id == 0) == [1, 2, 3, 4]
    assert sorted(r.vec_id for r in found if r.query_id == 100) == [0, 1, 2, 3]
    assert ann.nearest(same.limit(0), F.lit(True)).collect() == []


def test_ascent_stops_at_the_longest_prefix_with_enough_matches():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**32, (3, 500), dtype=np.uint32), axis=1)
    level, low, high = ann.ascend(keys, keys[:, :5], 40)
    assert ((high - low).sum(axis=0) >= 40).all()
    for i in range(5):
        bits = int(level[i]) + 1
        match = sum(int(((k >> np.uint32(32 - bits)) == (keys[t, i] >> np.uint32(32 - bits))).sum()) for t, k in enumerate(keys))
        assert match < 40


def test_recall_over_the_whole_table_and_what_is_scored(spark, monkeypatch):
    """All queries of the given table against brute force over all of it; at most a quarter of a shard is scored."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and any(r.embedding) and all(x is not None and np.isfinite(x) for x in r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = np.where(ids == ids[i], -np.inf, x @ x[i])
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits, total = hits + len(best & found[ids[i]]), total + 20
    assert hits / total >= 0.9
    index = ann.forest(ids, x, ann.TREES, 7, 21)
    keys, places = np.frombuffer(index["keys"], "<u4").reshape(ann.TREES, -1), np.frombuffer(index["places"], "<u4").reshape(ann.TREES, -1)
    asked = x[ids % 20 == 0]
    strings = np.stack([ann.hashed(np.hstack([asked, np.zeros((len(asked), 1))]), t, 7) for t in range(ann.TREES)])
    _, low, high = ann.ascend(keys, strings, int(ann.WANT * len(x)))
    scored = [len(ann.candidates(places, low[:, i], high[:, i], len(x), int(ann.SHARE * len(x)))) for i in range(len(asked))]
    assert np.mean(scored) <= 0.25 * len(x)
