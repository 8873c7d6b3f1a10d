"""Operator 9 and its parts against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from planweft.llm import graph, jaccard, shingles

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, k):
    w = SPLIT.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent):
    """{row number: component} by comparing all pairs."""
    sets = [grams(t, k) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                parent[find(a)] = find(b)
    groups: dict[int, list[int]] = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(x)
    return {x: min(rows[y][0] for y in g) if rows[x][0] is not None else None for g in groups.values() for x in g}


def test_shingle_sets():
    r, old = random.Random(1), shingles.BLOCK
    try:
        shingles.BLOCK = 50
        for _ in range(150):
            texts = ["".join(r.choice("aAbBé \n\t\x0b") for _ in range(r.randint(0, r.choice([3, 30, 9000])))) if r.random() > 0.1 else None for _ in range(5)]
            found, wanted = shingles.sets_of(pa.array(texts, pa.string()), 4), [grams(t, 4) for t in texts]
            assert [len(x) for x in found] == [len(x) for x in wanted]
            assert all(len(set(found[i]) & set(found[j])) == len(wanted[i] & wanted[j]) for i in range(5) for j in range(i))
    finally:
        shingles.BLOCK = old


def test_hashing_sorts_once(monkeypatch):
    """Sets and orders are those of np.unique and a stable argsort, without either, and blocks share their powers."""
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        x, key = r.integers(0, 700, n, dtype=np.uint64) << np.uint64(54), r.integers(0, 50, n).astype(np.uint32) * np.uint32(85_000_000)
        assert shingles.distinct(x).tolist() == sorted(set(x.tolist()))
        assert jaccard.stable_order(key).tolist() == sorted(range(n), key=lambda i: key[i])
        assert jaccard.stable_order((key >> 1).astype(np.int32)).tolist() == sorted(range(n), key=lambda i: key[i])
    assert shingles.powers_of(shingles.BASE, 9) is not None and np.shares_memory(shingles.powers_of(shingles.BASE, 9), shingles.powers_of(shingles.BASE, 5000))
    long = shingles.powers_of(shingles.BASE, shingles.KEPT + 3)
    assert (long[: shingles.KEPT] == shingles.powers_of(shingles.BASE, shingles.KEPT)).all() and int(long[-1]) == pow(int(shingles.BASE), shingles.KEPT + 2, 2**64)
    monkeypatch.setattr(np, "unique", None)
    monkeypatch.setattr(np, "argsort", None)
    words = "a b c d e f a b c d"
    assert [len(x) for x in shingles.sets_of(pa.array([words, "", None, f"{words} " * 40_000]), 4)] == [len(grams(words, 4)), 0, 0, len(grams(f"{words} " * 3, 4))]
    dealer = jaccard.Dealer(3, ["doc"])
    assert not list(dealer.add(np.array([2, 0, 2, 0], np.int32), np.array([5, 6, 7, 8])))
    (made,) = dealer.flush()
    assert [np.frombuffer(x, np.int64).tolist() for x in made.column(1).to_pylist()] == [[6, 8], [5, 7]]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_components(spark, k, percent):
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    hot = " ".join(r.choice(vocabulary) for _ in range(12))  # a line that many texts share
    rows = []
    for family in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 12])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(words) + (" " + hot if family % 2 else "")))
    rows += [(900 + i, hot + " " + " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 60])))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "one two"), (2006, "two one")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, n int").repartition(5)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_join(df, k, percent).collect()}
    wanted = brute(rows, k, percent)
    assert found == {rows[x][0]: (len(grams(rows[x][1], k)), c) for x, c in wanted.items()}
    left = sorted(x.doc_id for x in jaccard.one_of_each(df, k, percent).collect())
    assert left == sorted(rows[x][0] for x, c in wanted.items() if c == rows[x][0])


def test_odd_rows(spark, odd_documents, no_documents):
    rows = jaccard.jaccard_join(odd_documents, 4, 85).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[2] == 1 and by_id[12] == 1 and by_id[3] == 3 and by_id[None] is None and by_id[7] == 7
    assert jaccard.jaccard_join(no_documents).collect() == []
    assert jaccard.one_of_each(no_documents).columns == no_documents.columns


def test_a_large_group_in_small_blocks(spark, monkeypatch, make):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    monkeypatch.setattr(jaccard, "SKIP_BLOCK", 2)
    base = make(9, 60).split()
    rows = []
    for i in range(40):
        words = list(base)
        for j in range(i % 5):
            words[(i * 7 + j * 11) % 60] = f"x{i}{j}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows, 4, 85)
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_join(df, 4, 85).collect()} == {rows[x][0]: c for x, c in wanted.items()}


def test_bitmaps_bound_differences():
    r = np.random.default_rng(2)
    for n in (1, 7, 200, 3000):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 5 :], r.integers(0, 2**63, n // 7, dtype=np.uint64)])
        x, y = (np.frombuffer(jaccard.bitmap(v), np.uint8) for v in (a, b))
        size = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_graph_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (1000, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    wanted = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x.node: x.component for x in graph.components(df).collect()} == wanted
    assert graph.components(df.limit(0)).collect() == []


def one_word_variants(spark, n, words=100, seed=1):
    """``n`` texts that each have another one of the words replaced: one family, most pairs of which are just below the threshold."""
    import random

    r = random.Random(seed)
    base, rows = [f"w{r.randint(0, 10**9)}" for _ in range(words)], []
    for i in range(n):
        text = list(base)
        text[r.randrange(words)] = f"x{r.randint(0, 10**9)}"
        rows.append((i, " ".join(text)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_a_family_of_near_misses(spark):
    rows, df = one_word_variants(spark, 250)
    wanted = brute(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df).collect()} == {rows[x][0]: c for x, c in wanted.items()}


def test_a_family_costs_in_proportion(spark):
    """8,000 such texts in less than 25 s, and no more than three times what half of them take."""
    import time

    took = []
    for n in (4000, 8000):
        df = one_word_variants(spark, n)[1].cache()
        df.count()
        start = time.time()
        assert jaccard.jaccard_join(df).select("component_id").distinct().count() == 1
        took.append(time.time() - start)
    assert took[1] < 25 and took[1] < 3 * took[0]


def test_shared_keys_are_combined():
    """What the counting filter learns doesn't depend on where postings of one key meet."""
    import numpy as np

    key, doc, n = np.array([5, 7, 5, 9, 5], np.uint32), np.array([1, 2, 3, 4, 5]), np.full(5, 6, np.int32)
    bucket, key, doc, n = jaccard.combined(key.astype(np.int32) % 4, key, doc, n, 4)
    assert sorted(doc[n < 0].tolist()) == [1, 3, 5] and sorted(doc[n > 0].tolist()) == [2, 4]
    assert key[n == 0].tolist() == [5] and len(bucket) == len(key) == 6


def test_ids_that_pass_the_filter_fill_few_files(spark, monkeypatch, make):
    """Not a file of the checkpoint for each bucket they were dealt to, and the same rows."""
    rows = [(i, make(i // 2, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: written.append(out := cut(df)) or out)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        classes = jaccard.families(docs, 4, 85)[0]
        assert written[0].columns == ["doc_id"] and written[0].rdd.getNumPartitions() < 4
        assert sorted(r.doc_id for r in written[0].collect()) == sorted(r.doc_id for r in jaccard.maybe_linked(docs, 4, 85).collect()) == list(range(60))
        assert sorted(r.first_doc for r in classes.collect()) == list(range(0, 60, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
