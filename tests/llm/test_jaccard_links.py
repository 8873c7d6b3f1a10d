"""Links of operator 9, those inside a family too, against brute force."""

from __future__ import annotations

import random

import duckdb
import pytest

from planweft.llm import jaccard
from planweft.llm import queries as llm

from .test_jaccard import brute, grams

SMALL = "/root/testdata/sf0.001"


def counted(rows, k, percent):
    """(number of links) of each row, by comparing all pairs."""
    sets = [grams(t, k) if i is not None else frozenset() for i, t in rows]
    return [sum(bool(inter := len(a & b)) and 100 * inter >= percent * (len(a) + len(b) - inter) for y, b in enumerate(sets) if x != y) for x, a in enumerate(sets)]


@pytest.mark.parametrize("tile", [256, 3])
def test_links_inside_families(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TOKENS", 50)
    r = random.Random(tile)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([30, 90, 150]))]
        for _ in range(r.choice([2, 9, 25])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            base = words if r.random() < 0.3 else base  # chains, whose ends aren't linked
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "one two"), (903, "ONE two"), (904, "alone"), (905, "one two"), (905, "one two")]
    found = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()
    wanted = counted(rows, 4, 85)
    classes = brute(rows, 4, 85)
    assert any(0 < n < sum(c == classes[x] for c in classes.values()) - 1 for x, n in enumerate(wanted))  # families with pairs that aren't linked
    sort = lambda rows: sorted(rows, key=str)
    assert sort((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in found) == sort((i, len(grams(t, 4)), classes[x], wanted[x]) for x, (i, t) in enumerate(rows))


def test_links_of_the_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = [tuple(r) for r in llm.QUERIES["jaccard_links"](spark, SMALL).collect()]
    assert sorted(found) == sorted(con.sql(llm.ORACLE_SQL["jaccard_links"]).fetchall())
