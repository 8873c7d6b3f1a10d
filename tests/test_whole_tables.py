"""Queries that take every row of their table, against brute force."""

from __future__ import annotations

import math

import pyarrow.parquet as pq
import pytest

from planweft.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lineitem():
    return pq.read_table(f"{DATA}/lineitem.parquet").to_pylist()


def test_product_of_all_rows(spark, lineitem):
    groups: dict[tuple, list[float]] = {}
    for r in lineitem:
        b = r["l_tax"] > 0.04 if r["l_suppkey"] % 5 != 1 else None
        held = groups.setdefault((None if r["l_returnflag"] == "R" else r["l_returnflag"], b), [])
        if r["l_linenumber"] != 3:
            held.append((-1 if r["l_suppkey"] % 3 == 0 else 1) * (1 + (r["l_quantity"] - 25.25) / 1e6))
    found = {(r.flag, r.b): r.v for r in QUERIES["agg_product"](spark, DATA).collect()}
    assert found == {k: pytest.approx(math.prod(v), abs=2e-8) for k, v in groups.items()}
    (whole,) = QUERIES["agg_product_keyless"](spark, DATA).collect()
    assert whole.v == pytest.approx(math.prod(x for v in groups.values() for x in v), abs=2e-8)


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("nulls", ["first", "last"])
def test_sorts_of_all_rows(spark, lineitem, order, nulls):
    """Row for row, in the stated order."""
    rows = [(None if r["l_linenumber"] == 3 else r["l_linenumber"] - 4, None if r["l_returnflag"] == "R" else r["l_returnflag"], r["l_orderkey"], r["l_linenumber"]) for r in lineitem]
    null = -1 if nulls == "first" else 1

    def key(row):
        k, flag, *rest = row
        return (null if k is None else 0, 0 if k is None else k if order == "asc" else -k, null if flag is None else 0, 0 if flag is None else -ord(flag), *rest)

    found = [tuple(r) for r in QUERIES[f"sort_{order}_nulls_{nulls}"](spark, DATA).collect()]
    assert found == sorted(rows, key=key)


def test_logarithms_of_all_rows(spark, lineitem):
    """Base 1 gives null."""
    found = sorted((tuple(r) for r in QUERIES["bin_log_base"](spark, DATA).collect()), key=str)
    rows = [(r["l_orderkey"], r["l_linenumber"]) for r in lineitem]
    wanted = sorted(((k, n, None if n == 1 or k == 0 else round(math.log(k) / math.log(n), 6)) for k, n in rows), key=str)
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert [r[2] for r in found] == [v if v is None else pytest.approx(v, abs=2e-6) for *_, v in wanted]
    assert any(n == 1 for _, n in rows)


def test_places_pass_on_few_rows(spark):
    """An inner place takes the first rows of a group where they are read, and no task sees the whole table."""
    keyed = QUERIES["agg_nth_element"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert keyed.index("Final") < keyed.index("Exchange hashpartitioning") < keyed.index("Partial")
    keyless = QUERIES["agg_nth_element_keyless"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=3" in keyless and "SinglePartition" not in keyless


def test_anti_join_has_rows(spark):
    assert QUERIES["join_anti_nullsafe"](spark, DATA).count() > 0
