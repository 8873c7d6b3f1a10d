"""Plans over small fixtures: values, schemas, JSON form, errors, explanation, options, Arrow and streams."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from planweft.engine import Engine
from planweft.errors import PlanError
from planweft.plans import build as B
from planweft.plans import codec
from planweft.plans import rels as R
from planweft.plans.build import t
from planweft.streaming import stateless
from planweft.types import TypeId

#: Thirteen rows of two nullable columns that the union and join fixtures share.
TABLE = [(1, "ab"), (2, "cd"), (3, "ef"), (None, "gh"), (None, None), (5, "ij"), (5, "ji"), (6, "kl"), (6, "kl"), (7, "mn"), (7, "mn"), (8, None), (None, None)]


@pytest.fixture
def engine(spark):
    return Engine(spark, generic=lambda a, b: a * 2 - b)


def give(engine, source_id, kinds, rows):
    rel = B.source(source_id, *kinds)
    engine.register(source_id, [r if isinstance(r, tuple) else (r,) for r in rows], rel.columns)
    return rel


def run(engine, plan):
    """Through JSON where the plan has a JSON form."""
    try:
        plan = codec.write_plan(plan)
    except PlanError:
        pass
    return [tuple(r) for r in engine.compile(plan).collect()]


def bag(rows):
    return sorted(rows, key=repr)


def ints(engine, source_id, values):
    return give(engine, source_id, ["INT32"], values)


def test_scan_of_fragments(engine):
    parts = [pa.table({"c0": pa.array(range(4), pa.int32())})] * 4
    engine.register(100, parts)
    assert len(run(engine, B.source(100, "INT32"))) == 16


@pytest.mark.parametrize("distinct, n", [(True, 10), (False, 35)])
def test_unions(engine, distinct, n):
    a, b = ints(engine, 100, [*range(10)] * 2), ints(engine, 200, [*range(3, 8)] * 3)
    assert len(run(engine, R.Union((a, b), distinct))) == n


@pytest.mark.parametrize("kinds, n", [("UUU", 13), ("AUU", 13), ("UAU", 13), ("UUA", 18), ("UAA", 55), ("AUA", 43), ("AAU", 13), ("AAA", 80)])
def test_nested_unions(engine, kinds, n):
    s = [ints(engine, 100, [*range(10)] * 2), ints(engine, 200, [*range(3, 8)] * 3), ints(engine, 300, [*range(8, 13)] * 4), ints(engine, 400, [*range(5, 10)] * 5)]
    u1, u2, outer = (k == "U" for k in kinds)
    assert len(run(engine, R.Union((R.Union((s[0], s[1]), u1), R.Union((s[2], s[3]), u2)), outer))) == n


def test_union_keeps_nulls_once(engine):
    s = give(engine, 1, ["INT64?", "STRING?"], [(41, "ab"), (41, None), (42, "cd"), (42, "cd"), (None, None), (None, None)])
    empty = give(engine, 2, ["INT64?", "STRING?"], [])
    assert len(run(engine, R.Union((s, empty)))) == 4


def joined(engine, with_filter=False, values=None):
    values = values or ([22, 32, 42, 52, 62] * 2, [*range(40, 50)] * 3, [*range(40, 60)] * 4)
    a, b, c = (ints(engine, i, v) for i, v in zip((100, 200, 300), values, strict=True))
    inner = B.join("INNER", a, b, (0, 0))
    if with_filter:
        inner = R.Filter(inner, B.op("EQUAL", B.col(inner, 0), B.lit(42, "INT32"), "BOOL8"))
    return inner, B.join("LEFT", inner, c, (0, 0)), B.join("LEFT", c, inner, (0, 0))


def test_joins(engine):
    inner, left, other = joined(engine)
    assert [len(run(engine, x)) for x in (inner, left, other)] == [6, 24, 100]
    assert [len(run(engine, x)) for x in joined(engine, True)[:2]] == [6, 24]
    assert [len(run(engine, x)) for x in joined(engine, values=([12], [22], [32]))[:2]] == [0, 0]


@pytest.mark.parametrize("side", ["LEFT", "RIGHT", None])
def test_join_of_two_keys(engine, side):
    a = give(engine, 100, ["INT32", "STRING"], [(22, "ab"), (32, "cd"), (42, "ef"), (52, "gh"), (62, "")])
    b = give(engine, 200, ["INT32", "STRING"], [*zip(range(40, 50), ["ab", "cd", "ef", "gh", *[""] * 6], strict=True)])
    assert run(engine, B.keep(B.join("INNER", a, b, (0, 0), (1, 1), build_side=side), 1)) == [("ef",)]


def test_null_keys_are_equal(engine):
    s = [give(engine, i, ["INT64?", "STRING?"], TABLE) for i in (100, 200, 300, 400)]
    u, v = R.Union((s[0], s[1])), R.Union((s[2], s[3]))
    assert len(run(engine, u)) == 10
    assert len(run(engine, B.join("INNER", u, v, (1, 1)))) == 12


JOINED = [("COUNT_ALL", 0, "INT64"), ("COUNT_VALID", 1, "INT64"), ("COUNT_VALID", 3, "INT64"), ("MIN", 1, "INT32?"), ("MAX", 3, "INT32?"), ("COUNT_VALID", 2, "INT64")]


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "FULL", "RIGHT"])
@pytest.mark.parametrize("groups, buckets", [((0, 2), None), ((1,), 3), ((), None), ((3, 0, 3), None)])
@pytest.mark.parametrize("empty", [None, 0, 1])
def test_aggregates_over_joins(spark, kind, groups, buckets, empty):
    """Sides are grouped before they meet, with the results of the joined rows. Columns come through a projection in another order."""
    engine = Engine(spark, strict=False)
    tables = [[(None, 1), (None, None), (1, 5), (1, 5), (1, None), (2, 7), (4, 8)], [(None, 3), (None, None), (1, None), (1, 2), (3, 9), (3, 9), (4, None)]]
    if empty is not None:
        tables[empty] = []
    a, b = (give(engine, i, ["INT32?", "INT32?"], rows) for i, rows in enumerate(tables))
    met = [x + y for x in tables[0] for y in tables[1] if x[0] == y[0]]
    if kind in ("LEFT", "FULL"):
        met += [(*x, None, None) for x in tables[0] if x[0] not in [y[0] for y in tables[1]]]
    if kind in ("RIGHT", "FULL"):
        met += [(None, None, *y) for y in tables[1] if y[0] not in [x[0] for x in tables[0]]]
    if buckets:
        engine.set_bucket_aggregate(True)
        engine.set_bucket_aggregate_buckets(buckets)
    turned = B.keep(B.keep(B.join(kind, a, b, (0, 0)), 3, 2, 1, 0), 3, 2, 1, 0)
    df = engine.compile(B.aggregate(turned, groups, *(B.agg(op, B.col(turned, i), of) for op, i, of in JOINED)))
    classes = {tuple(r[i] for i in groups): [] for r in met} if groups else {(): []}
    for r in met:
        classes[tuple(r[i] for i in groups)].append(r)
    how = {"COUNT_ALL": lambda v, rows: len(rows), "COUNT_VALID": lambda v, rows: len(v), "MIN": lambda v, rows: min(v, default=None), "MAX": lambda v, rows: max(v, default=None)}
    wanted = [(*k, *(how[op]([r[i] for r in rows if r[i] is not None], rows) for op, i, _ in JOINED)) for k, rows in classes.items()]
    assert bag(map(tuple, df.collect())) == bag(wanted)


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "FULL"])
def test_counting_many_to_many_makes_no_pairs(engine, kind):
    """Each key's rows meet as one row: 90,000 pairs of nulls otherwise."""
    a, b = (give(engine, i, ["INT32?"], [None] * 300) for i in (1, 2))
    j = B.join(kind, a, b, (0, 0))
    df = engine.compile(codec.write_plan(B.aggregate(j, (0, 1), B.agg("COUNT_ALL", B.col(j, 0), "INT64"))))
    assert [tuple(r) for r in df.collect()] == [(None, None, 90_000)]
    _, below = df._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)
    assert below.count("Aggregate [") == 2


def test_left_join_pads_with_nulls(engine):
    j = B.join("LEFT", ints(engine, 1, [22, 32, 42, 52]), ints(engine, 2, [41, 42, 43]), (0, 0))
    assert bag(run(engine, j)) == bag([(22, None), (32, None), (42, 42), (52, None)])
    assert [x.nullable for x in j.schema] == [False, True]


def test_semi_and_anti_have_left_columns_only(engine):
    a, b = ints(engine, 1, [1, 2, 2, 3]), ints(engine, 2, [2, 2, 4])
    assert run(engine, B.join("LEFT_SEMI", a, b, (0, 0))) == [(2,), (2,)]
    assert bag(run(engine, B.join("LEFT_ANTI", a, b, (0, 0)))) == [(1,), (3,)]
    assert len(B.join("FULL", a, b, (0, 0)).schema) == 2 and len(B.join("LEFT_SEMI", a, b, (0, 0)).schema) == 1


def test_projection_and_aggregation(engine):
    rows = [(42 + j, 142 + j, 1142 + j, s) for j, s in enumerate(["42", "42", "43", "44", "45"])]
    s = give(engine, 100, ["INT32", "INT32", "INT32", "STRING"], rows)
    plus = lambda i, j: B.op("ADD", B.col(s, i), B.op("ADD", B.col(s, j), B.lit(42, "INT32"), "INT32"), "INT32")
    p = B.project(s, plus(0, 1), plus(1, 2), B.col(s, 3))
    a = B.aggregate(p, (2,), B.agg("SUM", B.col(p, 0), "INT64?"), B.agg("MEAN", B.col(p, 1), "FLOAT64?"))
    assert bag(run(engine, a)) == [("42", 454, 1327.0), ("43", 230, 1330.0), ("44", 232, 1332.0), ("45", 234, 1334.0)]


KEYS = [1, 1, 2, 2, None, None]
GROUPED = [
    ("SUM", "INT64?", [None, None, 42, 42, None, 42], (None, 84, 42), 126),
    ("MIN", "INT32?", [None, None, 42, 43, None, 44], (None, 42, 44), 42),
    ("MAX", "INT64?", [41, None, 42, 43, None, 44], (41, 43, 44), 44),
    ("COUNT_VALID", "INT64", [None, None, 42, 43, None, 44], (0, 2, 1), 3),
    ("COUNT_ALL", "INT64", [None, None, 42, 43, None, 44], (2, 2, 2), 6),
    ("MEAN", "FLOAT64?", [None, None, 42, 43, None, 44], (None, 42.5, 44.0), 43.0),
    ("NUNIQUE", "INT64", [None, None, 42, 43, None, 44], (1, 2, 2), 4),
]


@pytest.mark.parametrize("op, kind, values, by_key, whole", GROUPED)
def test_aggregations(engine, op, kind, values, by_key, whole):
    s = give(engine, 1, ["INT64?", "INT32?"], list(zip(KEYS, values, strict=True)))
    a = B.agg(op, B.col(s, 1), kind)
    assert dict(run(engine, B.aggregate(s, (0,), a))) == dict(zip((1, 2, None), by_key, strict=True))
    assert run(engine, B.aggregate(s, (), a)) == [(whole,)]
    engine.set_bucket_aggregate(True)
    engine.set_bucket_aggregate_buckets(3)
    assert dict(run(engine, B.aggregate(s, (0,), a))) == dict(zip((1, 2, None), by_key, strict=True))


def test_nth_element_counts_nulls(engine):
    rows = [(k, v, i) for i, (k, v) in enumerate(zip(KEYS, [None, None, 42, 43, None, 44], strict=True))]
    s = give(engine, 1, ["INT64?", "INT32?", "INT32"], rows)
    nth = lambda n: dict(run(engine, B.aggregate(s, (0,), B.agg("NTH_ELEMENT", B.col(s, 1), "INT32?", n=n, order_by=(2,)))))
    assert nth(0) == {1: None, 2: 42, None: None}
    assert nth(1) == {1: None, 2: 43, None: 44} == nth(-1)
    assert nth(-2) == nth(0)
    assert nth(7) == {1: None, 2: None, None: None}
    empty = R.Filter(s, B.op("LESS", B.col(s, 2), B.lit(0, "INT32"), "BOOL8"))
    assert run(engine, B.aggregate(empty, (), B.agg("NTH_ELEMENT", B.col(s, 1), "INT32?", n=0))) == [(None,)]


def test_count_of_constants(engine):
    s = ints(engine, 1, range(7))
    for value, valid in ((1, 7), (None, 0)):
        p = B.project(s, B.lit(value, "INT32"))
        assert run(engine, B.aggregate(p, (), B.agg("COUNT_VALID", B.col(p, 0), "INT64"), B.agg("COUNT_ALL", B.col(p, 0), "INT64"))) == [(valid, 7)]


def test_sort_is_a_sort(engine):
    s = give(engine, 1, ["INT32?", "INT32", "STRING?"], [(42, 42, None), (0, 43, "a"), (42, 44, "z"), (None, 45, "i"), (None, 46, None), (0, 47, "b")])
    assert [r[1] for r in run(engine, B.sort(s, (0, "ASC", "FIRST"), (2, "DESC", "LAST")))] == [45, 46, 47, 43, 44, 42]


@pytest.mark.parametrize("rows, offset, n, kept", [(4, 1, 7, 3), (42, 1, 7, 7), (3, 4, 7, 0), (8, 1, 7, 7)])
def test_limit(engine, rows, offset, n, kept):
    assert len(run(engine, R.Limit(ints(engine, 1, range(rows)), n, offset))) == kept


def test_top_n(engine):
    s = ints(engine, 1, [*range(40, 44)] * 2)
    top = R.Limit(B.sort(s, (0, "ASC", "FIRST")), 7)
    assert [r[0] for r in run(engine, top)] == [40, 40, 41, 41, 42, 42, 43]
    assert "TakeOrderedAndProject" in "\n".join(engine.explain(top, extended=True))


def value(engine, kinds, row, make):
    s = give(engine, 1, kinds, [row])
    return run(engine, B.project(s, make(*(B.col(s, i) for i in range(len(kinds))))))[0][0]


def test_expressions(engine):
    two = ["INT64", "INT64"]
    op = lambda name, a, b, kind="INT64?": value(engine, two, (a, b), lambda x, y: B.op(name, x, y, kind))
    assert (op("DIV", -7, 2), op("MOD", -7, 3), op("PYMOD", 7, -3), op("PMOD", 7, -3), op("PMOD", -7, -3)) == (-3, -1, -2, 1, -1)
    assert op("DIV", 1, 0) is op("MOD", 1, 0) is op("TRUE_DIV", 1, 0, "FLOAT64?") is None
    assert (op("SHIFT_RIGHT", -8, 1), op("SHIFT_RIGHT_UNSIGNED", -1, 63), op("SHIFT_LEFT", 1, 62)) == (-4, 1, 2**62)
    assert op("LOG_BASE", 8, 2, "FLOAT64?") == pytest.approx(3) and op("GENERIC_BINARY", 5, 3) == 7
    big = 2**64 - 1
    assert value(engine, ["UINT64", "INT32"], (big, 5), lambda a, b: B.op("BITWISE_AND", a, B.lit(2**63, "UINT64"), "UINT64?")) == 2**63
    assert value(engine, ["FLOAT32", "UINT64"], (42.0, 42), lambda a, b: B.op("EQUAL", a, b, "BOOL8")) is True
    assert value(engine, ["TIMESTAMP_DAYS"], (42,), lambda a: B.op("EQUAL", a, B.lit(42, "TIMESTAMP_DAYS"), "BOOL8")) is True
    year = lambda x: value(engine, ["INT64?"], (x,), lambda a: B.un("EXTRACT_YEAR", a, "INT64?"))
    assert [year(x) for x in (2234574864524509196, None, 2241081774337687564)] == [1984, None, 1990]
    un = lambda name, x, kind="FLOAT64?": value(engine, ["FLOAT64"], (x,), lambda a: B.un(name, a, kind))
    assert (un("RINT", 2.5), un("RINT", 3.5), un("CEIL", 1e300), un("FLOOR", -0.5)) == (2.0, 4.0, 1e300, -1.0)


@pytest.mark.parametrize("a", [True, False, None])
@pytest.mark.parametrize("b", [True, False, None])
def test_three_valued_logic(engine, a, b):
    s = give(engine, 1, ["BOOL8?", "BOOL8?"], [(a, b)])
    both, either = run(engine, B.project(s, B.op("LOGICAL_AND", B.col(s, 0), B.col(s, 1), "BOOL8?"), B.op("LOGICAL_OR", B.col(s, 0), B.col(s, 1), "BOOL8?")))[0]
    assert both == (False if False in (a, b) else None if None in (a, b) else True)
    assert either == (True if True in (a, b) else None if None in (a, b) else False)


def test_out_of_range_raises(engine):
    with pytest.raises(Exception, match="out of range"):
        value(engine, ["UINT8", "UINT8"], (200, 100), lambda a, b: B.op("ADD", a, b, "UINT8"))
    with pytest.raises(Exception, match="(?i)overflow|out of"):
        value(engine, ["INT8", "INT8"], (100, 100), lambda a, b: B.op("ADD", a, b, "INT8"))


def test_json_round_trip(engine):
    s = B.source(100, "INT32?", "STRING")
    literals = [(True, "BOOL8"), (-42, "INT32"), (None, "INT32"), (42, "UINT64"), (42.42, "FLOAT64"), ("test", "STRING")] + [(42, x.value) for x in TypeId if x.value.startswith(("TIMESTAMP", "DURATION"))]
    plans = [B.project(s, *(B.lit(v, k) for v, k in literals), B.col(s, 0), B.col(s, 1)), *joined(engine), B.sort(s, (0, "DESC", "LAST"), (1, "ASC", "FIRST")), R.Limit(s, 7, 1), R.Union((s, s), False)]
    plans.append(B.aggregate(s, (1,), B.agg("NTH_ELEMENT", B.col(s, 0), "INT32?", n=-1), B.agg("QUANTILE", B.col(s, 0), "FLOAT64?", q=0.5)))
    plans.append(B.project(s, B.un("NOT", B.op("EQUAL", B.col(s, 0), B.lit(1, "INT32"), "BOOL8?"), "BOOL8?"), B.op("PMOD", B.col(s, 0), B.lit(3, "INT32"), "INT32?")))
    for plan in plans:
        text = codec.write_plan(plan)
        assert codec.read_plan(text) == plan
        assert json.loads(codec.write_plan(codec.read_plan(text))) == json.loads(text)


BAD = [
    "not json", "[]", "{}", '{"rels": []}', '{"rels": [{"rel_op": "Window"}]}', '{"rels": [{"rel_op": "Filter", "condition": {"literal": true, "type": "BOOL8"}}]}',
    '{"rels": [{"rel_op": "InputSource", "source_id": 1}]}', '{"rels": [{"rel_op": "InputSource", "source_id": 1, "schema": [{"type": "DECIMAL32", "nullable": true}]}]}',
    '{"rels": [{"rel_op": "InputSource", "source_id": 1, "schema": []}, {"rel_op": "InputSource", "source_id": 2, "schema": []}]}',
]


@pytest.mark.parametrize("text", BAD)
def test_bad_documents(engine, text):
    with pytest.raises(PlanError):
        engine.compile(text)


def test_bad_plans(engine):
    s = B.source(1, "INT32", "STRING?")
    one = B.op("EQUAL", B.col(s, 0), B.lit(1, "INT32"), "BOOL8")
    makers = [
        lambda: B.col(s, 2),
        lambda: B.op("LIKE", B.col(s, 0), B.col(s, 1), "BOOL8"),
        lambda: B.lit(2**31, "INT32"),
        lambda: B.lit("x", "INT32"),
        lambda: R.Union((s, B.source(2, "INT32", "STRING"))),
        lambda: R.HashJoin("LEFT", s, s, one, "LEFT"),
        lambda: R.HashJoin("OUTER", s, s, one),
        lambda: R.Project(s, ()),
        lambda: R.Aggregate(s, (), ()),
        lambda: R.Limit(s, -1),
        lambda: engine.plan(R.Filter(s, B.col(s, 0))),
        lambda: engine.plan(R.HashJoin("INNER", s, s, one)),
        lambda: engine.plan(B.join("INNER", s, B.source(2, "INT32?"), (0, 0))),
        lambda: engine.plan(R.Project(s, (B.agg("SUM", B.col(s, 0), "INT64?"),))),
        lambda: engine.compile(B.source(77, "INT32")),
        lambda: engine.set_threads_per_pipeline(0),
        lambda: engine.set_memory_resource(9),
        lambda: list(engine.slices(s, 0)),
    ]
    for make in makers:
        with pytest.raises(PlanError):
            make()


def test_loose_plans(spark):
    loose = Engine(spark, strict=False)
    a, b = ints(loose, 1, [1, 5, 9]), give(loose, 2, ["INT32?"], [2, 6, None])
    assert len(run_plan := loose.compile(R.Union((a, b), False, strict=False)).collect()) == 6 and run_plan
    both = R.HashJoin("INNER", a, b, B.op("LESS", B.X.column(a.schema + b.schema, 0), B.X.column(a.schema + b.schema, 1), "BOOL8?"))
    assert bag(tuple(r) for r in loose.compile(both).collect()) == [(1, 2), (1, 6), (5, 6)]


def test_explain(engine):
    inner, left, _ = joined(engine)
    lines = engine.explain(left)
    assert lines[1].startswith("HashJoin(LEFT") and any(x.startswith("|  |- InputSource(100)") for x in lines) and lines[-1] == "|- InputSource(300)[INT32]"
    assert any("Join" in x for x in engine.explain(inner, extended=True)[3:])


def test_pushed_filter_and_pruned_columns(engine):
    from planweft.queries import LINEITEM, _q6, scan

    engine.read(1, "/root/testdata/sf0.001/lineitem.parquet")
    engine.register(1, engine.sources.by_id[1].select(*(c for c, _ in LINEITEM[2])))
    text = "\n".join(engine.explain(_q6(), extended=True))
    assert "PushedFilters: [IsNotNull(l_quantity)" in text and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in text
    assert scan(LINEITEM).schema


def test_results_as_arrow_and_slices(engine):
    s = ints(engine, 1, range(11))
    assert engine.to_arrow(s).num_rows == 11
    assert [len(x) for x in engine.slices(s, 4)] == [4, 4, 3]


def test_streams(spark, tmp_path):
    engine = Engine(spark)
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    files = tmp_path / "in"
    spark.read.parquet(path).write.parquet(str(files))
    engine.register(1, spark.readStream.schema(schema).parquet(str(files)).select("event_id", "value"))
    s = B.source(1, "INT64", "FLOAT64")
    plan = stateless.check_stateless(B.keep(R.Filter(s, B.op("GREATER", B.col(s, 1), B.lit(0, "FLOAT64"), "BOOL8")), 0))
    query = stateless.start(engine.compile(plan), "parquet", str(tmp_path / "c"), path=str(tmp_path / "out"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(path).where("value > 0").count()
    with pytest.raises(PlanError):
        stateless.check_stateless(B.sort(s, (0, "ASC", "FIRST")))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.integers(-5, 5))), max_size=12), st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=6))
def test_null_handling_as_in_python(spark, rows, keys):
    engine = Engine(spark)
    a, b = give(engine, 1, ["INT64?", "INT64?"], rows), give(engine, 2, ["INT64?"], keys)
    assert bag(run(engine, B.join("INNER", a, b, (0, 0)))) == bag((k, v, x) for k, v in rows for x in keys if k == x)
    assert bag(run(engine, B.join("LEFT_ANTI", a, b, (0, 0)))) == bag((k, v) for k, v in rows if k not in keys)
    sums = {k: [v for j, v in rows if j == k and v is not None] for k, _ in rows}
    assert bag(run(engine, B.aggregate(a, (0,), B.agg("SUM", B.col(a, 1), "INT64?")))) == bag((k, sum(v) if v else None) for k, v in sums.items())


def test_types():
    assert str(t("INT32?")) == "INT32?" and len(TypeId) == 22
