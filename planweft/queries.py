"""A query for every operator of the plan language, each with DuckDB SQL that gives the same rows.

Every query is a JSON plan: built, written, read, checked and compiled. Doubles
are rounded on both sides, as the last digit depends on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweft.engine import Engine
from planweft.plans import build as B
from planweft.plans import codec
from planweft.plans.expressions import BINARY, UNARY
from planweft.plans.rels import Filter, Limit, Rel, Union

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Sources: number, table, (SQL of the column, its declared type). The same SQL makes the oracle's columns.
LINEITEM = (1, "lineitem", (("l_orderkey", "INT64"), ("l_partkey", "INT64"), ("l_suppkey", "INT64"), ("l_linenumber", "INT32"), ("l_quantity", "FLOAT64"), ("l_extendedprice", "FLOAT64"), ("l_discount", "FLOAT64"), ("l_returnflag", "STRING"), ("l_shipdate", "TIMESTAMP_MICROSECONDS")))
ORDERS = (2, "orders", (("o_orderkey", "INT64"), ("o_custkey", "INT64"), ("o_orderstatus", "STRING"), ("o_totalprice", "FLOAT64"), ("o_orderdate", "TIMESTAMP_MICROSECONDS"), ("o_orderpriority", "STRING")))
CUSTOMER = (3, "customer", (("c_custkey", "INT64"), ("c_name", "STRING"), ("c_nationkey", "INT32"), ("c_acctbal", "FLOAT64"), ("c_mktsegment", "STRING")))
NATION = (4, "nation", (("n_nationkey", "INT32"), ("n_name", "STRING"), ("n_regionkey", "INT32")))
SUPPLIER = (5, "supplier", (("s_suppkey", "INT64"), ("s_name", "STRING"), ("s_nationkey", "INT32"), ("s_acctbal", "FLOAT64")))
PART = (6, "part", (("p_partkey", "INT64"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_size", "INT32"), ("p_retailprice", "FLOAT64")))
#: Columns with nulls, negative numbers and ties, for the scalar operators and aggregations.
MIXED = (7, "lineitem", (("l_orderkey", "INT64"), ("l_linenumber", "INT32"), ("nullif(l_linenumber, 3) - 4", "INT32?"), ("nullif(l_suppkey % 7, 5) - 2", "INT64?"), ("nullif(l_quantity, 17) - 25", "FLOAT64?"), ("nullif(l_discount * 10, 0.3)", "FLOAT64?"), ("nullif(l_returnflag, 'R')", "STRING?"), ("CASE WHEN l_linenumber <> 2 THEN l_quantity > 25 END", "BOOL8?"), ("CASE WHEN l_suppkey % 5 <> 1 THEN l_tax > 0.04 END", "BOOL8?")))
NULL_CUSTOMERS = (8, "customer", (("nullif(c_nationkey, 3)", "INT32?"), ("nullif(c_mktsegment, 'BUILDING')", "STRING?"), ("c_custkey", "INT64")))
NULL_SUPPLIERS = (9, "supplier", (("nullif(s_nationkey, 3)", "INT32?"), ("s_suppkey", "INT64")))
EVENTS = (10, "events", (("event_id", "INT64"), ("user_id", "INT64"), ("event_type", "STRING"), ("value", "FLOAT64")))


def scan(of: tuple) -> Rel:
    return B.source(of[0], *(kind for _, kind in of[2]))


def columns_sql(of: tuple) -> str:
    return ", ".join(f"{sql} AS c{i}" for i, (sql, _) in enumerate(of[2]))


def view(of: tuple) -> str:
    """The oracle's form of a source."""
    return f"(SELECT {columns_sql(of)} FROM {of[1]})"


def run(spark: SparkSession, sf_dir: str, plan: Callable[[], Rel], sources: tuple, names: list[str], rounded: dict[str, int], buckets: int | None) -> DataFrame:
    engine = Engine(spark, generic=lambda a, b: a * F.lit(2) - b)
    for number, table, columns in sources:
        engine.register(number, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{sql} AS c{i}" for i, (sql, _) in enumerate(columns))))
    if buckets:
        engine.set_bucket_aggregate(True)
        engine.set_bucket_aggregate_buckets(buckets)
    made = engine.compile(codec.write_plan(plan())).toDF(*names)
    return made.select(*(F.round(c, rounded[c]).alias(c) if c in rounded else c for c in names))


def add(name: str, plan: Callable[[], Rel], sources: tuple, names: str, sql: str | None, rounded: dict[str, int] | None = None, buckets: int | None = None) -> None:
    """Register a query. ``sql`` selects the columns ``names``; those in ``rounded`` are rounded to so many digits on both sides."""
    listed, rounded = names.split(), rounded or {}
    QUERIES[name] = partial(run, plan=plan, sources=sources, names=listed, rounded=rounded, buckets=buckets)
    if sql is not None:
        out = ", ".join(f"round({c}, {rounded[c]}) AS {c}" if c in rounded else c for c in listed)
        ORACLE_SQL[name] = f"SELECT {out} FROM ({sql}) AS result({', '.join(listed)})"


# --- scans, filters, projections, limits, sorts


def _scan_project() -> Rel:
    s = scan(LINEITEM)
    return B.keep(s, 0, 3, 7, 5)


add("scan_project", _scan_project, (LINEITEM,), "orderkey linenumber flag price", f"SELECT c0, c3, c7, c5 FROM {view(LINEITEM)}")


def _filter_cmp() -> Rel:
    s = scan(LINEITEM)
    c = [B.col(s, i) for i in range(9)]
    parts = [
        B.op("NOT_EQUAL", c[7], B.lit("R", "STRING"), "BOOL8"), B.op("GREATER_EQUAL", c[6], B.lit(0.02, "FLOAT64"), "BOOL8"), B.op("LESS_EQUAL", c[6], B.lit(0.08, "FLOAT64"), "BOOL8"),
        B.op("LESS", c[4], B.lit(40, "FLOAT64"), "BOOL8"), B.op("GREATER", B.lit(6, "INT32"), c[3], "BOOL8"), B.op("LOGICAL_OR", B.op("EQUAL", c[3], B.lit(1, "INT32"), "BOOL8"), B.op("GREATER", c[1], B.lit(100, "INT64"), "BOOL8"), "BOOL8"),
    ]
    return B.keep(Filter(s, B.both(*parts)), 0, 3)


add("filter_cmp", _filter_cmp, (LINEITEM,), "orderkey linenumber", f"SELECT c0, c3 FROM {view(LINEITEM)} WHERE c7 <> 'R' AND c6 >= 0.02 AND c6 <= 0.08 AND c4 < 40 AND 6 > c3 AND (c3 = 1 OR c1 > 100)")


def _filter_kleene() -> Rel:
    s = scan(MIXED)
    keep_ = B.op("LOGICAL_OR", B.op("LOGICAL_AND", B.col(s, 7), B.col(s, 8), "BOOL8?"), B.un("NOT", B.col(s, 7), "BOOL8?"), "BOOL8?")
    return B.keep(Filter(s, keep_), 0, 1, 7, 8)


add("filter_kleene", _filter_kleene, (MIXED,), "orderkey linenumber a b", f"SELECT c0, c1, c7, c8 FROM {view(MIXED)} WHERE (c7 AND c8) OR NOT c7")


def _filter_constant() -> Rel:
    s = scan(NATION)
    return Union((Filter(s, B.lit(True, "BOOL8")), Filter(scan(NATION), B.lit(None, "BOOL8"))), distinct=False)


add("filter_constant", _filter_constant, (NATION,), "nationkey name regionkey", f"SELECT * FROM {view(NATION)}")


def _project_arith() -> Rel:
    s = scan(LINEITEM)
    one = B.op("SUB", B.lit(1, "FLOAT64"), B.col(s, 6), "FLOAT64")
    return B.project(s, B.col(s, 0), B.col(s, 3), B.op("MUL", B.col(s, 5), one, "FLOAT64"), B.op("ADD", B.col(s, 0), B.op("ADD", B.col(s, 1), B.lit(42, "INT64"), "INT64"), "INT64"))


add("project_arith", _project_arith, (LINEITEM,), "orderkey linenumber net shifted", f"SELECT c0, c3, c5 * (1 - c6), c0 + (c1 + 42) FROM {view(LINEITEM)}", {"net": 4})


def _literal_project() -> Rel:
    s = scan(NATION)
    return B.project(s, B.col(s, 0), B.lit(7, "INT32"), B.lit("x", "STRING"), B.lit(2.5, "FLOAT64"), B.lit(True, "BOOL8"), B.lit(None, "INT64"), B.lit(10957, "TIMESTAMP_DAYS"), B.lit(946684800, "TIMESTAMP_SECONDS"))


add("literal_project", _literal_project, (NATION,), "nationkey i s d b n day second", f"SELECT c0, 7::INTEGER, 'x', 2.5::DOUBLE, true, NULL::BIGINT, DATE '2000-01-01', TIMESTAMP '2000-01-01 00:00:00' FROM {view(NATION)}")


def _limit_offset_sorted() -> Rel:
    s = scan(ORDERS)
    return Limit(B.sort(B.keep(s, 0, 3), (0, "ASC", "FIRST")), 25, 10)


add("limit_offset_sorted", _limit_offset_sorted, (ORDERS,), "orderkey price", f"SELECT c0, c3 FROM {view(ORDERS)} ORDER BY c0 LIMIT 25 OFFSET 10")


def _limit_unsorted() -> Rel:
    s = Limit(scan(LINEITEM), 100, 5)
    return B.aggregate(s, (), B.agg("COUNT_ALL", B.col(s, 0), "INT64"))


add("limit_unsorted", _limit_unsorted, (LINEITEM,), "n", f"SELECT count(*) FROM (SELECT * FROM {view(LINEITEM)} LIMIT 100 OFFSET 5)")

for _order in ("ASC", "DESC"):
    for _nulls in ("FIRST", "LAST"):

        def _sorted(order=_order, nulls=_nulls) -> Rel:
            s = B.keep(scan(MIXED), 2, 6, 0, 1)
            return B.sort(s, (0, order, nulls), (1, "DESC", nulls), (2, "ASC", "FIRST"), (3, "ASC", "FIRST"))

        add(f"sort_{_order}_nulls_{_nulls}".lower(), _sorted, (MIXED,), "k flag orderkey linenumber", f"SELECT c2, c6, c0, c1 FROM {view(MIXED)} ORDER BY c2 {_order} NULLS {_nulls}, c6 DESC NULLS {_nulls}, c0, c1")


def _sort_full() -> Rel:
    s = B.keep(scan(ORDERS), 0, 3)
    return B.sort(s, (1, "DESC", "LAST"), (0, "ASC", "FIRST"))


add("sort_full", _sort_full, (ORDERS,), "orderkey price", f"SELECT c0, c3 FROM {view(ORDERS)} ORDER BY c3 DESC, c0")


def _topn() -> Rel:
    s = B.keep(scan(LINEITEM), 0, 3, 5)
    return Limit(B.sort(s, (2, "DESC", "LAST"), (0, "ASC", "FIRST"), (1, "ASC", "FIRST")), 20)


add("topn", _topn, (LINEITEM,), "orderkey linenumber price", f"SELECT c0, c3, c5 FROM {view(LINEITEM)} ORDER BY c5 DESC, c0, c3 LIMIT 20")

# --- joins


def _join(kind: str, build_side: str | None = None) -> Rel:
    left = B.keep(scan(ORDERS), 0, 1)
    c = scan(CUSTOMER)
    right = B.keep(Filter(c, B.op("GREATER", B.col(c, 3), B.lit(5000, "FLOAT64"), "BOOL8")), 0, 3)
    return B.join(kind, left, right, (1, 0), build_side=build_side)


_RICH = f"(SELECT c0, c3 FROM {view(CUSTOMER)} WHERE c3 > 5000)"
_O = f"(SELECT c0, c1 FROM {view(ORDERS)})"
for _name, _kind, _side, _sql in (
    ("join_inner", "INNER", None, "JOIN"), ("join_build_side_left", "INNER", "LEFT", "JOIN"), ("join_build_side_right", "INNER", "RIGHT", "JOIN"), ("join_left", "LEFT", None, "LEFT JOIN"), ("join_full", "FULL", None, "FULL JOIN"),
):
    add(_name, partial(_join, _kind, _side), (ORDERS, CUSTOMER), "orderkey custkey key acctbal", f"SELECT o.c0, o.c1, c.c0, c.c3 FROM {_O} o {_sql} {_RICH} c ON o.c1 = c.c0")
add("join_semi", partial(_join, "LEFT_SEMI"), (ORDERS, CUSTOMER), "orderkey custkey", f"SELECT c0, c1 FROM {_O} WHERE c1 IN (SELECT c0 FROM {_RICH})")
add("join_anti", partial(_join, "LEFT_ANTI"), (ORDERS, CUSTOMER), "orderkey custkey", f"SELECT c0, c1 FROM {_O} o WHERE NOT EXISTS (SELECT 1 FROM {_RICH} c WHERE c.c0 = o.c1)")
# beyond the plan language
add("more_right_join", partial(_join, "RIGHT"), (ORDERS, CUSTOMER), "orderkey custkey key acctbal", f"SELECT o.c0, o.c1, c.c0, c.c3 FROM {_O} o RIGHT JOIN {_RICH} c ON o.c1 = c.c0")


def _join_null(kind: str) -> Rel:
    joined = B.join(kind, scan(NULL_CUSTOMERS), scan(NULL_SUPPLIERS), (0, 0))
    n = len(joined.schema)
    if kind in ("LEFT_SEMI", "LEFT_ANTI"):
        return B.keep(joined, 2)
    # many to many: counted by key, so the result stays small
    return B.aggregate(joined, (0, n - 2), B.agg("COUNT_ALL", B.col(joined, 0), "INT64"), B.agg("COUNT_VALID", B.col(joined, n - 1), "INT64"))


_N, _S = view(NULL_CUSTOMERS), view(NULL_SUPPLIERS)
for _kind, _sql in (("INNER", "JOIN"), ("LEFT", "LEFT JOIN"), ("FULL", "FULL JOIN")):
    add(f"join_{_kind.lower()}_nullsafe", partial(_join_null, _kind), (NULL_CUSTOMERS, NULL_SUPPLIERS), "a b n m", f"SELECT a.c0, b.c0, count(*), count(b.c1) FROM {_N} a {_sql} {_S} b ON a.c0 IS NOT DISTINCT FROM b.c0 GROUP BY 1, 2")
add("join_semi_nullsafe", partial(_join_null, "LEFT_SEMI"), (NULL_CUSTOMERS, NULL_SUPPLIERS), "custkey", f"SELECT c2 FROM {_N} a WHERE EXISTS (SELECT 1 FROM {_S} b WHERE a.c0 IS NOT DISTINCT FROM b.c0)")
#: Suppliers' keys, all nations of Asia and Europe moved away: customers have keys without a partner, and null meets null.
FEW_SUPPLIERS = (15, "supplier", (("CASE WHEN s_nationkey = 3 THEN NULL WHEN s_nationkey > 12 THEN s_nationkey + 100 ELSE s_nationkey END", "INT32?"), ("s_suppkey", "INT64")))


def _anti_null() -> Rel:
    return B.keep(B.join("LEFT_ANTI", scan(NULL_CUSTOMERS), scan(FEW_SUPPLIERS), (0, 0)), 2)


add("join_anti_nullsafe", _anti_null, (NULL_CUSTOMERS, FEW_SUPPLIERS), "custkey", f"SELECT c2 FROM {_N} a WHERE NOT EXISTS (SELECT 1 FROM {view(FEW_SUPPLIERS)} b WHERE a.c0 IS NOT DISTINCT FROM b.c0)")


def _join_left_empty_build() -> Rel:
    c = scan(CUSTOMER)
    none = Filter(c, B.op("LESS", B.col(c, 0), B.lit(0, "INT64"), "BOOL8"))
    return B.join("LEFT", B.keep(scan(ORDERS), 0, 1), B.keep(none, 0, 3), (1, 0))


add("join_left_empty_build", _join_left_empty_build, (ORDERS, CUSTOMER), "orderkey custkey key acctbal", f"SELECT c0, c1, NULL::BIGINT, NULL::DOUBLE FROM {_O}")


def _join_multi_key() -> Rel:
    left = B.keep(scan(LINEITEM), 0, 3, 5)
    right = B.keep(scan(LINEITEM), 0, 3, 4)
    return B.join("INNER", left, right, (0, 0), (1, 1))


add("join_multi_key", _join_multi_key, (LINEITEM,), "k n price k2 n2 quantity", f"SELECT a.c0, a.c3, a.c5, b.c0, b.c3, b.c4 FROM {view(LINEITEM)} a JOIN {view(LINEITEM)} b ON a.c0 = b.c0 AND a.c3 = b.c3")


def _self_join() -> Rel:
    a, b = scan(NATION), scan(NATION)
    joined = B.join("INNER", a, b, (2, 2))
    return B.keep(joined, 1, 4)


add("self_join", _self_join, (NATION,), "a b", f"SELECT a.c1, b.c1 FROM {view(NATION)} a JOIN {view(NATION)} b ON a.c2 = b.c2")

# --- set operations


def _parts(distinct: bool) -> Rel:
    return Union((B.keep(scan(ORDERS), 1), B.keep(scan(CUSTOMER), 0)), distinct)


add("union", partial(_parts, True), (ORDERS, CUSTOMER), "custkey", f"SELECT c1 FROM {view(ORDERS)} UNION SELECT c0 FROM {view(CUSTOMER)}")
add("union_all", partial(_parts, False), (ORDERS, CUSTOMER), "custkey", f"SELECT c1 FROM {view(ORDERS)} UNION ALL SELECT c0 FROM {view(CUSTOMER)}")


def _union_nulls() -> Rel:
    return Union((B.keep(scan(NULL_CUSTOMERS), 0), B.keep(scan(NULL_SUPPLIERS), 0)))


add("union_nulls", _union_nulls, (NULL_CUSTOMERS, NULL_SUPPLIERS), "nationkey", f"SELECT c0 FROM {_N} UNION SELECT c0 FROM {_S}")


def _union_nested(inner: bool, outer: bool) -> Rel:
    first = Union((B.keep(scan(ORDERS), 1), B.keep(scan(CUSTOMER), 0)), inner)
    return Union((first, B.keep(scan(SUPPLIER), 0)), outer)


for _inner in (True, False):
    for _outer in (True, False):
        _words = ["UNION" if x else "UNION ALL" for x in (_inner, _outer)]
        add(f"union_nested_{'d' if _inner else 'a'}{'d' if _outer else 'a'}", partial(_union_nested, _inner, _outer), (ORDERS, CUSTOMER, SUPPLIER), "k", f"(SELECT c1 FROM {view(ORDERS)} {_words[0]} SELECT c0 FROM {view(CUSTOMER)}) {_words[1]} SELECT c0 FROM {view(SUPPLIER)}")


def _join_of_two_unions() -> Rel:
    a = Union((B.keep(scan(NULL_CUSTOMERS), 0), B.keep(scan(NULL_SUPPLIERS), 0)))
    b = Union((B.keep(scan(NULL_SUPPLIERS), 0), B.keep(scan(NULL_CUSTOMERS), 0)))
    return B.join("INNER", a, b, (0, 0))


_U = f"(SELECT c0 FROM {_N} UNION SELECT c0 FROM {_S})"
add("join_of_two_unions", _join_of_two_unions, (NULL_CUSTOMERS, NULL_SUPPLIERS), "a b", f"SELECT a.c0, b.c0 FROM {_U} a JOIN {_U} b ON a.c0 IS NOT DISTINCT FROM b.c0")

# --- aggregations: by a key with nulls, and over all rows

ORDERED = (11, "lineitem", (*MIXED[2], ("l_orderkey * 8 + l_linenumber", "INT64")))
AGGREGATIONS: tuple[tuple[str, int, str, str, dict, int | None], ...] = (
    # operator, operand, declared type, SQL, further fields, digits
    ("SUM", 3, "INT64?", "sum(c3)::BIGINT", {}, None),
    ("MIN", 2, "INT32?", "min(c2)", {}, None),
    ("MAX", 6, "STRING?", "max(c6)", {}, None),
    ("COUNT_VALID", 4, "INT64", "count(c4)", {}, None),
    ("COUNT_ALL", 4, "INT64", "count(*)", {}, None),
    ("ANY", 7, "BOOL8?", "bool_or(c7)", {}, None),
    ("ALL", 7, "BOOL8?", "bool_and(c7)", {}, None),
    ("SUM_OF_SQUARES", 4, "FLOAT64?", "sum(c4 * c4)", {}, 3),
    ("MEAN", 4, "FLOAT64?", "avg(c4)", {}, 6),
    ("MEDIAN", 4, "FLOAT64?", "median(c4)", {}, 6),
    ("QUANTILE", 4, "FLOAT64?", "quantile_cont(c4, 0.9)", {"q": 0.9}, 6),
    ("ARGMAX", 4, "INT64?", "arg_max(c9, row(c4, -c9))", {"order_by": (9,)}, None),
    ("ARGMIN", 4, "INT64?", "arg_min(c9, row(c4, c9)) FILTER (c4 IS NOT NULL)", {"order_by": (9,)}, None),
    ("NUNIQUE", 3, "INT64", "count(DISTINCT c3) + max(CASE WHEN c3 IS NULL THEN 1 ELSE 0 END)", {}, None),
    ("NTH_ELEMENT", 2, "INT32?", "list(c2 ORDER BY c9)[3]", {"n": 2, "order_by": (9,)}, None),
)
for _op, _i, _kind, _sql, _more, _digits in AGGREGATIONS:

    def _aggregated(groups: tuple[int, ...], op=_op, i=_i, kind=_kind, more=_more) -> Rel:
        s: Rel = scan(ORDERED)
        return B.aggregate(s, groups, B.agg(op, B.col(s, i), kind, **more))

    _round = {"v": _digits} if _digits is not None else {}
    if _op == "ARGMAX":
        _sql += " FILTER (c4 IS NOT NULL)"
    add(f"agg_{_op.lower()}", partial(_aggregated, (6, 8)), (ORDERED,), "flag b v", f"SELECT c6, c8, {_sql} FROM {view(ORDERED)} GROUP BY 1, 2", _round)
    add(f"agg_{_op.lower()}_keyless", partial(_aggregated, ()), (ORDERED,), "v", f"SELECT {_sql} FROM {view(ORDERED)}", _round)

#: Factors near 1, with both signs and nulls: their product over all rows stays in the range of doubles.
FACTORS = (14, "lineitem", (*MIXED[2], ("CASE WHEN l_linenumber <> 3 THEN (CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE 1 END) * (1 + (l_quantity - 25.25) / 1000000) END", "FLOAT64?")))


def _agg_product(groups: tuple[int, ...]) -> Rel:
    s = scan(FACTORS)
    return B.aggregate(s, groups, B.agg("PRODUCT", B.col(s, 9), "FLOAT64?"))


add("agg_product", partial(_agg_product, (6, 8)), (FACTORS,), "flag b v", f"SELECT c6, c8, product(c9) FROM {view(FACTORS)} GROUP BY 1, 2", {"v": 8})
add("agg_product_keyless", partial(_agg_product, ()), (FACTORS,), "v", f"SELECT product(c9) FROM {view(FACTORS)}", {"v": 8})


def _agg_first_last() -> Rel:
    s = scan(ORDERED)
    return B.aggregate(s, (1,), *(B.agg("NTH_ELEMENT", B.col(s, 2), "INT32?", n=n, order_by=(9,)) for n in (0, -1, -2, 10**9)))


add("agg_nth_element_ends", _agg_first_last, (ORDERED,), "linenumber first last last_but_one beyond", f"SELECT c1, list(c2 ORDER BY c9)[1], list(c2 ORDER BY c9)[-1], list(c2 ORDER BY c9)[-2], NULL::INTEGER FROM {view(ORDERED)} GROUP BY 1")


def _agg_keyless_empty() -> Rel:
    s = scan(LINEITEM)
    s = Filter(s, B.op("LESS", B.col(s, 0), B.lit(0, "INT64"), "BOOL8"))
    return B.aggregate(s, (), B.agg("SUM", B.col(s, 5), "FLOAT64?"), B.agg("COUNT_ALL", B.col(s, 5), "INT64"), B.agg("NUNIQUE", B.col(s, 1), "INT64"))


add("agg_keyless_empty", _agg_keyless_empty, (LINEITEM,), "s n u", "SELECT NULL::DOUBLE, 0::BIGINT, 0::BIGINT")


def _agg_null_keys() -> Rel:
    s = scan(NULL_CUSTOMERS)
    return B.aggregate(s, (0, 1), B.agg("COUNT_ALL", B.col(s, 2), "INT64"), B.agg("MIN", B.col(s, 2), "INT64?"))


add("agg_null_keys", _agg_null_keys, (NULL_CUSTOMERS,), "nationkey segment n least", f"SELECT c0, c1, count(*), min(c2) FROM {_N} GROUP BY 1, 2")


def _agg_bucketed() -> Rel:
    s = scan(LINEITEM)
    return B.aggregate(s, (2,), B.agg("SUM", B.col(s, 4), "FLOAT64?"), B.agg("COUNT_ALL", B.col(s, 0), "INT64"), B.agg("MAX", B.col(s, 5), "FLOAT64?"))


add("agg_bucketed", _agg_bucketed, (LINEITEM,), "suppkey quantity n most", f"SELECT c2, sum(c4), count(*), max(c5) FROM {view(LINEITEM)} GROUP BY 1", {"quantity": 2}, buckets=16)


def _agg_constant_columns() -> Rel:
    s = scan(NATION)
    p = B.project(s, B.lit(1, "INT32"), B.lit(None, "INT32"))
    return B.aggregate(p, (), *(B.agg(o, B.col(p, i), "INT64") for i in (0, 1) for o in ("COUNT_VALID", "COUNT_ALL")))


add("agg_constant_columns", _agg_constant_columns, (NATION,), "a b c d", f"SELECT count(*), count(*), 0::BIGINT, count(*) FROM {view(NATION)}")


def _agg_computed() -> Rel:
    s = scan(LINEITEM)
    p = B.project(s, B.col(s, 7), B.op("MUL", B.col(s, 5), B.op("SUB", B.lit(1, "FLOAT64"), B.col(s, 6), "FLOAT64"), "FLOAT64"))
    return B.aggregate(p, (0,), B.agg("SUM", B.col(p, 1), "FLOAT64?"), B.agg("MEAN", B.col(p, 1), "FLOAT64?"))


add("agg_computed", _agg_computed, (LINEITEM,), "flag net mean", f"SELECT c7, sum(c5 * (1 - c6)), avg(c5 * (1 - c6)) FROM {view(LINEITEM)} GROUP BY 1", {"net": 2, "mean": 4})

# --- scalar operators: operator -> (left, right, declared type, SQL, digits). Columns of MIXED; a number stands for a constant.

_MODS = "CASE WHEN c3 = 0 THEN NULL ELSE {} END"
BINARIES: dict[str, tuple] = {
    "ADD": (2, 3, "INT64?", "c2 + c3", None),
    "SUB": (2, 3, "INT64?", "c2 - c3", None),
    "MUL": (4, 5, "FLOAT64?", "c4 * c5", 6),
    "DIV": (0, 3, "INT64?", _MODS.format("trunc(c0::DOUBLE / c3)::BIGINT"), None),
    "TRUE_DIV": (2, 3, "FLOAT64?", _MODS.format("c2::DOUBLE / c3"), 6),
    "FLOOR_DIV": (2, 3, "FLOAT64?", _MODS.format("floor(c2::DOUBLE / c3)"), None),
    "MOD": (2, 3, "INT64?", _MODS.format("c2 % c3"), None),
    "PYMOD": (2, 3, "INT64?", _MODS.format("((c2 % c3) + c3) % c3"), None),
    "PMOD": (2, 3, "INT64?", _MODS.format("CASE WHEN c2 % c3 < 0 THEN (c2 % c3 + c3) % c3 ELSE c2 % c3 END"), None),
    "POW": (4, 1, "FLOAT64?", "pow(c4, c1)", 0),
    "EQUAL": (2, 3, "BOOL8?", "c2 = c3", None),
    "NOT_EQUAL": (2, 3, "BOOL8?", "c2 <> c3", None),
    "LESS": (2, 3, "BOOL8?", "c2 < c3", None),
    "GREATER": (4, 5, "BOOL8?", "c4 > c5", None),
    "LESS_EQUAL": (2, 4, "BOOL8?", "c2 <= c4", None),
    "GREATER_EQUAL": (3, 4, "BOOL8?", "c3 >= c4", None),
    "BITWISE_AND": (2, 3, "INT64?", "c2::BIGINT & c3", None),
    "BITWISE_OR": (2, 3, "INT64?", "c2::BIGINT | c3", None),
    "BITWISE_XOR": (2, 3, "INT64?", "xor(c2::BIGINT, c3)", None),
    "LOGICAL_AND": (7, 8, "BOOL8?", "c7 AND c8", None),
    "LOGICAL_OR": (7, 8, "BOOL8?", "c7 OR c8", None),
    "COALESCE": (4, 5, "FLOAT64?", "coalesce(c4, c5)", 6),
    "GENERIC_BINARY": (2, 3, "INT64?", "c2 * 2 - c3", None),
    "SHIFT_LEFT": (0, 1, "INT64", "c0 << c1", None),
    "SHIFT_RIGHT": (0, 1, "INT64", "c0 >> c1", None),
    "SHIFT_RIGHT_UNSIGNED": (0, 1, "INT64", "c0 >> c1", None),
    "LOG_BASE": (0, 1, "FLOAT64?", "CASE WHEN c1 = 1 OR c0 = 0 THEN NULL ELSE ln(c0) / ln(c1) END", 6),
    "ATAN2": (4, 5, "FLOAT64?", "atan2(c4, c5)", 6),
    "NULL_EQUALS": (2, 3, "BOOL8", "c2 IS NOT DISTINCT FROM c3", None),
    "NULL_MAX": (4, 5, "FLOAT64?", "CASE WHEN c4 IS NULL THEN c5 WHEN c5 IS NULL THEN c4 ELSE greatest(c4, c5) END", 6),
    "NULL_MIN": (4, 5, "FLOAT64?", "CASE WHEN c4 IS NULL THEN c5 WHEN c5 IS NULL THEN c4 ELSE least(c4, c5) END", 6),
}
assert set(BINARIES) == set(BINARY)


def _binary(op: str) -> Rel:
    s: Rel = scan(MIXED)
    i, j, kind, _, _ = BINARIES[op]
    return B.project(s, B.col(s, 0), B.col(s, 1), B.op(op, B.col(s, i), B.col(s, j), kind))


for _op, (_, _, _, _sql, _digits) in BINARIES.items():
    add(f"bin_{_op.lower()}", partial(_binary, _op), (MIXED,), "orderkey linenumber v", f"SELECT c0, c1, {_sql} FROM {view(MIXED)}", {"v": _digits} if _digits is not None else {})


SMALL = (12, "lineitem", (*MIXED[2], ("(nullif(l_quantity, 17) - 25) / 30", "FLOAT64?"), ("nullif(l_quantity, 17) + 1", "FLOAT64?")))
UNARIES: dict[str, tuple] = {
    # operator -> (operand, declared type, SQL, digits)
    "SIN": (9, "FLOAT64?", "sin(c9)", 6), "COS": (9, "FLOAT64?", "cos(c9)", 6), "TAN": (9, "FLOAT64?", "tan(c9)", 6),
    "ARCSIN": (9, "FLOAT64?", "asin(c9)", 6), "ARCCOS": (9, "FLOAT64?", "acos(c9)", 6), "ARCTAN": (9, "FLOAT64?", "atan(c9)", 6),
    "SINH": (9, "FLOAT64?", "sinh(c9)", 6), "COSH": (9, "FLOAT64?", "cosh(c9)", 6), "TANH": (9, "FLOAT64?", "tanh(c9)", 6),
    "ARCSINH": (9, "FLOAT64?", "asinh(c9)", 6), "ARCCOSH": (10, "FLOAT64?", "acosh(c10)", 6), "ARCTANH": (9, "FLOAT64?", "atanh(c9)", 6),
    "EXP": (9, "FLOAT64?", "exp(c9)", 6), "LOG": (10, "FLOAT64?", "ln(c10)", 6), "SQRT": (10, "FLOAT64?", "sqrt(c10)", 6), "CBRT": (4, "FLOAT64?", "cbrt(c4)", 6),
    "CEIL": (9, "FLOAT64?", "ceil(c9) + 0.0", 0), "FLOOR": (9, "FLOAT64?", "floor(c9)", 0), "ABS": (2, "INT32?", "abs(c2)", None), "RINT": (5, "FLOAT64?", "round_even(c5, 0)", 0),
    "BIT_INVERT": (3, "INT64?", "~c3", None), "NOT": (7, "BOOL8?", "NOT c7", None),
}
assert set(UNARIES) == set(UNARY)


def _unary(op: str) -> Rel:
    s = scan(SMALL)
    i, kind, _, _ = UNARIES[op]
    return B.project(s, B.col(s, 0), B.col(s, 1), B.un(op, B.col(s, i), kind))


for _op, (_, _, _sql, _digits) in UNARIES.items():
    add(f"un_{_op.lower()}", partial(_unary, _op), (SMALL,), "orderkey linenumber v", f"SELECT c0, c1, {_sql} FROM {view(SMALL)}", {"v": _digits} if _digits is not None else {})

PACKED = (13, "orders", (("o_orderkey", "INT64"), ("nullif(cast(year(o_orderdate) AS bigint), 1995) * 1125899906842624 + cast(month(o_orderdate) AS bigint) * 70368744177664", "INT64?")))


def _extract_year() -> Rel:
    s = scan(PACKED)
    return B.project(s, B.col(s, 0), B.un("EXTRACT_YEAR", B.col(s, 1), "INT64?"))


add("extract_year", _extract_year, (PACKED,), "orderkey year", "SELECT o_orderkey, nullif(year(o_orderdate)::BIGINT, 1995) FROM orders")

# --- whole queries


def _q6() -> Rel:
    s = scan(LINEITEM)
    keep_ = B.both(B.op("LESS", B.col(s, 4), B.lit(24, "FLOAT64"), "BOOL8"), B.op("GREATER_EQUAL", B.col(s, 6), B.lit(0.05, "FLOAT64"), "BOOL8"), B.op("LESS_EQUAL", B.col(s, 6), B.lit(0.07, "FLOAT64"), "BOOL8"))
    f = Filter(s, keep_)
    p = B.project(f, B.op("MUL", B.col(f, 5), B.col(f, 6), "FLOAT64"))
    return B.aggregate(p, (), B.agg("SUM", B.col(p, 0), "FLOAT64?"))


add("q6_json", _q6, (LINEITEM,), "revenue", f"SELECT sum(c5 * c6) FROM {view(LINEITEM)} WHERE c4 < 24 AND c6 >= 0.05 AND c6 <= 0.07", {"revenue": 2})


def _q1() -> Rel:
    s = scan(LINEITEM)
    p = B.project(s, B.col(s, 7), B.col(s, 4), B.col(s, 5), B.op("MUL", B.col(s, 5), B.op("SUB", B.lit(1, "FLOAT64"), B.col(s, 6), "FLOAT64"), "FLOAT64"))
    a = B.aggregate(p, (0,), *(B.agg(o, B.col(p, i), "FLOAT64?") for o, i in (("SUM", 1), ("SUM", 2), ("SUM", 3), ("MEAN", 1), ("MEAN", 2))), B.agg("COUNT_ALL", B.col(p, 0), "INT64"))
    return B.sort(a, (0, "ASC", "FIRST"))


add("q1_json", _q1, (LINEITEM,), "flag quantity price net mean_quantity mean_price n", f"SELECT c7, sum(c4), sum(c5), sum(c5 * (1 - c6)), avg(c4), avg(c5), count(*) FROM {view(LINEITEM)} GROUP BY 1", dict.fromkeys(("quantity", "price", "net"), 2) | dict.fromkeys(("mean_quantity", "mean_price"), 4))


def _q3() -> Rel:
    c, o, l = scan(CUSTOMER), scan(ORDERS), scan(LINEITEM)
    c = B.keep(Filter(c, B.op("EQUAL", B.col(c, 4), B.lit("BUILDING", "STRING"), "BOOL8")), 0)
    o = B.keep(o, 0, 1, 5)
    l = B.project(l, B.col(l, 0), B.op("MUL", B.col(l, 5), B.op("SUB", B.lit(1, "FLOAT64"), B.col(l, 6), "FLOAT64"), "FLOAT64"))
    j = B.join("INNER", B.join("INNER", o, c, (1, 0)), l, (0, 0))
    a = B.aggregate(j, (0, 2), B.agg("SUM", B.col(j, 5), "FLOAT64?"))
    return Limit(B.sort(a, (2, "DESC", "LAST"), (0, "ASC", "FIRST")), 10)


add("q3_json", _q3, (CUSTOMER, ORDERS, LINEITEM), "orderkey priority revenue", f"SELECT o.c0, o.c5, sum(l.c5 * (1 - l.c6)) AS r FROM {view(CUSTOMER)} c JOIN {view(ORDERS)} o ON c.c0 = o.c1 JOIN {view(LINEITEM)} l ON l.c0 = o.c0 WHERE c.c4 = 'BUILDING' GROUP BY 1, 2 ORDER BY r DESC, 1 LIMIT 10", {"revenue": 2})


def _q5() -> Rel:
    c, o, l, n = scan(CUSTOMER), scan(ORDERS), scan(LINEITEM), scan(NATION)
    l = B.project(l, B.col(l, 0), B.op("MUL", B.col(l, 5), B.op("SUB", B.lit(1, "FLOAT64"), B.col(l, 6), "FLOAT64"), "FLOAT64"))
    cn = B.keep(B.join("INNER", c, n, (2, 0)), 0, 6)
    oc = B.keep(B.join("INNER", B.keep(o, 0, 1), cn, (1, 0)), 0, 3)
    j = B.join("INNER", l, oc, (0, 0))
    a = B.aggregate(j, (3,), B.agg("SUM", B.col(j, 1), "FLOAT64?"), B.agg("COUNT_ALL", B.col(j, 0), "INT64"))
    return B.sort(a, (1, "DESC", "LAST"))


add("q5_json", _q5, (CUSTOMER, ORDERS, LINEITEM, NATION), "nation revenue n", f"SELECT n.c1, sum(l.c5 * (1 - l.c6)), count(*) FROM {view(CUSTOMER)} c JOIN {view(NATION)} n ON c.c2 = n.c0 JOIN {view(ORDERS)} o ON o.c1 = c.c0 JOIN {view(LINEITEM)} l ON l.c0 = o.c0 GROUP BY 1", {"revenue": 2})


def _events() -> Rel:
    e = scan(EVENTS)
    a = B.aggregate(e, (1, 2), B.agg("COUNT_ALL", B.col(e, 0), "INT64"), B.agg("SUM", B.col(e, 3), "FLOAT64?"), B.agg("MAX", B.col(e, 0), "INT64?"))
    return a


add("events_by_user", _events, (EVENTS,), "user kind n total last", f"SELECT c1, c2, count(*), sum(c3), max(c0) FROM {view(EVENTS)} GROUP BY 1, 2", {"total": 3})
