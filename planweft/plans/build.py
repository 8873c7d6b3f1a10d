"""Short forms for building plans in Python."""

from __future__ import annotations

from planweft.plans import expressions as X
from planweft.plans import rels as R
from planweft.types import DataType, TypeId


def t(name: str) -> DataType:
    """``"INT64"``, or with a question mark a nullable type."""
    return DataType(TypeId[name.rstrip("?")], name.endswith("?"))


def lit(value: object, of: str) -> X.Literal:
    return X.Literal(TypeId[of], value)


def op(name: str, a: X.Expression, b: X.Expression, of: str) -> X.BinaryOp:
    return X.BinaryOp(name, a, b, t(of))


def both(*conditions: X.Expression) -> X.Expression:
    """All conditions, as a tree of LOGICAL_AND."""
    first, *others = conditions
    for x in others:
        nullable = first.type.nullable or x.type.nullable
        first = X.BinaryOp("LOGICAL_AND", first, x, DataType(TypeId.BOOL8, nullable))
    return first


def un(name: str, a: X.Expression, of: str) -> X.UnaryOp:
    return X.UnaryOp(name, a, t(of), name in X.HOST_UNARY)


def agg(name: str, a: X.Expression, of: str, **more: object) -> X.Aggregation:
    return X.Aggregation(name, a, t(of), **more)


def source(source_id: int, *columns: str) -> R.InputSource:
    return R.InputSource(source_id, tuple(map(t, columns)))


def col(rel: R.Rel, i: int) -> X.ColumnRef:
    return X.column(rel.schema, i)


def project(rel: R.Rel, *expressions: X.Expression) -> R.Project:
    return R.Project(rel, expressions)


def keep(rel: R.Rel, *columns: int) -> R.Project:
    return R.Project(rel, tuple(col(rel, i) for i in columns))


def aggregate(rel: R.Rel, groups: tuple[int, ...], *aggregations: X.Aggregation) -> R.Aggregate:
    return R.Aggregate(rel, tuple(col(rel, i) for i in groups), aggregations)


def join(kind: str, left: R.Rel, right: R.Rel, *keys: tuple[int, int], build_side: str | None = None) -> R.HashJoin:
    """Equality of left column i and right column j (each counted in its own input) for every key (i, j)."""
    schema, n = left.schema + right.schema, len(left.schema)
    equal = [X.BinaryOp("EQUAL", X.column(schema, i), X.column(schema, n + j), DataType(TypeId.BOOL8, schema[i].nullable)) for i, j in keys]
    return R.HashJoin(kind, left, right, both(*equal), build_side)


def sort(rel: R.Rel, *keys: tuple[int, str, str]) -> R.Sort:
    """Keys (column, ASC or DESC, FIRST or LAST)."""
    return R.Sort(rel, tuple(R.SortInfo(col(rel, i), order == "DESC", nulls == "LAST") for i, order, nulls in keys))
