"""Checks that building a plan doesn't make: column references against the schemas they point into."""

from __future__ import annotations

from collections.abc import Iterator

from planweft.errors import check
from planweft.plans import expressions as X
from planweft.plans import rels as R
from planweft.types import Schema, TypeId


def expressions_of(rel: R.Rel) -> Iterator[tuple[X.Expression, Schema]]:
    """A node's expressions, each with the schema that its columns are of."""
    if isinstance(rel, R.Filter):
        yield rel.condition, rel.input.schema
    elif isinstance(rel, R.HashJoin):
        yield rel.condition, rel.both
    elif isinstance(rel, R.Project):
        yield from ((x, rel.input.schema) for x in rel.expressions)
    elif isinstance(rel, R.Aggregate):
        yield from ((x, rel.input.schema) for x in rel.groups + rel.aggregations)
    elif isinstance(rel, R.Sort):
        yield from ((i.expression, rel.input.schema) for i in rel.infos)


def conjuncts(condition: X.Expression) -> list[X.Expression]:
    if isinstance(condition, X.BinaryOp) and condition.op == "LOGICAL_AND":
        return conjuncts(condition.left) + conjuncts(condition.right)
    return [condition]


def join_keys(join: R.HashJoin) -> list[tuple[X.ColumnRef, X.ColumnRef]] | None:
    """(left column, right column) of each conjunct; none if the condition is more than equalities of columns."""
    border, keys = len(join.left.schema), []
    for x in conjuncts(join.condition):
        if not (isinstance(x, X.BinaryOp) and x.op == "EQUAL" and isinstance(x.left, X.ColumnRef) and isinstance(x.right, X.ColumnRef)):
            return None
        a, b = sorted((x.left, x.right), key=lambda c: c.index)
        if not a.index < border <= b.index:
            return None
        keys.append((a, b))
    return keys


def validate(plan: R.Rel, strict: bool = True) -> R.Rel:
    """The plan itself, or :class:`PlanError`.

    Strict plans also need what the plan language itself asks for: join keys of
    one type and nullability, plain columns as group and sort keys, an aggregation of one column.
    """
    for rel in plan.walk():
        for top, schema in expressions_of(rel):
            for x in top.walk():
                if isinstance(x, X.ColumnRef):
                    check(0 <= x.index < len(schema), f"{rel}: column {x.index} of {len(schema)}")
                    check(x.type == schema[x.index], f"{rel}: column {x.index} is {schema[x.index]}, not {x.type}")
                check(not isinstance(x, X.Aggregation) or isinstance(rel, R.Aggregate) and x is top, f"{rel}: an aggregation outside of an aggregate")
                if isinstance(x, X.Aggregation):
                    check(all(isinstance(i, int) and 0 <= i < len(schema) for i in x.order_by), f"{rel}: order_by names a column that isn't there")
        if isinstance(rel, (R.Filter, R.HashJoin)):
            check(rel.condition.type.type_id is TypeId.BOOL8, f"{rel}: the condition is {rel.condition.type}, not BOOL8")
        if not strict:
            continue
        if isinstance(rel, R.HashJoin) and rel.type in R.JOINS:
            keys = join_keys(rel)
            check(keys, f"{rel}: the condition must be equalities of a left and a right column")
            check(all(a.type == b.type for a, b in keys), f"{rel}: keys of different types")
        if isinstance(rel, R.Aggregate):
            check(all(isinstance(x, X.ColumnRef) for x in rel.groups), f"{rel}: a group must be a column")
            check(all(isinstance(x.operand, X.ColumnRef) for x in rel.aggregations), f"{rel}: an aggregation takes a column")
        if isinstance(rel, R.Sort):
            check(all(isinstance(i.expression, X.ColumnRef) for i in rel.infos), f"{rel}: a sort key must be a column")
    return plan
