"""The JSON form of plans: nodes in post-order, read with a stack and written by a walk."""

from __future__ import annotations

import json
from typing import Any

from planweft.errors import PlanError, check
from planweft.plans import expressions as X
from planweft.plans import rels as R
from planweft.types import DataType, Schema, type_id

REQUIRED = object()


def get(obj: Any, key: str, kind: type | tuple[type, ...], default: Any = REQUIRED) -> Any:
    check(isinstance(obj, dict), f"an object with {key!r} was expected")
    if key not in obj:
        check(default is not REQUIRED, f"{key!r} is missing")
        return default
    value = obj[key]
    check(isinstance(value, kind) and not (isinstance(value, bool) and kind is int), f"{key!r} can't be {value!r}")
    return value


# --- reading


def read_type(obj: Any) -> DataType:
    return DataType(type_id(get(obj, "type", str)), get(obj, "nullable", bool))


def read_expression(obj: Any, schema: Schema) -> X.Expression:
    check(isinstance(obj, dict), "an expression is an object")
    if "literal" in obj:
        return X.Literal(type_id(get(obj, "type", str)), obj["literal"])
    if "col_ref" in obj:
        return X.column(schema, get(obj, "col_ref", int))
    for key, arity in (("unary_op", 1), ("ti_unary_op", 1), ("binary_op", 2), ("agg", 1)):
        if key not in obj:
            continue
        op, of = get(obj, key, str), [read_expression(x, schema) for x in get(obj, "operands", list)]
        check(len(of) == arity, f"{op} takes {arity} operands, not {len(of)}")
        result = read_type(get(obj, "type", dict))
        if key == "binary_op":
            return X.BinaryOp(op, *of, result)
        if key == "agg":
            n = get(obj, "n", int) if op == "NTH_ELEMENT" else None
            return X.Aggregation(op, of[0], result, n, get(obj, "q", (int, float), None), tuple(get(obj, "order_by", list, [])))
        return X.UnaryOp(op, of[0], result, key == "ti_unary_op")
    raise PlanError(f"unknown expression {obj!r}")


def read_sort_info(obj: Any, schema: Schema) -> R.SortInfo:
    order, nulls = get(obj, "order", str, "ASC"), get(obj, "null_order", str, "NULLS_FIRST")
    check(order in ("ASC", "DESC"), f"unknown order {order!r}")
    check(nulls in ("NULLS_FIRST", "NULLS_LAST"), f"unknown null order {nulls!r}")
    return R.SortInfo(read_expression(get(obj, "expr", dict), schema), order == "DESC", nulls == "NULLS_LAST")


def read_rel(obj: Any, below: list[R.Rel], strict: bool) -> R.Rel:
    kind = get(obj, "rel_op", str)

    def take(n: int) -> list[R.Rel]:
        check(len(below) >= n, f"{kind} lacks an input")
        taken = below[len(below) - n :]
        del below[len(below) - n :]
        return taken

    def many(key: str, schema: Schema) -> tuple:
        return tuple(read_expression(x, schema) for x in get(obj, key, list))

    if kind == "InputSource":
        return R.InputSource(get(obj, "source_id", int), tuple(map(read_type, get(obj, "schema", list))))
    if kind in ("Union", "UnionAll"):
        return R.Union(tuple(take(2)), kind == "Union", strict)
    if kind == "HashJoin":
        left, right = take(2)
        return R.HashJoin(get(obj, "type", str), left, right, read_expression(get(obj, "condition", dict), left.schema + right.schema), get(obj, "build_side", str, None))
    if kind not in ("Filter", "Project", "Aggregate", "Sort", "Limit"):
        raise PlanError(f"unknown node {kind!r}")
    (child,) = take(1)
    if kind == "Filter":
        return R.Filter(child, read_expression(get(obj, "condition", dict), child.schema))
    if kind == "Project":
        return R.Project(child, many("exprs", child.schema))
    if kind == "Aggregate":
        return R.Aggregate(child, many("groups", child.schema), many("aggs", child.schema))
    if kind == "Sort":
        return R.Sort(child, tuple(read_sort_info(x, child.schema) for x in get(obj, "sort_infos", list)))
    return R.Limit(child, get(obj, "n", int), get(obj, "offset", int, 0))


def read_plan(text: str, strict: bool = True) -> R.Rel:
    """The plan of a JSON document ``{"rels": [...]}``."""
    try:
        document = json.loads(text)
    except json.JSONDecodeError as error:
        raise PlanError(f"the plan isn't JSON: {error}") from error
    stack: list[R.Rel] = []
    for obj in get(document, "rels", list):
        stack.append(read_rel(obj, stack, strict))
    check(len(stack) == 1, f"the plan leaves {len(stack)} nodes; it must leave one")
    return stack[0]


# --- writing


def write_type(t: DataType) -> dict:
    return {"type": t.type_id.value, "nullable": t.nullable}


def write_expression(x: X.Expression) -> dict:
    if isinstance(x, X.Literal):
        return {"type": x.type_id.value, "literal": x.value}
    if isinstance(x, X.ColumnRef):
        return {"col_ref": x.index}
    made: dict[str, Any] = {"operands": [write_expression(o) for o in x.operands()], "type": write_type(x.type)}
    if isinstance(x, X.Aggregation):
        made = {"agg": x.op} | made
        return made | {k: v for k, v in (("n", x.n), ("q", x.q), ("order_by", list(x.order_by) or None)) if v is not None}
    key = "binary_op" if isinstance(x, X.BinaryOp) else "ti_unary_op" if x.host else "unary_op"
    return {key: x.op} | made


def write_rel(rel: R.Rel) -> dict:
    if isinstance(rel, R.InputSource):
        return {"rel_op": "InputSource", "source_id": rel.source_id, "schema": [write_type(t) for t in rel.columns]}
    if isinstance(rel, R.Filter):
        return {"rel_op": "Filter", "condition": write_expression(rel.condition)}
    if isinstance(rel, R.Union):
        check(len(rel.children) == 2, "the JSON form has unions of two inputs only")
        return {"rel_op": str(rel)}
    if isinstance(rel, R.HashJoin):
        return {"rel_op": "HashJoin", "type": rel.type} | ({"build_side": rel.build_side} if rel.build_side else {}) | {"condition": write_expression(rel.condition)}
    if isinstance(rel, R.Project):
        return {"rel_op": "Project", "exprs": [write_expression(x) for x in rel.expressions]}
    if isinstance(rel, R.Aggregate):
        return {"rel_op": "Aggregate", "groups": [write_expression(x) for x in rel.groups], "aggs": [write_expression(x) for x in rel.aggregations]}
    if isinstance(rel, R.Sort):
        return {"rel_op": "Sort", "sort_infos": [{"expr": write_expression(i.expression), "order": "DESC" if i.descending else "ASC", "null_order": "NULLS_LAST" if i.nulls_last else "NULLS_FIRST"} for i in rel.infos]}
    return {"rel_op": "Limit", "offset": rel.offset, "n": rel.n}


def write_plan(rel: R.Rel) -> str:
    return json.dumps({"rels": [write_rel(x) for x in rel.walk()]})
